"""Helpers shared by the corpus operators: tables in the shared folder, Arrow access and small sketches."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dictspark.plans.corpus import spread as spread

_OWN_DIR: dict[str, str] = {}
_SCRATCH: dict[str, list[str]] = {}
#: Bytes of text that a Python worker looks at in one go.
PIECE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one if all of Spark is one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="dictspark-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path in the shared folder; unless it is to be kept, remembered for release_scratch()."""
    path = f"{shared_dir(spark)}/dictspark-llm/{label}-{uuid.uuid4().hex}"
    if not keep:
        _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once all that reads them has been stored."""
    for df in tables:
        spark = df.sparkSession
        _delete(spark, df.scratch)
        with contextlib.suppress(KeyError, ValueError):
            _SCRATCH[spark.sparkContext.applicationId].remove(df.scratch)


def scratch_tables(spark: SparkSession) -> int:
    """How many tables of materialize() there are now, for the argument of release_scratch()."""
    return len(_SCRATCH.get(spark.sparkContext.applicationId, []))


def release_scratch(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete what materialize() wrote in this application after the first `since` tables, but not keep.

    Call it once the results that read those tables have been stored.
    """
    own = _SCRATCH.get(spark.sparkContext.applicationId, [])
    gone = [path for path in own[since:] if keep is None or path != keep.scratch]
    own[since:] = [path for path in own[since:] if path not in gone]
    return sum(_delete(spark, path) for path in gone)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that none of columns has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Return to the system what this process has freed: Python workers stay for later stages, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about most bytes in column number text; a row is never cut. Freed memory is given back at the end."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        whole, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(whole, whole[at] - sizes[at] + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    batch = None
    give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 4; null ids count as fold 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4, F.lit(0))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    bounds = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow for a function of one batch, which gets pieces of bounded size in the column text."""
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, place):
            yield function(batch)

    return df.mapInArrow(run, schema)
