"""Dictionaries on the executors.

Tables of rules and entries are joined without hints: Spark broadcasts them if their size, known or measured by adaptive
execution, is below spark.sql.autoBroadcastJoinThreshold, and shuffles both sides otherwise.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from dictspark.sources.dictionary import Dictionary

#: Answers that a task remembers.
REMEMBERED = 200_000
#: Bytes up to which a pickled dictionary is sent; the largest published ones have about a million entries, or 100 MB.
MOST_BYTES = 512 << 20
#: Tasks for each core where every word costs milliseconds, so that slow words don't hold up the rest.
TASKS = 4


def shared(dictionary: Dictionary, df: DataFrame):
    """dictionary as a broadcast variable, if its size allows that."""
    entries = dictionary.entries
    sample = entries[:: max(1, len(entries) // 1000)]
    size = len(pickle.dumps(sample)) * max(1, len(entries)) // max(1, len(sample))  # as they are sent, by a thousand of them
    if size > MOST_BYTES:
        raise ValueError(f"about {size >> 20} MB of entries are too many to send to every executor; join with its tables by operators.lookup.checked()")
    return df.sparkSession.sparkContext.broadcast(dictionary)


def by_word(df: DataFrame, column: str, dictionary: Dictionary, added: list[tuple[str, str, pa.DataType]], answer: Callable[[Dictionary, str], tuple | list[tuple]], several: bool = False, costly: bool = False) -> DataFrame:
    """df with columns of answers about one of its columns of words; several: answer gives a list, each a row of its own.

    One pass over Arrow batches: a task remembers the answers for words that come again. No shuffle, unless words are
    costly, milliseconds each; then they are dealt out evenly first, whatever few partitions they came in. A null word
    gives nulls, or no row where answers are lists.
    """
    sent = shared(dictionary, df)
    if costly:
        df = df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism)
    place = df.columns.index(column)
    names = [*df.columns, *(name for name, _, _ in added)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{name}` {kind}" for name, kind, _ in added])
    types = [arrow for _, _, arrow in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = sent.value, {}
        for batch in batches:
            rows, values = [], []
            for row, word in enumerate(batch.column(place).to_pylist()):
                if word is None:
                    found = (None,) * len(types)
                    if several:
                        continue
                else:
                    if word not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = answer(own, word)
                    found = known[word]
                for x in found if several else [found]:
                    rows.append(row)
                    values.append(x)
            kept = batch.take(pa.array(rows, pa.int64()))
            new = [pa.array([v[k] for v in values], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=names)

    return df.mapInArrow(run, schema)
