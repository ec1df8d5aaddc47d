"""Token ids of documents in bit-packed files: each id takes the fewest bits that the vocabulary needs.

A file is the `data` of one row of a Parquet table, so that any store Spark can write to will do, and a lost task
leaves no half-written file. Little-endian layout:

    magic 8s | width u32 | block u32 | documents u64 | ids u64 | ids before this file in its shard u64
    doc_id i64 x documents | first id of each document u64 x (documents + 1)
    byte offset of each block in the payload u64 x (blocks + 1)
    payload: blocks of `block` ids, each padded to whole bytes, lowest bit first

A null doc_id is stored as NO_ID. Blocks can be unpacked one by one with numpy; see read_ids().
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dictspark.llm.common import new_path, pieces, table

MAGIC = b"DSTOKEN1"
_HEAD = struct.Struct("<8sIIQQQ")
NO_ID = -(1 << 63)
BLOCK = 4096
#: A file is closed once it has so many ids; a document is never split.
FILE_IDS = 1 << 21
#: Documents to a shard, and the most shards.
SHARD_DOCS, SHARDS = 4096, 20_000
FILE_SCHEMA = "shard int, part int, ids_before bigint, n_ids bigint, n_docs bigint, data binary"

# Texts of these characters alone fall apart at white space: no combining marks, no space on which engines differ.
_ODD = r"[^\t-\r -~\x{a1}-\x{12f}\x{131}-\x{24f}]|<\|"
_LETTERS = re.compile("[a-zªµºß-öø-ɏ]+")
#: Marks at the end of a word, which the model takes apart from it; apostrophes begin tokens of their own.
_ENDED = r"([0-9a-zªµºß-öø-ɏ])([!-&(-/:-@\[-`{-~]+)(\s|$)"
#: The only steps before the model for which a text's ids are those of its words.
_BEFORE = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: Bytes as the characters by which byte-level models write them.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b if b in _PRINTED else 256 + b - sum(p < b for p in _PRINTED)) for b in range(256)}
#: Words that are remembered.
_WORDS = 800_000


class Encoder:
    """Ids of whole texts, with a bounded table of words already encoded."""

    def __init__(self, path: str, special: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = not special
        self.size = self.model.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bpe = self.model.model
        parsed = json.loads(self.model.to_str())
        before = parsed.get("pre_tokenizer") or {}
        steps = before.get("pretokenizers", [])
        #: Whether a text's ids are those of its words, one after the other (this needs white space to be dropped).
        self.by_word = (
            [x.get("type") for x in (parsed.get("normalizer") or {}).get("normalizers", [])] == _BEFORE["normalizer"]
            and [x.get("type") for x in steps] == _BEFORE["pre_tokenizer"]
            and steps[0].get("pattern") == {"Regex": _BEFORE["split"]}
            and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and parsed["model"].get("type") == "BPE"
            and parsed["model"].get("end_of_word_suffix") == "</w>"
            and not parsed.get("post_processor")
        )
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.starts, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.dtype), 0

    def _plain(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _learn(self, missing: list[str]) -> None:
        """Add the ids of missing words to the table."""
        lists = []
        for w in missing:
            if _LETTERS.fullmatch(w):
                lists.append([x.id for x in self.bpe.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS))])
            else:
                lists.append(self._plain(w))
        first = len(self.words)
        ends = self.used + np.cumsum([len(x) for x in lists])
        if first + len(missing) + 1 > len(self.starts):
            self.starts = np.append(self.starts, np.zeros(max(len(self.starts), len(missing)), np.int64))
        if ends[-1] > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(max(len(self.ids), int(ends[-1])), self.dtype))
        self.starts[first + 1 : first + 1 + len(missing)] = ends
        self.ids[self.used : ends[-1]] = np.fromiter(itertools.chain.from_iterable(lists), self.dtype, int(ends[-1]) - self.used)
        self.used = int(ends[-1])
        self.words.update(zip(missing, range(first, first + len(missing))))

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _ENDED, r"\1 \2\3"))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.words) + len(words) > _WORDS:
            self._forget()
        missing = [w for w in words if w not in self.words]
        if missing:
            self._learn(missing)
        row = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if words else np.zeros(0, np.int64)
        begin = self.starts[row]
        end = np.cumsum(self.starts[row + 1] - begin)
        size = np.diff(end, prepend=0)
        flat = self.ids[np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - size), size)]
        bounds = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        return flat, np.append(0, end)[bounds - bounds[0]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts, one after the other; where each one's begin, and the end); nulls count as empty."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        if not odd.any() and len(texts):
            return self._by_words(texts)
        parts: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        plain = np.flatnonzero(~odd)
        if len(plain):
            flat, bounds = self._by_words(texts.take(pa.array(plain)))
            for k, i in enumerate(plain.tolist()):
                parts[i] = flat[bounds[k] : bounds[k + 1]]
        for i in np.flatnonzero(odd).tolist():
            parts[i] = np.array(self._plain(texts[i].as_py()), self.dtype)
        return np.concatenate([*parts, np.zeros(0, self.dtype)]), np.cumsum([0, *map(len, parts)])


@functools.lru_cache(maxsize=2)
def encoder(path: str, special: bool = True) -> Encoder:
    return Encoder(path, special)


def width_of(size: int) -> int:
    """Bits for ids below size."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """width bits of each id (32 at most), lowest bit first; the last byte is filled up with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    at = np.arange(len(ids), dtype=np.int64) * width
    word, shift = at >> 5, (at & 31).astype(np.uint64)
    shifted = ids.astype(np.uint64) << shift  # each id reaches into one or two words of 32 bits
    out = np.zeros(-(-len(ids) * width // 32) + 1, np.uint64)
    for part, place in ((shifted & np.uint64(0xFFFFFFFF), word), (shifted >> np.uint64(32), word + 1)):
        first = np.flatnonzero(np.diff(place, prepend=-1)) if len(place) else place
        out[place[first]] |= np.bitwise_or.reduceat(part, first) if len(first) else part
    return out.astype("<u4").tobytes()[: -(-len(ids) * width // 8)]


def unpack(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    raw = np.zeros(-(-n * width // 32) * 4 + 8, np.uint8)
    own = np.frombuffer(data, np.uint8)[: -(-n * width // 8)]
    raw[: len(own)] = own
    words = raw[: len(raw) // 4 * 4].view("<u4").astype(np.uint64)
    at = np.arange(n, dtype=np.int64) * width
    both = words[at >> 5] | (words[(at >> 5) + 1] << np.uint64(32))
    return ((both >> (at & 31).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def build_file(doc_ids: list[int], ids: list[np.ndarray], width: int, before: int = 0, block: int = BLOCK) -> bytes:
    starts = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) for x in ids], out=starts[1:])
    whole = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    if len(whole) and int(whole.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    blocks = [pack(whole[i : i + block], width) for i in range(0, len(whole), block)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(x) for x in blocks], out=offsets[1:])
    head = _HEAD.pack(MAGIC, width, block, len(ids), len(whole), before)
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Random access to one file."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.block, docs, self.n_ids, self.before = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at := at + 8 * docs).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * (docs + 1)).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (blocks + 1) :]

    def read_ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; only the blocks that hold them are unpacked."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError((start, stop))
        if start == stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        if self.width in (8, 16, 32):
            step = self.width // 8
            return np.frombuffer(self.payload[start * step : stop * step], f"<u{step}").astype(np.uint32)
        out = [unpack(self.payload[self.offsets[k] : self.offsets[k + 1]], min(self.block, self.n_ids - k * self.block), self.width) for k in range(first, last + 1)]
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read_ids(int(self.starts[k]), int(self.starts[k + 1]))


def _write(path: str, end_id: int | None, special: bool, width: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(path, special), TaskContext.get().partitionId()
        bits = width or width_of(max(coder.size, (end_id or 0) + 1))
        tail = np.array([] if end_id is None else [end_id], coder.dtype)
        part = before = held = 0
        doc_ids, ids = [], []

        def close() -> pa.RecordBatch:
            row = (shard, part, before, held, len(ids), build_file(doc_ids, ids, bits, before))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "part", "ids_before", "n_ids", "n_docs", "data"])

        for batch in pieces(batches, 1):
            flat, bounds = coder.encode(batch.column(1))
            for doc_id, lo, hi in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids.append(np.concatenate([flat[lo:hi], tail]))
                doc_ids.append(NO_ID if doc_id is None else doc_id)
                held += len(ids[-1])
                if held >= FILE_IDS:
                    yield close()
                    part, before, held, doc_ids, ids = part + 1, before + held, 0, [], []
        if ids:
            yield close()

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 2, special: bool = True, width: int | None = None) -> None:
    """Encode docs(doc_id, text), in ascending doc_id order, into bit-packed files in the table at out.

    Null texts count as empty; rows with a null doc_id come first; rows that share a doc_id are ordered by text;
    other columns are not read. An empty table gives a table without files. special: whether strings of special
    tokens in a text become those tokens, as the tokenizers library does by default.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(SHARDS, max(parts, -(-docs.count() // SHARD_DOCS)))
    dealt = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_write(tokenizer, end_id, special, width), FILE_SCHEMA).write.option("compression", "zstd").parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            file = TokenFile(data.as_py())
            crc = [zlib.crc32(file.document(k).astype("<u4").tobytes()) for k in range(len(file.doc_ids))]
            n = len(crc)
            doc_ids = pa.array(file.doc_ids, mask=file.doc_ids == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), doc_ids, pa.array(file.before + file.starts[:-1]), pa.array(np.diff(file.starts)), pa.array(crc, pa.int64())], names=["shard", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at path.

    start counts the ids of all documents before it. Only the totals of the shards, SHARDS at most, are summed up in
    one place and broadcast.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    rows = files.select("shard", "data").mapInArrow(_read, "shard int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files of docs to the shared folder, where they stay, and return what is read back from them."""
    spark = docs.sparkSession
    out = new_path(spark, "tokens", keep=True)
    write_token_files(docs, out, tokenizer, end_id)
    return read_token_files(spark, out)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from token files; see write_token_files() for odd rows."""
    return token_output(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)
