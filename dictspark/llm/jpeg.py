"""Media columns: baseline JPEG written and read in numpy, luminance thumbnails of DC coefficients, and their hashes.

Payloads are stored without loss as grey images: each byte is the mean of one block of 8 x 8 samples, quantised by 8,
so that the block's DC coefficient is the byte less 128 and all its AC coefficients are zero. Any reader of baseline
JPEG shows flat blocks of just that grey. A restart marker ends every row of blocks, so that rows are decoded side by side.

The reader takes any baseline JPEG with Huffman codes: several components, subsampling, restarts. Stretches between
restarts, of all images of a batch that share their tables, go through the Huffman tables in step, one block at a time.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dictspark.llm.common import pieces, spread, table, text_bytes

#: Blocks in a row of an image, and rows of one image; longer payloads go on in further images.
COLUMNS, IMAGE_ROWS = 192, 8191
#: Stretches from which they are decoded side by side; fewer are walked one after the other, with the same result.
ABREAST = 8


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Category c has the code of 9 - c bits that is all ones but for its last bit; no code is all ones. A block has ten bits.
_DC_LENGTHS = bytes([1] * 9 + [0] * 7)
_DC_SYMBOLS = bytes(range(8, -1, -1))
_TABLES = _segment(0xDB, b"\x00" + b"\x08" * 64) + _segment(0xC4, b"\x00" + _DC_LENGTHS + _DC_SYMBOLS) + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")


@functools.lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """The ten bits of a block for each difference from -255 to 255: category, value, end of block."""
    out = np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        c = abs(diff).bit_length()
        code = (1 << (9 - c)) - 2
        value = diff if diff >= 0 else diff + (1 << c) - 1
        out[diff + 255] = ((code << c) | value) << 1
    return out


def _scans(samples: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(rows of blocks as entropy-coded bytes, each with its restart marker behind it, and where each begins).

    number[i] is the number of row i in its image; the last row of an image has a marker too, to be left out.
    """
    diff = samples.astype(np.int16)
    diff[:, 1:] -= samples[:, :-1]
    diff[:, 0] -= 128
    codes = _codes()[diff + 255].reshape(-1, 4)  # four blocks are five bytes
    packed = (codes[:, 0] << np.uint64(30)) | (codes[:, 1] << np.uint64(20)) | (codes[:, 2] << np.uint64(10)) | codes[:, 3]
    raw = np.ascontiguousarray(packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).ravel()
    full = raw == 0xFF
    width = samples.shape[1] // 4 * 5
    place = np.arange(len(raw)) + np.cumsum(full) - full + 2 * (np.arange(len(raw)) // width)
    ends = np.concatenate([[0], place[width - 1 :: width] + 3 + full[width - 1 :: width]])
    out = np.zeros(ends[-1], np.uint8)
    out[place] = raw
    out[ends[1:] - 2], out[ends[1:] - 1] = 0xFF, 0xD0 + number % 8
    return out.tobytes(), ends


def _image(scan: bytes, rows: int, columns: int) -> bytes:
    frame = _segment(0xDD, struct.pack(">H", columns)) + _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + b"\x01\x11\x00")
    return b"\xff\xd8" + _TABLES + frame + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"


def store_all(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a multiple of COLUMNS bytes, as one grey image or several, one after the other."""
    rows = [len(x) // COLUMNS for x in payloads]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, COLUMNS)
    number = (np.concatenate([np.arange(n) for n in rows]) if rows else np.zeros(0, np.int64)) % IMAGE_ROWS
    scan, ends = _scans(samples, number)
    out, at = [], 0
    for n in rows:
        images = [(k, min(k + IMAGE_ROWS, at + n)) for k in range(at, at + n, IMAGE_ROWS)]
        out.append(b"".join(_image(scan[ends[lo] : ends[hi] - 2], hi - lo, COLUMNS) for lo, hi in images))
        at += n
    return out


class Damaged(ValueError):
    """Not a baseline JPEG, or one that ends too soon."""


@functools.lru_cache(maxsize=64)
def _huffman(lengths: bytes, symbols: bytes) -> np.ndarray:
    """256 x the bits of a code + its symbol, for each sixteen bits that begin with it; zero where no code does."""
    out = np.zeros(1 << 16, np.uint16)
    code = k = 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            if code >= 1 << n or k >= len(symbols):
                raise Damaged("bad Huffman table")
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


_SCAN_END = re.compile(b"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


def _parse(data: bytes) -> tuple[dict, int]:
    """(frame, tables and scan of the first image in data, where it ends)."""
    if data[:2] != b"\xff\xd8":
        raise Damaged("no start of image")
    at, out = 2, {"quant": {}, "huff": {}, "restart": 0}
    while True:
        while at < len(data) and data[at] != 0xFF:
            at += 1
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at + 3 > len(data):
            raise Damaged("no scan")
        marker, size = data[at], struct.unpack_from(">H", data, at + 1)[0]
        body = data[at + 3 : at + 1 + size]
        at += 1 + size
        if len(body) != size - 2:
            raise Damaged("short segment")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huff"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not height or not width or not n:
                raise Damaged("not 8-bit samples")
            out |= {"height": height, "width": width, "parts": [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]}
        elif 0xC0 < marker < 0xD0 and marker not in (0xC8, 0xCC):
            raise Damaged("not baseline")
        elif marker == 0xDA:
            if "parts" not in out:
                raise Damaged("scan without frame")
            out["scan"] = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            marker = _SCAN_END.search(data, at)
            if not marker:
                raise Damaged("no end of image")
            end = marker.start()
            out["data"] = data[at:end]
            finish = data.find(b"\xff\xd9", end)
            if finish < 0:
                raise Damaged("no end of image")
            return out, finish + 2


class _Layout:
    """What images must share to be decoded together: tables, and the blocks of a unit (one, or all that are interleaved)."""

    def __init__(self, image: dict) -> None:
        parts = [(name, h, v) for name, h, v, _ in image["parts"] if name in image["scan"]]
        if not parts or parts[0][0] != image["parts"][0][0] or not all(h and v for _, h, v, _ in image["parts"]):
            raise Damaged("the first scan has no luminance")
        most_h, most_v = max(p[1] for p in image["parts"]), max(p[2] for p in image["parts"])
        _, h, v = parts[0]
        single = len(parts) == 1
        self.wide, self.high = -(-image["width"] * h // (8 * most_h)), -(-image["height"] * v // (8 * most_v))
        self.units_x, self.units_y = (self.wide, self.high) if single else (-(-image["width"] // (8 * most_h)), -(-image["height"] // (8 * most_v)))
        self.h, self.v = (1, 1) if single else (h, v)
        #: For each block of a unit: number of its component (0: luminance), DC and AC table.
        self.blocks: list[tuple[int, int, int]] = []
        used: list[tuple[bytes, bytes]] = []
        for k, (name, ph, pv) in enumerate(parts):
            tables = []
            for wanted in (image["scan"][name][0], 16 + image["scan"][name][1]):
                if wanted not in image["huff"]:
                    raise Damaged("no Huffman table")
                used.append(image["huff"][wanted])
                tables.append(len(used) - 1)
            self.blocks += [(k, *tables)] * (1 if single else ph * pv)
        self.units = self.units_x * self.units_y
        every = image["restart"] or self.units
        #: Units of each stretch between restarts.
        self.runs = [min(every, self.units - at) for at in range(0, self.units, every)]
        self.key = tuple(self.blocks), tuple(used)

    def grid(self, values: np.ndarray) -> np.ndarray:
        """DC coefficients of luminance as rows and columns of blocks."""
        tiles = values.reshape(self.units_y, self.units_x, self.v, self.h).transpose(0, 2, 1, 3)
        return tiles.reshape(self.units_y * self.v, self.units_x * self.h)[: self.high, : self.wide]


def _stretches(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all scans without markers and stuffing, where each stretch begins and the end, scan of each stretch)."""
    raw = np.frombuffer(b"".join(scans), np.uint8)
    full = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[full + 1]
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    kept = np.ones(len(raw), bool)
    kept[full[after == 0] + 1] = False
    kept[full[after == 0xFF]] = False
    kept[marks] = kept[marks + 1] = False
    before = np.concatenate([[0], np.cumsum(kept)])
    first = np.cumsum([0, *map(len, scans)])
    begin = np.sort(np.concatenate([first[:-1], marks + 2]))
    return raw[kept], np.append(before[begin], before[-1]), np.searchsorted(first, begin, side="right") - 1


def _in_step(data: np.ndarray, begin: np.ndarray, end: np.ndarray, units: np.ndarray, key: tuple) -> list[np.ndarray]:
    """DC coefficients of luminance in each stretch data[begin[i]:end[i]] of units[i] units, all stretches in step."""
    blocks, used = key
    tables = [_huffman(*x) for x in used]
    order = np.argsort(-units, kind="stable")  # the stretches that go on longest first: those that still run are a prefix
    left, at, stop = units[order], begin[order] * 8, end[order] * 8
    window = np.lib.stride_tricks.sliding_window_view(np.append(data, np.full(16, 0xFF, np.uint8)), 8)
    window = np.ascontiguousarray(window).view(">u8").ravel().astype(np.uint64)  # the eight bytes from each byte on
    last = np.zeros((1 + max(b[0] for b in blocks), len(at)), np.int64)
    own = sum(b[0] == 0 for b in blocks)
    out = np.zeros((int(left[0]) * own, len(at)), np.int32)
    most, seven, six = len(window) - 1, np.uint64(7), np.uint64(63)

    def symbol(place: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, bits behind it in the category that its last four bits name, place behind them)."""
        bits = window[np.minimum(place >> 3, most)] << (place.astype(np.uint64) & seven)
        found = table[(bits >> np.uint64(48)).astype(np.int64)]
        if not found.all():
            raise Damaged("bad code")
        size, code = found & np.uint16(15), found >> np.uint16(8)
        value = ((bits << code.astype(np.uint64)) >> np.uint64(1)) >> (six - size.astype(np.uint64))
        return found & np.uint16(255), value.astype(np.int64), place + (code + size)

    row = 0
    for unit in range(int(left[0])):
        n = int(np.searchsorted(-left, -unit, side="left"))  # stretches with more than unit units
        for part, dc, ac in blocks:
            kind, value, place = symbol(at[:n], tables[dc])
            if (kind > 15).any():
                raise Damaged("bad category")
            half = (np.int64(1) << kind.astype(np.int64)) >> 1
            last[part, :n] += np.where(value >= half, value, value - 2 * half + 1)
            if part == 0:
                out[row, :n] = last[0, :n]
                row += 1
            live, k = None, 1
            while True:  # AC coefficients: read, not kept
                kind, _, place_ = symbol(place if live is None else place[live], tables[ac])
                run = kind >> np.uint16(4)
                step = np.where(kind & np.uint16(15), run + 1, np.where(run == 15, 16, 64)).astype(np.int64)
                k = k + step
                if live is None:
                    place, live = place_, np.arange(n)
                else:
                    place[live] = place_
                more = k < 64
                if not more.any():
                    break
                live, k = live[more], k[more]
            at[:n] = place
    if (at > stop).any():
        raise Damaged("short scan")
    found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(at)
    for column, i in enumerate(order.tolist()):
        found[i] = out[: int(left[column]) * own, column]
    return found


def _walk(data: np.ndarray, begin: int, end: int, units: int, key: tuple) -> np.ndarray:
    """As _in_step() for one stretch, symbol by symbol."""
    blocks, used = key
    tables = [_huffman(*x).tolist() for x in used]
    source, held, n, last, out = iter(data[begin:end].tolist()), 0, 0, [0] * len(blocks), []
    spare = 0  # bits behind the end
    for _ in range(units):
        for part, dc, ac in blocks:
            k, table = 0, tables[dc]
            while k < 64:
                while n < 32:  # a code and its value
                    byte = next(source, None)
                    spare += 8 * (byte is None)
                    held, n = (held << 8 | (0xFF if byte is None else byte)) & 0xFFFFFFFFFF, n + 8
                found = table[held >> (n - 16) & 0xFFFF]
                if not found or (k == 0 and found & 255 > 15):
                    raise Damaged("bad code")
                size, n = found & 15, n - (found >> 8)
                value, n = held >> (n - size) & ((1 << size) - 1), n - size
                if k == 0:
                    last[part] += value if not size or value >> (size - 1) else value - (1 << size) + 1
                    if part == 0:
                        out.append(last[0])
                    k, table = 1, tables[ac]
                else:
                    run = (found & 255) >> 4
                    k += run + 1 if size else 16 if run == 15 else 64
    if spare > n:
        raise Damaged("short scan")
    return np.array(out, np.int32)


def decode_all(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each of media, (width, height, DC-only luminance thumbnail) of every image in it; a thumbnail has one byte a block."""
    images, owner = [], []
    for k, data in enumerate(media):
        at = 0
        while at < len(data):
            image, size = _parse(data[at:] if at else data)
            images.append(image | {"layout": _Layout(image)})
            owner.append(k)
            at += size
    out: list[list] = [[] for _ in media]
    if not images:
        return out
    data, bounds, of = _stretches([x["data"] for x in images])
    n = np.bincount(of, minlength=len(images))
    groups: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        if n[k] != len(image["layout"].runs):
            raise Damaged("restarts are missing")
        groups.setdefault(image["layout"].key, []).append(k)
    values: list[list[np.ndarray]] = [[] for _ in images]
    first = np.cumsum(n) - n
    for key, own in groups.items():
        which = np.concatenate([np.arange(first[k], first[k] + n[k]) for k in own])
        units = np.concatenate([images[k]["layout"].runs for k in own]).astype(np.int64)
        begin, end = bounds[which], bounds[which + 1]
        found = _in_step(data, begin, end, units, key) if len(which) >= ABREAST else [_walk(data, *x, key) for x in zip(begin.tolist(), end.tolist(), units.tolist())]
        for i, x in zip(of[which].tolist(), found):
            values[i].append(x)
    for k, image, found in zip(owner, images, values):
        scale = image["quant"].get(image["parts"][0][3])
        if scale is None:
            raise Damaged("no quantisation table")
        grey = image["layout"].grid(np.concatenate(found)) * scale / 8
        out[k].append((image["width"], image["height"], np.clip(np.rint(grey) + 128, 0, 255).astype(np.uint8)))
    return out


def decode(data: bytes) -> list[tuple[int, int, np.ndarray]]:
    return decode_all([data])[0]


def pad(raw: bytes, unit: int = COLUMNS) -> bytes:
    """raw and as many spaces as make a positive multiple of unit."""
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def store(payload: bytes) -> bytes:
    return store_all([payload])[0]


def load(media: bytes) -> bytes:
    return b"".join(thumbnail.tobytes() for _, _, thumbnail in decode(media))


def difference_hash(thumbnail: np.ndarray) -> str:
    """64 bits: whether each cell of an 8 x 9 grid of means is brighter than the next to its right."""
    means = thumbnail.astype(np.float64)
    for axis, n in ((0, 8), (1, 9)):
        edges = np.arange(n) * means.shape[axis] // n
        sizes = np.maximum(np.diff(np.append(edges, means.shape[axis])), 1).reshape((-1, 1) if axis == 0 else (1, -1))
        means = np.add.reduceat(means, edges, axis=axis) / sizes
    return np.packbits(means[:, :-1] > means[:, 1:]).tobytes().hex()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        raw, bounds = text_bytes(batch.column(1))
        own = [raw[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        media = store_all([pad(x) for x in own])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 2):
        found = []
        stored = batch.column(2).to_pylist()
        for media, images in zip(stored, decode_all(stored)):
            payload = b"".join(t.tobytes() for _, _, t in images)
            feature = " ".join(f"{w}x{h}:{difference_hash(t)}" for w, h, t in images)
            found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        own = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of docs(doc_id, text), padded, as JPEG.

    Null texts count as empty and become one row of spaces; equal texts give equal media; rows with a null or repeated
    doc_id are kept; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(rows).mapInArrow(_encode, "doc_id bigint, n_bytes bigint, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Payload digests, dimensions and thumbnail hashes of a media column; damaged media raise Damaged."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, schema)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as JPEG, decoded again: digests, dimensions and thumbnail hashes.

    Null and empty texts become one row of spaces; equal texts get equal values; an empty table gives no rows.
    """
    return media_features(media_column(table(spark, sf_dir, "documents")))
