"""Shared parts of the text operators: Arrow row mapping, word hashes, merged partition sketches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

U64 = np.uint64
#: Bytes 0x20 and 0x09-0x0D separate words.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an id table that may be broadcast (24 MB at most); a longer one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small_side(ids: DataFrame) -> DataFrame:
    """``ids``, a written table of numbers, marked for broadcast if it is short enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], Iterable[tuple]]], chunk: int = 4096) -> DataFrame:
    """``mapInArrow`` for functions of one row that give any number of output tuples.

    ``make`` runs once in each task and returns the function. Input columns come as a dict of
    Python values. At most ``chunk`` output rows are held at once.
    """
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, rows = make(), []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows))
            batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, out)], schema=out)
            rows.clear()
            return batch

        for batch in batches:
            names = batch.schema.names
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for values in zip(*(part.column(i).to_pylist() for i in range(part.num_columns))):
                    rows.extend(f(dict(zip(names, values))))
                    if len(rows) >= chunk:
                        yield flush()
        if rows:
            yield flush()

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- hashes of words and word windows


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values: for whole numbers a plain sort is much faster than numpy's own way."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


_COEF: dict = {}
_MARKED = bytes(0 if b in SPACES else 1 for b in range(256))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as an array, first byte of each word, byte after each word)."""
    inside = np.frombuffer(b"\0" + data.translate(_MARKED) + b"\0", np.uint8)
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return np.frombuffer(data, np.uint8), edge[::2], edge[1::2]


#: Bytes that are hashed at once; a longer word is hashed whole.
HASHED = 1 << 16


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of ``data``; equal words have equal hashes in any text and process.

    A polynomial over the word's bytes, from running sums over the text: a few array steps for each byte.
    """
    buf, a, z = word_spans(data)
    out, k = np.empty(len(a), U64), 0
    while k < len(a):
        lo, upto = int(a[k]), max(k + 1, int(np.searchsorted(z, a[k] + HASHED, "right")))
        hi = int(z[upto - 1])
        power, inverse = _powers(_BASES[1], hi - lo)
        first, last = a[k:upto] - lo, z[k:upto] - lo
        with np.errstate(over="ignore"):
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum(buf[lo:hi] * power[: hi - lo], out=sums[1:])
            out[k:upto] = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(U64) * U64(0xD6E8FEB86659FD93))
        k = upto
    return out


_BASES = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xA0761D6478BD642F)]


def _powers(base: U64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and the inverses of these, modulo 2**64."""
    got = _COEF.get(base)
    if got is None or len(got[0]) <= n:
        size, inverse = 1 << max(12, (n + 1).bit_length()), pow(int(base), -1, 1 << 64)
        pair = []
        for b in (int(base), inverse):
            p = np.full(size, U64(b))
            p[0] = 1
            with np.errstate(over="ignore"):
                pair.append(np.multiply.accumulate(p))
        got = _COEF[base] = tuple(pair)
    return got


def window_hashes(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """The hash of each run of ``width`` words; ``which`` picks one of three independent hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    power, inverse = _powers(_BASES[which], len(words))
    with np.errstate(over="ignore"):
        own = mix(words + U64(which * 0x51ED2701)) if which else words
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(own * power[: len(words)], dtype=U64)))
        return mix((sums[width:] - sums[:-width]) * inverse[:n] + U64(width))


# ---------------------------------------------------------------- count-min sketches merged over partitions

BLOCK = 20  # log2 of the cells of a block; blocks are merged independently


class Bits:
    """The cells of a merged sketch whose count reached the threshold, one bit each."""

    def __init__(self, log2_cells: int, depth: int, blocks: dict[int, bytes]):
        self.log2, self.depth = log2_cells, depth
        size = 1 << min(BLOCK, log2_cells)
        self.bits = np.zeros(depth << log2_cells >> 3, np.uint8)
        for b, data in blocks.items():
            self.bits[b * size // 8 : (b + 1) * size // 8] = np.frombuffer(data, np.uint8)

    def reached(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the estimated count (the least over the rows of the sketch) reaches the threshold."""
        out = np.ones(len(hashes), bool)
        for row in range(self.depth):
            c = cells(hashes, self.log2, row)
            out &= (self.bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def cells(hashes: np.ndarray, log2_cells: int, row: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(hashes + U64(0x9E3779B97F4A7C15) * U64(row + 1)) >> U64(64 - log2_cells)
    return h.astype(np.int64) + (row << log2_cells)


def merged_sketch(df: DataFrame, hashes: Callable[[bytes], np.ndarray], log2_cells: int, depth: int, threshold: int) -> Bits:
    """Count ``hashes(text)`` of all rows of the one-column ``df`` in a count-min sketch of ``depth`` rows.

    Each task counts half a million hashes at a time and gives out the cells that they reach, in compressed
    blocks: no task holds a whole sketch. Blocks are summed by key on the cluster, and only one bit a cell,
    "count reached the threshold", comes to the driver: depth * 2**log2_cells / 8 bytes, whatever the input.
    Counts saturate at 255 in each part (so no count under ``threshold`` <= 255 is lost) and are never too small.
    """
    total, size = depth << log2_cells, 1 << min(BLOCK, log2_cells)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count(waiting: list[np.ndarray]) -> pa.RecordBatch:
            every, out = np.concatenate(waiting), ([], [], [])
            for row in range(depth):
                at = np.sort(cells(every, log2_cells, row))
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                at, k = at[first], np.minimum(np.diff(np.append(first, len(at))), 255).astype(np.uint8)
                block = at // size
                for i, j in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(at)).tolist())):
                    gaps = np.diff(at[i:j], prepend=block[i] * size).astype(np.uint32)
                    for c, v in zip(out, (int(block[i]), pa.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True), pa.compress(k[i:j].tobytes(), "zstd", asbytes=True))):
                        c.append(v)
            return pa.RecordBatch.from_pydict({"block": pa.array(out[0], pa.int32()), "gaps": pa.array(out[1], pa.binary()), "counts": pa.array(out[2], pa.binary())})

        waiting, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                if (t := text.as_py()) is not None and len(h := hashes(t.encode())):
                    waiting.append(h)
                    n += len(h)
                    if n > 1 << 19:
                        yield count(waiting)
                        waiting, n = [], 0
        if n:
            yield count(waiting)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, gaps, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                k = np.frombuffer(_decompressed(counts.as_py()), np.uint8)
                at = np.cumsum(np.ascontiguousarray(np.frombuffer(_decompressed(gaps.as_py()), np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.int64)
                if b not in sums:
                    sums[b] = np.zeros(size, np.uint16)
                sums[b][at] = np.minimum(sums[b][at] + k, 60_000)
        for b, s in sums.items():
            bits = np.packbits(s >= threshold).tobytes()
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "data": pa.array([bits], pa.binary())})

    parts = df.mapInArrow(fill, "block int, gaps binary, counts binary")
    merged = parts.repartition(max(1, min(32, total // size)), "block").mapInArrow(merge, "block int, data binary")
    return Bits(log2_cells, depth, {r[0]: bytes(r[1]) for r in merged.toLocalIterator()})


def _decompressed(data: bytes) -> bytes:
    return pa.CompressedInputStream(pa.py_buffer(data), "zstd").read()


def log2_at_least(n: float, low: int, high: int) -> int:
    return min(high, max(low, int(max(1, n) - 1).bit_length()))
