"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are runs of benchmark words. A shift table over blocks of words says how far the search may
jump when a block is seen; blocks that end a pattern have shift 0, and their bucket (by the hash of that
suffix block) lists the patterns to be compared word for word. Words are the symbols, so block and
pattern ends are always word ends, and most positions of a clean text are never looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: ASCII letters and digits (A-Z lower-cased) and all bytes of non-ASCII characters make words; the rest separates.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: Bytes of benchmark text that are searched for in one pass over the documents; more items take more passes.
PASS_BYTES = 32 << 20


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none of a null text."""
    return text.encode().translate(FOLD).split() if text else []


class WuManber:
    """Searches word lists for patterns of at least ``shortest`` words each."""

    def __init__(self, patterns: list[tuple[bytes, ...]], block: int):
        self.m = min(map(len, patterns))
        self.block = min(block, self.m)
        self.far = self.m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list[int]] = {}
        self.patterns = patterns
        for n, p in enumerate(patterns):
            for at in range(self.far):
                key = p[at : at + self.block]
                key = key[0] if self.block == 1 else key
                self.shift[key] = min(self.shift.get(key, self.far), self.far - 1 - at)
            self.buckets.setdefault(key, []).append(n)

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(first word, number of the pattern) of every occurrence, overlapping ones too."""
        found, get, far, size, m = [], self.shift.get, self.far, self.block, self.m
        at, n = m, len(words)  # at: the word after the window that is looked at
        if size == 1:
            key = None
            while at <= n:
                key = words[at - 1]
                s = get(key, far)
                if s:
                    at += s
                    continue
                self._compare(words, at - m, key, found)
                at += 1
            return found
        while at <= n:
            key = tuple(words[at - size : at])
            s = get(key, far)
            if s:
                at += s
                continue
            self._compare(words, at - m, key, found)
            at += 1
        return found

    def _compare(self, words: list[bytes], start: int, key, found: list) -> None:
        for n in self.buckets[key]:
            p = self.patterns[n]
            if tuple(words[start : start + len(p)]) == p:
                found.append((start, n))


class Index:
    """The windows of a set of benchmark items: whole items of fewer than ``width`` words, else runs of ``width``."""

    def __init__(self, items: list[tuple[str, str | None]], width: int, block: int = 3):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = words_of(text)
            for at in range(max(1, len(w) - width + 1) if w else 0):
                owners.setdefault(tuple(w[at : at + width]), set()).add(item)
        self.engines = []
        for lo, hi in ((1, 3), (3, width), (width, width + 1)):  # short patterns would shorten every jump
            if some := [p for p in owners if lo <= len(p) < hi]:
                self.engines.append((WuManber(some, block), [owners[p] for p in some]))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(word spans of all occurrences, items that have one)."""
        spans, items = [], set()
        for engine, owners in self.engines:
            for at, n in engine.find(words):
                spans.append((at, at + len(engine.patterns[n])))
                items |= owners[n]
        return spans, items


def _covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, z in sorted(spans):
        total += max(0, z - max(a, reach))
        reach = max(reach, z)
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of a benchmark window is hit. ``items_sha256`` is the hash of
    the ids of the items found, as sorted strings joined by commas (of nothing where none is).
    Null and empty texts have no words; benchmark rows without words match nothing; a null item id is
    left out; items with equal windows are all found; repeated document rows each give a row. No shuffle
    for a benchmark of up to ``pass_bytes`` bytes, which is broadcast; a larger one is split by item into
    parts of about that size, each searched in its own pass before the next one is sent, and the spans are united by row.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text")).where("item is not null and text is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-size // pass_bytes) or 1
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))

    def search(index) -> DataFrame:
        schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Index(index.value, width)
            for batch in batches:
                rows = []
                for text in batch.column(1):
                    w = words_of(text.as_py())
                    spans, items = own.hits(w)
                    n = _covered(spans)
                    rows.append((len(w), n, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n > 0))
                cols = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
                yield pa.RecordBatch.from_pydict({id_col: batch.column(0)} | {k: pa.array(c, t) for k, c, t in zip(names, cols, kinds)})

        return source.mapInArrow(run, schema)

    def spans_of(index) -> DataFrame:
        schema = "row long, id " + kind + ", n_words long, a array<int>, z array<int>, items array<string>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Index(index.value, width)
            for batch in batches:
                cols: list[list] = [[], [], [], []]
                for text in batch.column(2):
                    w = words_of(text.as_py())
                    spans, items = own.hits(w)
                    for c, v in zip(cols, (len(w), [s[0] for s in spans], [s[1] for s in spans], list(items))):
                        c.append(v)
                yield pa.RecordBatch.from_pydict({"row": batch.column(0), "id": batch.column(1), "n_words": pa.array(cols[0], pa.int64()), "a": pa.array(cols[1], pa.list_(pa.int32())), "z": pa.array(cols[2], pa.list_(pa.int32())), "items": pa.array(cols[3], pa.list_(pa.string()))})

        return numbered.mapInArrow(run, schema)

    def part(k: int):
        rows = bench.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k) if parts > 1 else bench
        return spark.sparkContext.broadcast([tuple(r) for r in rows.toLocalIterator()])

    if parts == 1:
        return search(part(0))
    from loomlake.session import materialize

    numbered = materialize(source.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "decontaminate")
    found = None
    for k in range(parts):  # one part at a time is on the driver and on the executors
        index = part(k)
        one = materialize(spans_of(index), "decontaminate-spans")
        index.destroy()
        found = one if found is None else found.unionByName(one)
    joined = found.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("z")).alias("z"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    ordered = F.array_sort(F.arrays_zip("a", "z"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate(ordered, start, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["z"] - F.greatest(x["a"], s["reach"]))).alias("n"), F.greatest(s["reach"], x["z"]).alias("reach")))["n"]
    return joined.select(F.col("id").alias(id_col), "n_words", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated"))
