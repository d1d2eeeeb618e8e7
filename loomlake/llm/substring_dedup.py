"""Substring de-duplication: exact repeated word windows behind a count-min prefilter.

First pass: each window has an anchor, the run of ``ANCHOR`` words inside it with the least hash, so equal
windows have equal anchors and a window cannot occur more often than its anchor: the count of the anchor
overestimates that of the window. Anchors are counted in count-min sketches of two rows, one for each
partition, which are merged; the estimates are never too small. Second pass:
only windows whose anchor is estimated to repeat are emitted, as 128-bit hashes, and grouped exactly.
Nothing that repeats is lost; a wrong estimate only costs a row in the second pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomlake.llm.common import distinct, log2_at_least, merged_sketch, small_side, window_hashes, word_hashes, word_spans
from loomlake.session import materialize

ANCHOR = 16
#: Most windows that count as hot.
HOT = 2_000


def anchors(words: np.ndarray, width: int) -> np.ndarray:
    """For each window the place of its anchor: the leftmost of its ``ANCHOR``-word runs with the least hash."""
    runs = window_hashes(words, min(ANCHOR, width), 2)
    span = width - min(ANCHOR, width) + 1  # runs in a window
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # sliding minimum by doubling; ties go to the left
    at, size = np.arange(len(runs)), 1
    while size * 2 <= span:
        a, b = at[: len(at) - size], at[size:]
        at = np.where(runs[b] < runs[a], b, a)
        size *= 2
    if size < span:
        a, b = at[:n], at[span - size : span - size + n]
        at = np.where(runs[b] < runs[a], b, a)
    return at[:n]


def anchor_hashes(data: bytes, width: int) -> np.ndarray:
    words = word_hashes(data)
    at = anchors(words, width)
    return window_hashes(words, min(ANCHOR, width), 2)[distinct(at)] if len(at) else np.empty(0, np.uint64)


def repeated_windows(docs: DataFrame, width: int) -> DataFrame:
    """(id, tag, places): for each row the first words of windows that also start in a row of a smaller id.

    ``docs`` has columns id (not null), tag (tells texts of one id apart) and text (not null).
    """
    spark = docs.sparkSession
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # an anchor about every 18 words, a word being some 6 bytes: 4 cells in each of two rows
    bits = merged_sketch(docs.select("text"), lambda data: anchor_hashes(data, width), log2_at_least(text_bytes * 4 / 108, 16, 28), 2, 2)
    sent = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, names = sent.value, ("id", "tag", "at", "h1", "h2")
        waiting: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*waiting)]
            waiting.clear()
            return pa.RecordBatch.from_pydict(dict(zip(names, map(pa.array, cols))))

        for batch in batches:
            size = 0
            for i, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = word_hashes(text.as_py().encode())
                at = anchors(words, width)
                if not len(at):
                    continue
                own, back = np.unique(at, return_inverse=True)
                hit = cells.reached(window_hashes(words, min(ANCHOR, width), 2)[own])[back]
                places = np.flatnonzero(hit)
                if len(places):
                    h1, h2 = (window_hashes(words, width, k)[places].view(np.int64) for k in (0, 1))
                    waiting.append((np.full(len(places), i), np.full(len(places), tag), places.astype(np.int32), h1, h2))
                    size += len(places)
                    if size > 50_000:
                        yield flush()
                        size = 0
            if waiting:
                yield flush()

    windows = materialize(docs.select("id", "tag", "text").mapInArrow(run, "id long, tag long, at int, h1 long, h2 long"), "windows")
    # partial minima go before the shuffle, so a window of very many texts is a row for each task that has it
    firsts = windows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    firsts = materialize(firsts.select("h1", "h2", "first", "n"), "firsts")
    # a window with more than a 2,000th of all rows is hot: these are under 2,000, and meet their rows without a shuffle
    hot = F.col("n") * HOT > F.lit(windows.count())
    few = F.broadcast(firsts.where(hot).select("h1", "h2", "first"))
    rest = windows.join(few.select("h1", "h2"), ["h1", "h2"], "left_anti").join(firsts.where(~hot).select("h1", "h2", "first"), ["h1", "h2"])
    hits = windows.join(few, ["h1", "h2"]).select("id", "tag", "at", "first").unionByName(rest.select("id", "tag", "at", "first")).where("id > first")
    # a set, as equal rows of one id have the same places, once each already before the shuffle
    return hits.groupBy("id", "tag").agg(F.collect_set("at").alias("places"))


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, and with ``texts`` kept (the words that stay, joined by one space).

    A word goes if a window of ``width`` words that covers it also starts, word for word, in a document of
    smaller id; windows are judged on the input. Null and empty texts have no words. Rows with a null id
    have no order: they lose nothing and take nothing from others. Rows of the same id are one another's
    equals: only smaller ids count. Ids are whole numbers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    known = source.where("id is not null and text is not null")
    # whole copies first: a group of any size is one row for each task that holds some of it
    owner = known.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last").select("digest", "owner")
    copies = known.select("id", "tag", F.sha2("text", 256).alias("digest")).join(owner, "digest").where("id > owner").select("id", "tag").distinct()
    copies = materialize(copies, "copies")
    alone = known.join(small_side(copies), ["id", "tag"], "left_anti")
    places = materialize(repeated_windows(alone, width).withColumn("copy", F.lit(False)).unionByName(copies.select("id", "tag", F.array().cast("array<int>").alias("places"), F.lit(True).alias("copy"))), "places")
    keys = small_side(places.select("id", "tag"))
    touched = source.join(keys, ["id", "tag"], "left_semi").join(places, ["id", "tag"])
    whole = source.join(keys, ["id", "tag"], "left_anti").select("id", "tag", "text", F.lit(None).cast("array<int>").alias("places"), F.lit(False).alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: tuple[list, ...] = ([], [], [], [])
                for text, places, copy in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    data = (text or "").encode()
                    _, a, z = word_spans(data)
                    stay = np.ones(len(a), bool)
                    if copy:
                        stay[:] = len(a) < width
                    elif places:
                        edges = np.zeros(len(a) + 1, np.int64)
                        edges[places] += 1
                        edges[np.array(places) + width] -= 1
                        stay = np.cumsum(edges)[: len(a)] == 0
                    kept = b" ".join([data[x:y] for x, y in zip(a[stay].tolist(), z[stay].tolist())])
                    for c, v in zip(cols, (len(a), len(a) - int(stay.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None)):
                        c.append(v)
                out = {id_col: part.column(0), "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "kept_sha256": pa.array(cols[2], pa.string())}
                yield pa.RecordBatch.from_pydict(out | ({"kept": pa.array(cols[3], pa.string())} if texts else {}))

    rows = touched.select("id", "text", "places", "copy").unionByName(whole.select("id", "text", "places", "copy"))
    return rows.select(F.col("id").cast(kind), "text", "places", "copy").mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
