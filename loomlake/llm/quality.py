"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from one pass over whole texts. The trees are fitted on a bounded labelled sample with
histograms of the features' quantiles; on chosen features the score may only fall as the feature grows.
All trees are flattened into node arrays, and a batch of documents goes down all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomlake.llm.common import window_hashes, word_hashes
from loomlake.session import materialize

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share", "words_per_line", "pipe_share"]
#: -1: more of it never raises the score. 0: free.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "pipe_share": -1}
#: Labelled rows that the trees are fitted on, the first of them in hash order.
SAMPLE_ROWS = 20_000


def statistics(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features); all 0 for a null or empty text."""
    text = text or ""
    data = text.encode()
    hashes = word_hashes(data)
    n = len(hashes)
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    count = lambda some: int(bytes_of[list(some.encode())].sum())
    chars = int(bytes_of.sum() - bytes_of[0x80:0xC0].sum()) - count(SPACE)  # code points
    symbols = count(SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dups = len(lines) - len(set(lines))
    windows = window_hashes(hashes, 3)
    repeats = 0
    if len(windows):
        _, at, k = np.unique(windows, return_inverse=True, return_counts=True)
        edges = np.zeros(n + 1, np.int64)
        first = np.flatnonzero(k[at] > 1)
        np.add.at(edges, first, 1)
        np.add.at(edges, first + 3, -1)
        repeats = int((np.cumsum(edges)[:n] > 0).sum())
    per, rows = max(1, n), max(1, len(lines))
    letters = max(1, chars)
    upper, digits, marks = int(bytes_of[65:91].sum()) / letters, count("0123456789"), count("!?.,;:")
    feats = [np.log1p(n), chars / per, symbols / letters, dups / rows, repeats / per, len(np.unique(hashes)) / per, upper, digits / letters, marks / letters, n / rows, count("|") / per]
    return n, chars, symbols, dups, repeats, [float(x) for x in feats]


class Trees:
    """Boosted trees as flat arrays: feature (-1: leaf), threshold, left, right, value, and the root of each tree."""

    def __init__(self) -> None:
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = [], [], [], [], [], []
        self.base, self.depth = 0.0, 0

    def node(self) -> int:
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            a.append(v)
        return len(self.feature) - 1

    def freeze(self) -> Trees:
        self.feature, self.left, self.right, self.roots = (np.array(a, np.int64) for a in (self.feature, self.left, self.right, self.roots))
        self.threshold, self.value = np.array(self.threshold), np.array(self.value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 of each row of ``x``: every row goes down all trees in ``depth`` array steps."""
        total = np.full(len(x), self.base)
        if len(self.roots) and len(x):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                f = self.feature[at]
                low = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at = np.where(f < 0, at, np.where(low, self.left[at], self.right[at]))
            total = total + self.value[at].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 5.0, least: int = 5) -> Trees:
    """Second-order boosting of the log loss. A monotone feature's split is taken only if its two leaves are in
    order, and below it each side keeps to its side of their middle, so the order holds in the whole tree."""
    out = Trees()
    if not len(y):
        return out.freeze()
    mean = min(1 - 1e-3, max(1e-3, y.mean()))
    out.base, out.depth = float(np.log(mean / (1 - mean))), depth
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    total = np.full(len(y), out.base)

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + ridge), lo, hi))

    def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
        me = out.node()
        g, h = grad[rows], hess[rows]
        gs, hs = g.sum(), h.sum()
        best = (1e-6, -1, 0)
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g, len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h, len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                wl, wr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(gs - gl) / (hs - hl + ridge), lo, hi)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                ok = (nl >= least) & (len(rows) - nl >= least)
                if monotone[j]:
                    ok &= (wr - wl) * monotone[j] >= 0
                gain = np.where(ok, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(wl[k]), float(wr[k]))
        if best[1] < 0:
            out.value[me] = rate * leaf(gs, hs, lo, hi)
            total[rows] += out.value[me]
            return me
        _, j, k, wl, wr = best
        out.feature[me], out.threshold[me] = j, float(edges[j][k])
        low = binned[rows, j] <= k
        mid, m = (wl + wr) / 2, monotone[j]
        out.left[me] = grow(rows[low], level + 1, mid if m < 0 else lo, mid if m > 0 else hi)
        out.right[me] = grow(rows[~low], level + 1, mid if m > 0 else lo, mid if m < 0 else hi)
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        out.roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    return out.freeze()


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py())[5] for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "features": pa.array(rows, pa.list_(pa.float64()))})

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, features array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most ``sample_rows`` labelled rows, the first in hash order, whose crc32(id) mod 5 is not 0.

    Rows with a null id or label are left out, an id with several labels counts once with the largest, equal rows count once.
    Only the sample's statistics come to the driver.
    """
    named = labels.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").cast("double").alias("__y")).dropna()
    named = named.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0).groupBy(id_col).agg(F.max("__y").alias("__y"))
    named = named.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    named = materialize(named, "quality-labels")
    text = F.col(f"`{text_col}`")
    some = docs.select(F.col(f"`{id_col}`").alias(id_col), text.alias("__text"), F.xxhash64(text).alias("__tag")).join(F.broadcast(named.select(id_col)), id_col, "left_semi")
    # an id may stand on any number of rows: keys are counted first, without their texts
    keys = materialize(some.select(id_col, "__tag").distinct().orderBy(F.xxhash64(id_col), id_col, "__tag").limit(sample_rows), "quality-keys")
    some = some.join(F.broadcast(keys), [id_col, "__tag"], "left_semi").groupBy(id_col, "__tag").agg(F.first("__text").alias("__text")).drop("__tag")
    rows = features(some, id_col, "__text").join(F.broadcast(named), id_col).select("features", "__y").toLocalIterator()
    data = sorted((tuple(r[0]), r[1]) for r in rows)  # the same model whatever the order of rows
    x, y = np.array([r[0] for r in data]).reshape(-1, len(FEATURES)), np.array([r[1] for r in data])
    return fit(x, y, [MONOTONE.get(f, 0) for f in FEATURES])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    base_failed: under 50 words, or over half of the words in 3-word windows found twice or more. ``kept``
    is false if base_failed, else whether the trees' chance of good quality is at least 0.5. A null text
    has no words and fails. Without labelled rows the trees are empty and give 0.5: all that pass the base
    rules are kept. Repeated rows stay; one pass over whole texts, no shuffle of them.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [statistics(t.as_py()) for t in part.column(1)]
                score = model.value.score(np.array([r[5] for r in rows]))
                base = np.array([r[:5] for r in rows], np.int64)
                failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
                names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
                yield pa.RecordBatch.from_pydict({id_col: part.column(0)} | {k: pa.array(base[:, i]) for i, k in enumerate(names)} | {"base_failed": pa.array(failed), "kept": pa.array(~failed & (score >= 0.5)), "score": pa.array(score)})

    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
