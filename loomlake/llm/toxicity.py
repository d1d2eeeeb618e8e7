"""Toxicity by maximum-scoring segments of token log-odds.

Tokens, and the beginnings of tokens, get the log-odds of being in toxic rather than clean documents, with
a Dirichlet prior from the whole sample; only as much of it counts as is certain. Other tokens cost a
little. A linear-time scan finds every maximal segment, and extreme-value statistics of segments in clean
text (Karlin-Altschul: how often such scores turn up by chance in so many tokens) make those of short
and long documents comparable and add up all significant segments of one. A logistic curve on that evidence gives the
score. Statistics and curve are fitted on documents that the log-odds used for them have not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomlake.llm.common import map_rows
from loomlake.session import materialize

TOKEN = re.compile(r"[^\W\d_]+")
#: Labelled documents that the model is fitted on, and rows of them, the first in hash order.
SAMPLE_DOCS = 8_000
#: Parts of the sample, each scored with the log-odds of the others, and segments of a document that are added up at most: more of them could not be told from certainty.
FOLDS, ADDED = 5, 12
#: Lengths of token beginnings that are units like the token itself; a longer token's rare forms share them.
STEMS = (3, 4, 5, 6, 7)
#: Cost of a token without evidence; standard deviations taken off each log-odds; prior counts as a share of the sample, and for a single unit at least.
GAP, CERTAIN, PRIOR_SHARE, LEAST_PRIOR = 0.02, 3.0, 0.06, 1.0
#: Segments with fewer than so many expected by chance are significant passages.
SIGNIFICANT = 0.01


def units(token: str) -> list[str]:
    """The token itself (marked) and its beginnings."""
    return [token + "$", *(token[:n] for n in STEMS if n < len(token))]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), found in one pass over the positive scores.

    Each is a contiguous run that no longer or shorter run improves, and they do not overlap. Tokens
    between positive ones only lower the running sum, so the pass goes from positive to positive.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    lefts, rights = sums[at].tolist(), sums[at + 1].tolist()
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, nearest earlier entry with a lower sum before
    for i, left, right in zip(at.tolist(), lefts, rights):
        first, end, lo, hi = i, i + 1, left, right
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= lo:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= hi:
                stack.append((first, end, lo, hi, j))
                break
            first, lo = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, z, hi - lo) for a, z, lo, hi, _ in stack]


@dataclass
class Model:
    """units: score by unit. lam, k: the extreme-value parameters. a, b: the logistic curve over the evidence."""

    units: dict[str, float]
    lam: float = 1.0
    k: float = 1.0
    a: float = -4.0
    b: float = 1.0

    def token(self, token: str) -> float:
        """The token's score: the most certain of its units' log-odds, or the cost of a token without any."""
        get = self.units.get
        return max((get(u, 0.0) for u in units(token)), default=0.0) or -GAP

    def expected(self, score: np.ndarray | float, n: np.ndarray | float):
        """How many segments of at least ``score`` chance gives in ``n`` clean tokens."""
        return self.k * np.maximum(n, 1) * np.exp(-self.lam * np.maximum(score, 0))

    def evidence(self, scores: list[float], n: int) -> float:
        """Minus log10 of the chance of segments like these in a clean document of ``n`` tokens.

        For the r best segments together the chance is about e^-t t^(r-1) / (r! (r-1)!), t being the sum of their scores in units of chance
        (Karlin and Altschul, 1993); of all r the least chance counts, times 2^r for having tried so many.
        """
        least = -np.log10(max(-np.expm1(-float(self.expected(scores[0] if scores else 0.0, n))), 1e-30))
        t, usual, ways = 0.0, np.log(self.k * max(1, n)), 0.0
        for r, s in enumerate(scores[:ADDED], 1):
            own = self.lam * s - usual
            if own <= 0:
                break
            t, ways = t + own, ways + np.log(r) + np.log(max(1, r - 1))
            if r > 1 and t > r:
                least = max(least, (t - (r - 1) * np.log(t) + ways - r * np.log(2)) / np.log(10))
        return float(min(least, 30.0))

    def chance(self, evidence: np.ndarray):
        return 1 / (1 + np.exp(-(self.a + self.b * evidence)))


class Scorer:
    """Scores texts with a model; token scores are remembered, ``memory`` of them at most."""

    def __init__(self, model: Model, memory: int = 500_000):
        self.model, self.memory, self.known = model, memory, {}

    def tokens(self, text: str) -> np.ndarray:
        found = TOKEN.findall(text.lower())
        get, out = self.known.get, []
        for t in found:
            s = get(t)
            if s is None:
                if len(self.known) >= self.memory:
                    self.known.clear()
                s = self.known[t] = self.model.token(t)
            out.append(s)
        return np.array(out)

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        scores = self.tokens(text)
        return len(scores), maximal_segments(scores)


def best(segments: list[tuple[int, int, float]]) -> list[float]:
    """Scores of the segments that are added up, the best first."""
    return sorted((s for *_, s in segments), reverse=True)[:ADDED]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int) -> DataFrame:
    """(text, y, fold) of at most ``sample_docs`` labelled documents and as many rows; equal rows count once."""
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna()
    named = named.where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).groupBy("id").agg(F.max("y").alias("y"))
    named = materialize(named.orderBy(F.xxhash64("id"), "id").limit(sample_docs), "toxic-labels")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("tag")).where("text is not null").join(F.broadcast(named), "id")
    # an id may stand on any number of rows: keys are counted first, without their texts
    keys = rows.select("id", "tag").distinct().orderBy(F.xxhash64("id"), "id", "tag").limit(sample_docs)
    some = rows.join(F.broadcast(materialize(keys, "toxic-keys")), ["id", "tag"], "left_semi").groupBy("id", "tag").agg(F.first("text").alias("text"), F.first("y").alias("y"))
    return some.select("text", "y", F.pmod("tag", F.lit(FOLDS)).cast("int").alias("fold"))


def _odds(toxic: dict[str, int], clean: dict[str, int], bad: int, good: int) -> dict[str, float]:
    """Scores of the units whose log-odds are certain."""
    scores, strength = {}, max(20.0, PRIOR_SHARE * (bad + good))
    for u, y1 in toxic.items():
        if y1 < max(3, bad // 400):
            continue
        y0 = clean.get(u, 0)
        prior = max(LEAST_PRIOR, strength * (y1 + y0) / (bad + good))
        odds = np.log((y1 + prior) / (bad + strength - y1)) - np.log((y0 + prior) / (good + strength - y0))
        certain = odds - CERTAIN * np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
        if certain > 0:
            scores[u] = round(float(certain), 6)
    return scores


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from at most ``sample_docs`` labelled documents whose crc32(id) mod 5 is not 0.

    Units are counted by documents and fold on the cluster: first in the toxic ones, then, for units found in
    several of these, in the clean ones. Each fold is scored with the log-odds of the others, and that fits statistics and curve; the
    model itself has the log-odds of all. What comes to the driver is bounded by the sample. Without toxic
    or without clean labels no unit has evidence, and every text gets the same low score.
    """
    spark = docs.sparkSession
    some = materialize(_sample(docs, labels, id_col, text_col, label_col, sample_docs), "toxic-sample").repartition(32)
    n = {(r["y"], r["fold"]): r["n"] for r in some.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = (sum(v for (y, _), v in n.items() if y == of) for of in (1, 0))
    if not bad or not good:
        return Model({}, a=-4.0, b=0.0)

    def counted(rows: DataFrame, wanted) -> DataFrame:
        def make():
            keep = wanted.value if wanted else None

            def f(row: dict):
                found = {u for t in set(TOKEN.findall(row["text"].lower())) for u in units(t)}
                return [(u, row["fold"]) for u in (found & keep if keep is not None else found)]

            return f

        each = map_rows(rows.select("text", "fold"), "unit string, fold int", make).groupBy("unit", "fold").agg(F.count(F.lit(1)).alias("n"))
        folds = F.array(*[F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("n"))), F.lit(0)) for k in range(FOLDS)])
        return each.groupBy("unit").agg(F.sum("n").alias("n"), folds.alias("folds"))

    toxic = {r["unit"]: (r["n"], r["folds"]) for r in counted(some.where("y = 1"), None).where(F.col("n") >= max(3, bad // 400)).toLocalIterator()}
    shared = spark.sparkContext.broadcast(frozenset(toxic))
    clean = {r["unit"]: (r["n"], r["folds"]) for r in counted(some.where("y = 0"), shared).toLocalIterator()}
    whole = lambda counts: {u: v for u, (v, _) in counts.items()}
    without = lambda counts, k: {u: v - f[k] for u, (v, f) in counts.items()}
    model = Model(_odds(whole(toxic), whole(clean), bad, good))
    others = [Model(_odds(without(toxic, k), without(clean, k), max(1, bad - n.get((1, k), 0)), max(1, good - n.get((0, k), 0)))) for k in range(FOLDS)]
    sent = spark.sparkContext.broadcast(others)

    def scored():
        scorers = [Scorer(m, 100_000) for m in sent.value]

        def f(row: dict):
            size, segments = scorers[row["fold"]].segments(row["text"])
            return [(best(segments), size, row["y"])]

        return f

    def found():
        scorers = [Scorer(m, 100_000) for m in sent.value]

        def f(row: dict):
            values, counts = np.unique(np.round(scorers[row["fold"]].tokens(row["text"]), 3), return_counts=True)
            return [(float(v), int(c)) for v, c in zip(values, counts) if v > 0]

        return f

    rows = sorted((list(r["best"]), r["n"], r["y"]) for r in map_rows(some, "best array<double>, n long, y int", scored).toLocalIterator())
    hits = {r["v"]: r["n"] for r in map_rows(some.where("y = 0"), "v double, n long", found).groupBy("v").agg(F.sum("n").alias("n")).toLocalIterator()}
    _calibrate(model, rows, hits)
    return model


def _calibrate(model: Model, rows: list[tuple[list[float], int, int]], hits: dict[float, int]) -> None:
    """lam: where the mean of exp(lam * score) of a clean token is 1. k: most likely given clean documents' best segments.

    ``rows``: (best scores, tokens, label) of each document, ``hits``: how often clean documents' tokens have each positive score.
    """
    y = np.array([r[2] for r in rows], float)
    top, size = np.array([max(r[0], default=0.0) for r in rows]), np.array([r[1] for r in rows], float)
    clean = y == 0
    tokens = max(1.0, size[clean].sum())
    hits = dict(hits)
    most = max(model.units.values(), default=1.0)
    hits[most] = hits.get(most, 0) + 1  # one more, so that none is impossible
    values, counts = (np.array(x, float) for x in zip(*sorted(hits.items())))
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        with np.errstate(over="ignore"):
            mean = ((tokens - counts.sum()) * np.exp(-mid * GAP) + (counts * np.exp(mid * values)).sum()) / tokens
        low, high = (mid, high) if mean < 1 else (low, mid)
    model.lam = low
    model.k = float(((top[clean] > 0).sum() + 0.5) / max(1e-9, (size[clean] * np.exp(-model.lam * top[clean])).sum()))
    x = np.array([model.evidence(r[0], r[1]) for r in rows])
    a, b = -3.0, 1.0
    for _ in range(100):  # Newton steps with a small ridge: the classes may be separable
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p)
        g = np.array([(p - y).sum(), ((p - y) * x).sum() + 0.1 * b])
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.1]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.a, model.b = float(a), float(max(0.0, b))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: Model | None = None) -> DataFrame:
    """One row per document: id, held_out, score, predicted, n_tokens, passages.

    ``score`` is 0 to 1, ``predicted`` 1 if it is at least 0.5; ``held_out`` says that crc32(id) mod 5 is 0,
    so the row was no training row. ``passages`` are the significant segments: first and end token, score
    and how many such chance gives. Null and empty texts have no tokens and the lowest score. A null id
    is not held out. Repeated rows stay. One pass over whole texts without a shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels, id_col, text_col, label_col))
    kind = docs.schema[id_col].dataType.simpleString()
    passage = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, m = Scorer(sent.value), sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                evidence, size, passages = [], [], []
                for text in part.column(2):
                    n, segments = scorer.segments(text.as_py() or "")
                    evidence.append(m.evidence(best(segments), n))
                    size.append(n)
                    passages.append([{"first": a, "end": z, "score": x, "expected": ex} for a, z, x in segments if (ex := float(m.expected(x, n))) < SIGNIFICANT])
                score = m.chance(np.array(evidence))
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "held_out": part.column(1), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32)), "n_tokens": pa.array(size, pa.int64()), "passages": pa.array(passages, pa.list_(passage))})

    ids = F.col(f"`{id_col}`")
    held = F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")
    schema = f"`{id_col}` {kind}, held_out boolean, score double, predicted int, n_tokens long, passages array<struct<first:int,end:int,score:double,expected:double>>"
    return docs.select(ids, held, F.col(f"`{text_col}`")).mapInArrow(run, schema)
