"""Label masks with an end token and packed rows against loops; cumulative counts with ties."""

import random

import pytest
from pyspark.sql import functions as F

from loomlake.operators import metrics as M, tokens as K


def fitted(s, t, c):
    most = c if t * 2 < c else c - s if s * 2 < c else int(c * (t / (s + t)))
    t2 = min(most, t)
    return min(max(c - t2, 0), s), t2


@pytest.mark.parametrize("history", [False, True])
def test_masks_with_an_end_token(spark, history):
    rng = random.Random(5)
    rows = [(i, [(list(range(100, 100 + rng.randrange(0, 9))), list(range(200, 200 + rng.randrange(1, 9)))) for _ in range(rng.randrange(1, 5))]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, pairs array<struct<source:array<int>,target:array<int>>>")
    got = {r.i: (r.input_ids, r.labels) for r in K.mask_labels(df, "pairs", 24, mask_history=history, eos=2).collect()}
    for i, pairs in rows:
        ids, labels, used = [], [], 1
        for turn, (src, tgt) in enumerate(reversed(pairs) if history else pairs):
            if used >= 24:
                break
            s, t = fitted(len(src), len(tgt), 24 - used)
            used += s + t
            own = ([2] + [K.IGNORE] * (s - 1) if turn and s else [K.IGNORE] * s) + ([K.IGNORE] * t if history and turn else tgt[:t])
            ids, labels = (src[:s] + tgt[:t] + ids, own + labels) if history else (ids + src[:s] + tgt[:t], labels + own)
        assert got[i] == (ids + [2], labels + [2])


def test_packed_rows(spark):
    rng = random.Random(2)
    rows = [(i % 3, i, list(range(i * 100, i * 100 + rng.randrange(1, 12)))) for i in range(40)] + [(0, 99, list(range(30)))]
    df = spark.createDataFrame([(*r, len(r[2])) for r in rows], "b int, k int, ids array<int>, n int")
    packs = K.pack_knapsack(df, "b", "k", "n", 16)
    seen = []
    for r in K.packed_rows(packs, df, "b", "k", "ids", 16, pad=-1).collect():
        assert len(r.input_ids) == len(r.attention_mask) == len(r.position_ids) == 16
        for n in range(1, max(r.attention_mask) + 1):
            own = [j for j, m in enumerate(r.attention_mask) if m == n]
            assert [r.position_ids[j] for j in own] == list(range(len(own)))
            seen.append((r.b, [r.input_ids[j] for j in own]))
        assert all(r.input_ids[j] == -1 and r.position_ids[j] == 0 for j, m in enumerate(r.attention_mask) if not m)
    assert sorted(seen) == sorted((b, ids) for b, _, ids in rows if len(ids) <= 16)


def test_counts_down_the_confidences(spark):
    preds = spark.createDataFrame([("a", 1, 0.9, True), ("a", 2, 0.9, False), ("a", 3, 0.5, None), ("a", 4, 0.4, True), ("b", 5, 0.1, False)], "c string, k int, p double, h boolean")
    totals = spark.createDataFrame([("a", 4)], "c string, total long")
    got = {r.k: (r.tp, r.fp, r.precision, r.recall) for r in M.cumulative_counts(preds, "c", "p", "h", ["k"], totals).collect()}
    assert got == {1: (1, 0, 1.0, 0.25), 2: (1, 1, 0.5, 0.25), 3: (1, 2, pytest.approx(1 / 3), 0.25), 4: (2, 2, 0.5, 0.5), 5: (0, 1, 0.0, 0.0)}


def test_pad_and_cut_sides(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([4, 5, 6, 7, 8],)], "x array<int>")
    got = lambda **how: [r[0] for r in df.select(K.pad_truncate(F.col("x"), 4, 0, **how)).collect()]
    assert got() == [[1, 2, 3, 0], [4, 5, 6, 7]] and got(side="left") == [[0, 1, 2, 3], [5, 6, 7, 8]]
    assert got(side="left", cut="right") == [[0, 1, 2, 3], [4, 5, 6, 7]] and got(cut="left") == [[1, 2, 3, 0], [5, 6, 7, 8]]
    with pytest.raises(Exception, match="more than 4 tokens: 5"):
        got(cut="error")
    with pytest.raises(ValueError):
        got(side="middle")
