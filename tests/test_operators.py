"""Golden values and properties of operators that SQL does not express."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomlake.operators import conversations as C, geometry as G, metrics as M, rollouts as R, sampling as S, tokens as K, traces as T


def quad(rng):
    cx, cy, w, h, a = rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(5, 50), rng.uniform(5, 50), rng.choice([0, math.pi / 2, rng.uniform(0, 6)])
    return [(cx + math.cos(a) * x * w / 2 - math.sin(a) * y * h / 2, cy + math.sin(a) * x * w / 2 + math.cos(a) * y * h / 2) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def area(p):
    return sum(p[k][0] * p[(k + 1) % len(p)][1] - p[(k + 1) % len(p)][0] * p[k][1] for k in range(len(p))) / 2 if len(p) > 2 else 0


def clipped_iou(p, q):
    q = q if area(q) > 0 else q[::-1]
    out = p
    for k in range(4):
        a, b = q[k], q[(k + 1) % 4]
        side = lambda v: (b[0] - a[0]) * (v[1] - a[1]) - (b[1] - a[1]) * (v[0] - a[0])  # noqa: B023, E731
        new = []
        for j in range(len(out)):
            u, v = out[j - 1], out[j]
            if (side(u) >= 0) != (side(v) >= 0):
                t = side(u) / (side(u) - side(v))
                new.append((u[0] + (v[0] - u[0]) * t, u[1] + (v[1] - u[1]) * t))
            if side(v) >= 0:
                new.append(v)
        out = new
    both = abs(area(out))
    return both / (abs(area(p)) + abs(area(q)) - both)


def test_obb_iou_equals_clipping(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        a = quad(rng)
        rows.append((i, a, a if i % 6 == 0 else quad(rng)))
    as_points = lambda p: [{"x": x, "y": y} for x, y in p]
    kind = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(i, as_points(a), as_points(b)) for i, a, b in rows], f"i int, a {kind}, b {kind}")
    got = {r.i: r.iou for r in G.with_obb_iou(df, "a", "b").collect()}
    for i, a, b in rows:
        assert got[i] == pytest.approx(clipped_iou(a, b), abs=1e-9)


def test_split_rois(spark):
    df = spark.range(95).select(F.lit("a").alias("k"), F.col("id").alias("object_index"), (F.col("id") * 10).cast("double").alias("cx"), F.col("id").cast("double").alias("cy"))
    groups = [r["count"] for r in G.split_rois(df, ["k"], 40).groupBy("roi").count().collect()]
    assert len(groups) >= 3 and max(groups) <= 40 and sum(groups) == 95


def test_split_rois_makes_disjoint_regions_or_fails(spark):
    import random

    rng = random.Random(3)
    rows = [("a", i, float(rng.randrange(60)), rng.random() * 60) for i in range(200)] + [("b", i, 5.0, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, object_index int, cx double, cy double")
    out = G.split_rois(df, ["k"], 7, 60, 60).collect()
    assert len(out) == 250
    boxes = {(r.k, r.roi): (r.rx1, r.ry1, r.rx2, r.ry2) for r in out}
    for r in out:
        x1, y1, x2, y2 = boxes[r.k, r.roi]
        assert x1 <= r.cx <= x2 and y1 <= r.cy <= y2
    for k in "ab":
        mine = [v for (q, _), v in boxes.items() if q == k]
        assert sum((x2 - x1) * (y2 - y1) for x1, y1, x2, y2 in mine) == pytest.approx(3600)  # they tile the image
        assert max(sum(r.k == k and r.roi == i for r in out) for (q, i) in boxes if q == k) <= 7
    same = spark.createDataFrame([("a", i, 1.0, 2.0) for i in range(5)], "k string, object_index int, cx double, cy double")
    with pytest.raises(Exception, match="share a centre"):
        G.split_rois(same, ["k"], 2).collect()
    assert {r.roi for r in G.split_rois(same, ["k"], 2, inseparable="keep").collect()} == {1}


def test_thresholds_that_nothing_reaches_count(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.9, 0, 0.62)], "image_id int, class_id int, pred long, confidence double, gt long, iou double")
    preds, truths = pairs.select("image_id", "class_id", "pred", "confidence"), pairs.select("image_id", "class_id", "gt")
    levels = [x / 100 for x in range(50, 100, 5)]
    got = {(r.class_id, r.threshold): r.ap for r in M.detection_ap(pairs, preds, truths, ["image_id", "class_id"], "class_id", levels).collect()}
    assert [got[0, t] for t in levels] == [1.0] * 3 + [0.0] * 7 and got[None, None] == got[0, None] == pytest.approx(0.3)
    queries = spark.createDataFrame([("a", 1, 2), ("b", 0, 0)], "query string, n_pred long, n_gt long")
    rows = M.detection_summary(pairs.where("iou > 1").selectExpr("'a' as query", "pred", "gt", "iou"), queries, "query", [0.5, 0.7]).collect()
    assert [tuple(r) for r in rows] == [(t, 0, 0.0, 0.0, 0.0, 0.0, 1.0) for t in (0.5, 0.7)]


def test_label_file_example(spark):
    """Three boxes, one with a corner left of the image: two are valid."""
    box = lambda x: [{"x": x, "y": 10.0}, {"x": x + 50, "y": 10.0}, {"x": x + 50, "y": 60.0}, {"x": x, "y": 60.0}]
    df = spark.createDataFrame([(i, box(x), 512, 512) for i, x in enumerate([20.0, 100.0, -51.0])], "i int, points array<struct<x:double,y:double>>, image_width int, image_height int")
    actions = [r.action for r in G.sanitize(df).orderBy("i").collect()]
    assert actions == ["keep", "keep", "drop"]


@pytest.mark.parametrize("source, target, cutoff, want", [(3000, 2000, 1000, (600, 400)), (2000, 3000, 1000, (400, 600)), (1000, 100, 1000, (900, 100)), (100, 1000, 1000, (100, 900)), (100, 500, 1000, (100, 500)), (500, 100, 1000, (500, 100)), (10, 10, 1000, (10, 10))])
def test_infer_seqlen(spark, source, target, cutoff, want):
    s, t = K.infer_seqlen(F.lit(source), F.lit(target), cutoff)
    assert tuple(spark.range(1).select(s, t).first()) == want


def test_mask_labels(spark):
    df = spark.createDataFrame([([{"source": [1, 2], "target": [3]}, {"source": [4], "target": [5, 6]}],)], "p array<struct<source:array<int>,target:array<int>>>")
    r = K.mask_labels(df, "p", 100).first()
    assert (r.input_ids, r.labels) == ([1, 2, 3, 4, 5, 6], [-100, -100, 3, -100, 5, 6])
    r = K.mask_labels(df, "p", 100, mask_history=True).first()
    assert (r.input_ids, r.labels) == ([1, 2, 3, 4, 5, 6], [-100, -100, -100, -100, 5, 6])


def test_pack_knapsack(spark):
    rng = random.Random(1)
    sizes = [rng.randint(1, 120) for _ in range(200)]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(sizes)], "b int, k int, n int")
    rows = K.pack_knapsack(df, "b", "k", "n", 100).collect()
    assert sorted(r.k for r in rows) == [i for i, n in enumerate(sizes) if n <= 100]
    filled = {}
    for r in rows:
        filled[r.pack] = filled.get(r.pack, 0) + sizes[r.k]
    assert max(filled.values()) <= 100


def test_greedy_match_and_ap(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.9, 0, 0.6), (1, 0, 0, 0.9, 1, 0.8), (1, 0, 1, 0.8, 1, 0.9), (1, 0, 1, 0.8, 0, 0.55)], "image_id int, class_id int, pred long, confidence double, gt long, iou double")
    m = {(r.pred, r.gt) for r in M.greedy_match(pairs, ["image_id", "class_id"]).collect()}
    assert m == {(0, 1), (1, 0)}
    preds = pairs.select("image_id", "class_id", "pred", "confidence").distinct()
    truths = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "image_id int, class_id int, gt long")
    some = M.greedy_match(pairs, ["image_id", "class_id"]).withColumn("threshold", F.lit(0.5))
    ap = M.average_precision(preds, truths, some, ["image_id", "class_id"], "class_id").first().ap
    assert ap == pytest.approx(1.0)


def test_detection_ap_and_summary_against_loops(spark):
    import random

    rng = random.Random(4)
    truths, preds, iou = [], [], {}
    for image in range(12):
        for cls in range(3):
            gts, ps = range(rng.randint(0, 5)), range(rng.randint(0, 5))
            truths += [(image, cls, g) for g in gts]
            preds += [(image, cls, p, rng.randrange(50) / 50) for p in ps]
            iou |= {(image, cls, p, g): rng.random() for p in ps for g in gts if rng.random() < 0.7}
    conf = {x[:3]: x[3] for x in preds}
    pairs = spark.createDataFrame([(i, c, p, conf[i, c, p], g, v) for (i, c, p, g), v in iou.items()], "image_id int, class_id int, pred long, confidence double, gt long, iou double")
    p, t = spark.createDataFrame(preds, "image_id int, class_id int, pred long, confidence double"), spark.createDataFrame(truths, "image_id int, class_id int, gt long")
    got = {(r.class_id, r.threshold): r.ap for r in M.detection_ap(pairs, p, t, ["image_id", "class_id"], "class_id", [0.5, 0.75]).collect()}

    def ap(cls, least):
        used, hits, n, points = set(), 0, 0, []
        for i, _, k, _ in sorted((x for x in preds if x[1] == cls), key=lambda x: (-x[3], x[0], x[2])):
            n += 1
            best = max(((iou.get((i, cls, k, g), 0), g) for (j, c, g) in truths if (j, c) == (i, cls) and (i, g) not in used), default=(0, None))
            if best[0] >= least:
                used.add((i, best[1]))
                hits += 1
            points.append((hits / sum(x[1] == cls for x in truths), hits / n))
        return sum(max((q for r, q in points if r >= k / 100 - 1e-12), default=0) for k in range(101)) / 101

    for cls in range(3):
        for least in (0.5, 0.75):
            assert got[cls, least] == pytest.approx(ap(cls, least))
    assert got[None, 0.5] == pytest.approx(sum(got[c, 0.5] for c in range(3)) / 3)
    # the summary: one query for each image and class
    queries = {}
    for i, c, *_ in preds:
        queries.setdefault((i, c), [0, 0])[0] += 1
    for i, c, _ in truths:
        queries.setdefault((i, c), [0, 0])[1] += 1
    ious = []
    for (i, c), (_, n) in queries.items():
        up, ug = set(), set()
        for v, k, g in sorted(((v, k, g) for (j, d, k, g), v in iou.items() if (j, d) == (i, c)), reverse=True):
            if k not in up and g not in ug:
                up.add(k), ug.add(g), ious.append(v)
    df = spark.createDataFrame([(f"{i}#{c}", a, b) for (i, c), (a, b) in queries.items()], "query string, n_pred long, n_gt long")
    row = M.detection_summary(pairs.selectExpr("concat(image_id, '#', class_id) as query", "pred", "gt", "iou"), df, "query", [0.5]).first()
    tp = sum(v >= 0.5 for v in ious)
    assert (row.matches, row.precision, row.recall) == (tp, pytest.approx(tp / len(preds)), pytest.approx(tp / len(truths)))
    assert row.mean_iou == pytest.approx(sum(ious) / len(truths))
    negative = [a == 0 for a, b in queries.values() if b == 0]
    assert row.negative_accuracy == pytest.approx(sum(negative) / len(negative))


def test_balance_shards(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 97).alias("length"))
    rows = R.balance_shards(df, 4, block=1).groupBy("shard").agg(F.count("*").alias("n"), F.sum("length").alias("t")).collect()
    assert sum(r.n for r in rows) == 1000 and max(r.n for r in rows) - min(r.n for r in rows) <= 1
    assert max(r.t for r in rows) - min(r.t for r in rows) <= 97


@pytest.mark.parametrize("n", [0, 3, 1003])
def test_balance_shards_at_the_defaults(spark, n):
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 97).alias("length"))
    rows = R.balance_shards(df, 4).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(4)]
    tokens = [sum(r.length for r in rows if r.shard == s) for s in range(4)]
    assert sorted(r.row_id for r in rows) == list(range(n)) and max(sizes) - min(sizes) <= 1
    assert max(tokens) - min(tokens) <= 97


def test_smoothed_in_blocks(spark):
    """Long, short and null keys against the recurrence; no row or task holds a whole series."""
    rng = random.Random(4)
    series = {"a": [rng.uniform(-9, 9) for _ in range(3000)], "b": [5.0], None: [rng.uniform(0, 1) for _ in range(300)], "n": [1.0, None] + [2.0] * 20_000}
    rows = [(k, i, v) for k, x in series.items() for i, v in enumerate(x)]
    rng.shuffle(rows)
    out = R.smoothed(spark.createDataFrame(rows, "k string, s long, v double"), "k", "s", "v")
    got = {(r.k, r.s): r.smoothed for r in out.collect()}
    assert len(got) == len(rows)
    for k, x in series.items():
        w, y = 1.8 * (1 / (1 + math.exp(-0.05 * len(x))) - 0.5), x[0]
        for i, v in enumerate(x):
            y = None if y is None or v is None else y * w + (1 - w) * v
            assert got[k, i] == (None if y is None else pytest.approx(y, abs=1e-12))


def test_smoothed_collects_blocks_only(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 10)
    monkeypatch.setattr(R, "BACK", 1000)
    sizes = []
    keep = R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name: (out := keep(df, name), sizes.append(out.agg(F.max(F.size("x"))).first()[0]))[0])
    R.smoothed(spark.range(95).selectExpr("1 as k", "id as s", "id as v"), "k", "s", "v").count()
    assert sizes and max(sizes) <= 10


def test_tool_calls(spark):
    texts = ['Action: f\nAction Input: {"a": 1}', '<tool_call>\n{"name": "g", "arguments": {"b": 2}}\n</tool_call>', "Action: f\nAction Input: {bad", "hello"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [[(c.name, c.arguments) for c in r.c] for r in df.orderBy("i").select(C.tool_calls(F.col("t")).alias("c")).collect()]
    assert got == [[("f", '{"a": 1}')], [("g", '{"b":2}')], [], []]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "uid int, score double, row_id long, length int")
    assert R.grpo(none).count() == 0 and R.micro_batches(none, 10).count() == 0
    assert S.exact_n(none, 5, "row_id").count() == 0


def test_similar_questions_against_a_loop(spark):
    from difflib import SequenceMatcher

    rng = random.Random(2)
    words = ["shape", "of", "the", "roof", "colour", "is", "wing", "what", "long", "tail"]
    rows = [(t, k, " ".join(rng.choices(words, k=rng.randint(0, 5)))) for t in range(20) for k in range(6)]
    got = {(r.trace, r.right): (r.left, round(r.similarity, 9)) for r in T.similar_questions(spark.createDataFrame(rows, "trace int, k int, q string"), "trace", "k", "q", 0.8).collect()}
    want, text = {}, {(t, k): [w for w in q.split() if w not in T.STOPWORDS] for t, k, q in rows}
    for t in range(20):
        for k in range(6):
            for j in range(k):
                a, b = text[t, j], text[t, k]
                if a and b:
                    score = max(SequenceMatcher(None, " ".join(a), " ".join(b)).ratio(), len({*a} & {*b}) / len({*a} | {*b}))
                    if score >= 0.8:
                        want[t, k] = (j, round(score, 9))
                        break
    assert got == want and want


def test_claims_need_no_negation_before(spark):
    texts = ["The object is a ship.", "There is no doubt: not the object is a ship.", "No, the target appears to be a truck or it is a harbor.", "a scene without much to see at all; then the object is a car"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [sorted(r[0]) for r in df.select(T.claimed_classes(F.col("t"))).collect()] == [["ship"], [], [], ["small vehicle"]]


def test_answers_and_numerals(spark):
    from loomlake.operators import rewards, rules

    told = {"x = \\frac12": "\\frac{1}{2}", "\\boxed{1,234} dollars": "1234", "1,234": "1234", "so $a b$ it": "b", "\\sqrt3": "\\sqrt{3}", "": "", "\\text{red fish}": "redfish"}
    df = spark.createDataFrame([(k, v) for k, v in told.items()] + [(None, None)], "a string, b string")
    assert df.where(~rewards.normal_answer(F.col("a")).eqNullSafe(F.col("b"))).count() == 0
    rows = [("a", "Answer: 3\nAnswer: 4", "4", 10), ("b", "no", "4", 150), ("c", None, "4", 201), ("d", "Answer: 4", None, 200)]
    out = rewards.answer_reward(spark.createDataFrame(rows, "k string, r string, t string, n int"), "r", "t", "n", 200, 100, 0.5).orderBy("k").collect()
    assert [(r.accuracy, r.overlong, r.overall) for r in out] == [(1, 0, 1), (-1, -0.5, -1.25), (-1, -1, -1.5), (-1, -1, -1.5)]
    wrong = {"10": "12", "0": "1", "-3": "-2", "2.50": "3.00", "1.5e3": "1.8e+03", "none": None, "": None, None: None, "0.0": "1.0"}
    df = spark.createDataFrame(list(wrong.items()), "a string, b string")
    assert [r for r in df.select("a", "b", rules.perturb_number(F.col("a"), F.lit(True)).alias("c")).collect() if r.b != r.c] == []


def test_diagnose_empty_and_wrong_classes(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id int")
    preds = spark.createDataFrame([(1, 0), (2, 0)], "image_id int, pred int")
    truths = spark.createDataFrame([(1, 0), (2, 0)], "image_id int, gt int")
    both = spark.createDataFrame([(1, 0, 0.9, False), (2, 0, 0.7, False)], "image_id int, pred int, iou double, same_class boolean")
    r = M.diagnose(images, preds, truths, both).first()
    assert (r.rows, r.pred_total, r.gt_total, r.rows_no_predictions, r.mean_best_iou_same_class, r.causes) == (2, 2, 2, 0, 0, ["class_names_wrong"])
    assert M.diagnose(images, preds.limit(0), truths, both.limit(0)).first().causes == ["no_parsed_predictions", "most_images_without_predictions"]
