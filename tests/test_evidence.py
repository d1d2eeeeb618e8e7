"""Audits of traces: output parsing in its modes, tied and rejected candidates, response formats, targets outside the class list."""

import pytest
from pyspark.sql import functions as F

from loomlake.operators import evidence as E, traces as T

BOX = "10,20,110,20,110,90,10,90"


def parsed(spark, texts, mode="pixel", **how):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    expected = how.pop("expected", None)
    out = df.select("i", E.obb_output(F.col("t"), F.lit(200), F.lit(100), F.lit(mode), expected=None if expected is None else F.lit(expected), **how).alias("o")).orderBy("i").select("o.*").collect()
    return [([(p.class_name, p.confidence, [(q.x, q.y) for q in p.points], p.mode) for p in r.predictions], r.parse_ok, r.reason) for r in out]


def test_output_modes(spark):
    corners = [(10.0, 20.0), (110.0, 20.0), (110.0, 90.0), (10.0, 90.0)]
    texts = [f"ship|0.5|{BOX}", f"<think>ship|1,2</think>\nFINAL_DETECTIONS\nboat|{BOX}\n```\nship|{BOX}\nEND_DETECTIONS", f"ship|{BOX}\nsome prose", f"ship|corners {BOX} and 7", f"ship|{BOX.replace('110', '310')}", "ship|1,1,2,1,2,1,1,1", f"cow|{BOX}", "", None]
    loose = parsed(spark, texts)
    assert loose[0] == ([("ship", 0.5, corners, "pixel")], True, None)
    assert loose[1] == ([("ship", 1.0, corners, "pixel")], True, None)  # an alias, and equal predictions once
    assert [r[0] for r in loose[2:3] + loose[5:7]] == [[], [], []] and loose[2][2] == "malformed_prediction_line"
    assert loose[3][0] == [("ship", 1.0, corners, "pixel")]
    assert loose[4][0][0][2][1] == (199.0, 20.0)  # clipped
    assert loose[7] == loose[8] == ([], True, None)
    strict = parsed(spark, texts, strict=True)
    assert [bool(r[0]) for r in strict] == [True, True, False, False, False, False, False, False, False]
    assert [bool(r[0]) for r in parsed(spark, texts, strict=True, confidence=True)] == [True] + [False] * 8
    assert [r[2] for r in parsed(spark, texts, markers=True)][:2] == ["missing_or_duplicated_detection_markers", None]
    assert [bool(r[0]) for r in parsed(spark, texts, expected="plane")] == [False] * 9
    assert parsed(spark, [f"ship|{BOX}\nplane|{BOX}", ""], one=True) == [([], False, "wrong_prediction_count")] * 2
    assert [r[0][0][3] for r in parsed(spark, [f"ship|{BOX}", "ship|0.1,0.2,0.5,0.2,0.5,0.9,0.1,0.9"], mode="auto")] == ["pixel", "normalized_0_1"]
    assert parsed(spark, ["ship|10,20,50,20,50,90,10,90"], mode="normalized_0_100")[0][0][0][2][0] == (20.0, 20.0)


def test_candidates_in_order(spark):
    text = f"obb_8=[{BOX}] then bbox_2d: [1, 2, 30, 40, 50] and Bounding Box [1,2] and corners=[1,2,3]"
    rows = spark.createDataFrame([(text,)], "t string").select(F.inline(E.candidates_of(F.col("t"), F.lit(200), F.lit(100), F.lit("pixel")))).collect()
    assert [(r.kind, [(p.x, p.y) for p in r.points][2]) for r in rows] == [("bbox_2d", (30.0, 40.0)), ("obb_8", (110.0, 90.0))]


def test_best_candidate_of_ties_is_the_first(spark):
    schema = "trace int, task string, class_name string, image_width int, image_height int, coordinate_target string, question string, truth array<struct<x:double,y:double>>, final_answer string, error string, history array<struct<round:int,reasoner:string,perceiver:string>>"
    truth = [(10.0, 20.0), (110.0, 20.0), (110.0, 90.0), (10.0, 90.0)]
    item = lambda i, final, turns, truth=truth: (i, "ref_grounding_obb", "boats", 200, 100, "pixel_obb", "", truth, final, None, [(n, "", p) for n, p in turns])
    box = "bbox_2d=[10,20,110,90]"
    rows = [item(1, "", [(1, box), (2, box)]), item(2, f"ship|{BOX}", [(1, box)]), item(3, "", []), item(4, f"ship|{BOX}", [], None), item(5, f"ship|{BOX}", [(1, None)])]
    df = spark.createDataFrame(rows, schema).withColumn("class_name", F.lit("boat"))
    best = {r.trace: (r.source, r.kind, r.reason) for r in E.score_candidates(E.candidate_rows(df, "trace"), "trace").collect()}
    assert best == {1: ("perceiver_round_1", "bbox_2d", "ok"), 2: ("final_answer", "class_obb_line", "ok"), 3: (None, None, "no_valid_spatial_evidence"), 4: (None, None, "missing_gt_obb"), 5: ("final_answer", "class_obb_line", "ok")}
    told = {r.trace: r.reason.split(":")[0] for r in E.audit_evidence(df, "trace").collect()}
    assert told == {1: "no_parseable_final_obb", 2: "ok", 3: "no_parseable_final_obb", 4: "pred_gt_area_ratio_too_large", 5: "ok"}
    assert {r.trace: r.reason for r in E.audit_evidence(df, "trace", strict=False).collect()}[1] == "ok"


def test_format_of_similar_questions(spark):
    ask = lambda q: f"<thinking>retry</thinking><question>{q}</question>"
    rows = [
        (1, 1, ask("Are there small vehicles in the lower-right area?"), False, False), (1, 2, ask("Are any small vehicles in the lower-right area?"), False, False), (1, 3, ask("What is the target's visible shape?"), False, False),
        (2, 1, ask("Is the target a storage tank?"), False, True), (2, 2, ask("What boundary shape and internal markings are visible on the target?"), False, True), (2, 3, ask("what now") + ask("and now"), False, True),
        (3, 1, None, False, False), (3, 2, "<thinking>x</thinking> [final answer]: ship", True, True), (3, 3, ask("why"), True, True),
    ]
    df = spark.createDataFrame([(*r, "", 5, 5) for r in rows], "trace int, round int, text string, last_round boolean, classification boolean, context string, perception_rounds int, coordinate_rounds int")
    got = {(r.trace, r["round"]): r.status for r in E.format_status(df, "trace").collect()}
    assert got.pop((1, 2)).startswith("duplicate_or_similar_question:")
    assert got == {
        (1, 1): "ok", (1, 3): "ok", (2, 1): "classification_question_reveals_or_asks_class", (2, 2): "ok", (2, 3): "must_contain_exactly_one_question_or_final",
        (3, 1): "missing_thinking", (3, 2): "ok", (3, 3): "last_round_requires_final",
    }


@pytest.mark.parametrize("target,text,denied,many", [("wind.mill", "There is no wind.mill.", True, False), ("wind.mill", "no windmill", False, False), ("wind mill", "Several old wind mills stand.", False, True), (None, "no plane, many planes", False, False), ("plane", "no jet; many jets", True, True)])
def test_targets_outside_the_list_stand_for_themselves(spark, target, text, denied, many):
    df = spark.createDataFrame([(target, text)], "c string, t string")
    assert tuple(df.select(T.denies(F.col("t"), F.col("c")), T.many_instead(F.col("t"), F.col("c"))).first()) == (denied, many)


def test_an_output_is_parsed_once(spark):
    """Values that are used several times are bound, so a plan holds each pattern once."""
    df = spark.createDataFrame([("x",)], "t string")
    of = lambda c: df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    plan = of(E.obb_output(F.col("t"), F.lit(200), F.lit(100), F.lit("pixel"), strict=True, one=True))
    assert plan.count("END_DETECTIONS") == 1 and plan.count("FINAL_ANSWER:") == 1
    assert of(T.claimed_classes(F.col("t"))).count("lower(") == 1


def test_ratios_below_the_threshold_are_only_bounded(monkeypatch):
    pairs = [("plain words", "plain words"), ("plain words", "plane words"), ("abc", "xyz"), ("a" * 30, "a"), ("listen", "silent")]
    full = [T.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    for (a, b), r in zip(pairs, full):
        assert T._ratio(a, b, 0.0) == r
        assert (T._ratio(a, b, 0.82) >= 0.82) == (r >= 0.82)
    monkeypatch.setattr(T, "SequenceMatcher", None)
    assert T._ratio("abc", "xyz", 0.82) == 0.0 and T._ratio("a" * 30, "a", 0.82) < 0.82
