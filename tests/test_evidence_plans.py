"""Audits of traces keep all texts in their rows: no step shuffles them, whatever the trace says."""

import pytest
from pyspark.sql import functions as F

from loomlake.operators import evidence as E, geometry as G, traces as T

SCHEMA = "trace int, task string, class_name string, image_width int, image_height int, coordinate_target string, question string, truth array<struct<x:double,y:double>>, final_answer string, error string, history array<struct<round:int,reasoner:string,perceiver:string>>"
TRUTH = [(10.0, 20.0), (110.0, 20.0), (110.0, 90.0), (10.0, 90.0)]


def traces(spark):
    asked = lambda q: f"<question>{q}</question>"
    rows = [(i, "ref_grounding_obb", "ship", 200, 100, "pixel_obb", "", TRUTH, "ship|10,20,110,20,110,90,10,90", None, [(1, asked(a), "bbox_2d=[10,20,110,90]"), (2, asked(b), "none")]) for i, (a, b) in enumerate([("Is it long?", "Is it long?"), ("Is it long?", "What colour has its roof?"), ("What", "What")])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("audit", [E.audit_answer, E.audit_evidence, E.audit_semantics, lambda df, key: E.score_candidates(E.candidate_rows(df, key), key)])
def test_audits_do_not_shuffle(spark, audit):
    df = audit(traces(spark), "trace")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 3


def test_strict_filter_shuffles_each_side_once(spark):
    df = traces(spark)
    raw, inputs = df.select("trace", "final_answer", "error", "history"), df.drop("final_answer", "error", "history")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = E.strict_filter(raw, inputs, "trace", {})._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Join") == 1


def test_repeated_questions_of_a_trace(spark):
    got = {r.trace: r.duplicate_question for r in E.audit_semantics(traces(spark), "trace").collect()}
    assert got == {0: True, 1: False, 2: False}  # a question of stop words alone is like none


def test_response_is_held_against_earlier_rounds_only(spark):
    rows = [(1, 2, "grey roof"), (1, 1, "grey roof"), (1, 3, "wide road"), (2, 1, "grey roof"), (1, 0, None)]
    df = spark.createDataFrame([(k, r, q and f"<thinking>x</thinking><question>{q}</question>", False, False, "", 5, 5) for k, r, q in rows], "trace int, round int, text string, last_round boolean, classification boolean, context string, perception_rounds int, coordinate_rounds int")
    out = E.format_status(df, "trace")
    assert "Join" not in out._jdf.queryExecution().sparkPlan().toString()
    assert {(r.trace, r["round"]): r.status.split(":")[0] for r in out.collect()} == {(1, 0): "missing_thinking", (1, 1): "ok", (1, 2): "duplicate_or_similar_question", (1, 3): "ok", (2, 1): "ok"}


def test_corners_that_round_alike_are_repeated(spark):
    quads = [TRUTH, [(10.0, 20.0), (10.00001, 20.0), (110.0, 90.0), (10.0, 90.0)], [(0.0, 0.0), (0.0011, 0.0), (5.0, 5.0), (0.0, 5.0)], [(0.0, 0.0), (5.0, 5.0), (5.0, 0.0), (0.0, 5.0)], [(float("inf"), 0.0)] * 2 + TRUTH[2:], TRUTH[:3], None]
    df = spark.createDataFrame(list(enumerate(quads)), "i int, p array<struct<x:double,y:double>>")
    assert [r.s for r in df.orderBy("i").select(G.quad_status(F.col("p")).alias("s")).collect()] == ["ok", "repeated_points", "ok", "degenerate_area", "repeated_points", "not_four_points", "ok"]


def test_most_alike_is_symmetric_to_the_pairs(spark):
    df = spark.createDataFrame([("a b c", ["a b c", "x"]), ("a b c d", ["a b c"]), ("", ["a"]), ("a", None)], "w string, e array<string>")
    assert [None if v is None else round(v, 3) for v in (r[0] for r in df.select(T.most_alike(F.col("w"), F.col("e"), 0.7)).collect())] == [1.0, 0.833, None, None]
