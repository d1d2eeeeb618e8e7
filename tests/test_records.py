"""Records, reports, rewards and drawn mixtures beyond their queries."""

import pytest
from pyspark.sql import functions as F

from loomlake.operators import records as R, rewards as W, sampling as S


def told(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_boxes_of_responses(spark):
    five = ["<think>a</think> {\"bbox\": [9, 8, 1200, 3]} {\"bbox\": [1,1,2,2]}", "</think> [1,2] [5,6,7,8,9]", "</think> answer: none", "x</ Think > bbox: [1, 2, 3, 4000] [1,2,3,4]", None]
    get = lambda style: [r and (r.box, r.fallback) for r in told(spark, lambda t: W.response_box(W.tight(t), style), *five)]
    assert get("json") == [([9.0, 8.0, 1200.0, 3.0], False)] + [(None, False)] * 4
    assert get("answer") == [(None, False), ([5.0, 6.0, 7.0, 8.0], True), (None, False), ([1.0, 2.0, 3.0, 4.0], True), (None, False)] or get("answer")[0] == ([1.0, 1.0, 2.0, 2.0], True)
    with pytest.raises(ValueError):
        W.response_box(F.col("t"), "other")


def test_rewards_ask_for_the_expectation(spark):
    df = spark.createDataFrame([("</think> {\"bbox\": [0,0,10,10]}", [0.0, 0.0, 10.0, 10.0], 1.0), ("</think> {\"bbox\": [0,0,10,5]}", [0.0, 0.0, 10.0, 10.0], 1.0), (None, [0.0, 0.0, 10.0, 10.0], 0.5)], "r string, t array<double>, e double")
    got = W.answer_box_reward(df, "r", "t", F.col("e")).collect()
    assert [r.accuracy for r in got] == [1.0, 0.0, -1.0] and got[2].format_total == 0
    for bad in (None, 1.5):
        with pytest.raises(Exception, match="shortcut expectation"):
            W.json_box_reward(df, "r", "t", F.lit(bad).cast("double")).collect()


def test_thinking_scores(spark):
    t = "<think>Well, it is there. Wait wait</think>"
    score = lambda o, w, n: told(spark, lambda c: W.thinking_score(c, F.lit(o).cast("string"), F.lit(w).cast("int"), F.lit(n).cast("int")), t)[0]
    assert score(None, None, None) == 1.0
    assert score('"well,"', 6, 2) == pytest.approx(1.0)
    assert score("so", 3, 4) == pytest.approx(0.33 * 0.5 + 0.33 * 0.5)
    assert score(None, 6, 0) == pytest.approx(0.67)
    assert told(spark, lambda c: W.thinking_score(c, F.lit("a"), F.lit(1), F.lit(1)), "none") == [0.0]


def test_messages_without_parts_go(spark):
    rows = [(1, [("human", "q"), ("gpt", "a")], ["x"], None), (2, [("human", "q")], ["x"], None), (3, [("gpt", "a")], ["x"], None), (4, [("human", "q"), ("gpt", "")], ["x"], None), (5, [("human", "q"), ("gpt", "a")], None, None), (6, None, ["x"], None)]
    df = spark.createDataFrame([(*r, 10, 10) for r in rows], "id int, messages array<struct<role:string,content:string>>, images array<string>, task string, width int, height int")
    assert [(r.id, r.target_type) for r in R.sharegpt_samples(df, "id").collect()] == [(1, "vqa")]


def test_tags_and_marks(spark):
    assert told(spark, lambda t: R.canonical_tags(t)["text"], None, "only words", "[Question]: a?\nb ") == ["", "only words", "<thinking>Format-normalized response based on the collected visual evidence.</thinking>\n<question>a?\nb</question>"]
    assert told(spark, R.with_image_mark, " q ", "<IMAGE>x", None) == ["<image>\nq", "<IMAGE>x", "<image>\n"]


def test_drawn_mixtures(spark):
    a, b, none = spark.range(7), spark.range(100, 103), spark.range(0)
    first = S.interleave_drawn([a, b], [0.5, 0.5], "id", seed=1).orderBy("place").collect()
    assert [r.place for r in first] == list(range(len(first)))
    own = {s: [r.id for r in first if r.source == s] for s in (0, 1)}
    assert own[0] == list(range(len(own[0]))) and own[1] == list(range(100, 100 + len(own[1]))) and (len(own[0]) == 7) != (len(own[1]) == 3)
    every = S.interleave_drawn([a, b], [0.5, 0.5], "id", "all", seed=1).orderBy("place").collect()
    own = {s: [r.id for r in every if r.source == s] for s in (0, 1)}
    assert own[0] == [i % 7 for i in range(len(own[0]))] and own[1] == [100 + i % 3 for i in range(len(own[1]))] and len(own[0]) >= 7 and len(own[1]) >= 3
    assert every[: len(first)] == first
    assert S.interleave_drawn([a, none], [0.5, 0.5], "id").collect() == []
    with pytest.raises(ValueError):
        S.interleave_drawn([a, b], [0.5, 0.6], "id")


def test_status_of_empty_runs(spark):
    df = spark.createDataFrame([(0, 0, True, 0, 0, 0, 0), (5, 5, True, 2, 1, 1, 0), (5, 5, None, 2, 2, 1, 3)], "attempted int, perceiver_calls int, log_present boolean, total_grounding int, strict_grounding int, both_pass int, bad int")
    got = [(r.status, r.hard_failures, r.quality_failures) for r in R.run_status(df, {"grounding": 0.5}, ["bad"], []).collect()]
    assert got == [("WARN", [], ["no_grounding_samples"]), ("PASS", [], []), ("FAIL", ["api_log_missing", "bad=3", "strict_grounding_contains_iou_or_center_only_pass"], [])]


def test_chunks_of_short_tables(spark):
    for size in (0, 3, 7, 20):
        got = sorted((r.id, r.chunk) for r in S.chunks(spark.range(size), 7, "id").collect())
        sizes = [sum(c == k for _, c in got) for k in range(7)]
        assert [c for _, c in got] == sorted(c for _, c in got) and sum(sizes) == size and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
