"""Answer rules, verdicts and messages on odd texts; training sets that differ."""

import pytest
from pyspark.sql import functions as F

from loomlake.operators import parsing as P, rules as U, traces as T


def told(spark, f, *rows):
    n = len(rows[0]) if isinstance(rows[0], tuple) else 1
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    return [r[0] for r in df.orderBy("i").select(f(*[F.col(f"c{k}") for k in range(n)])).collect()]


def test_answers_by_rules(spark):
    pairs = [("two", "There are ２ of them", True), ("2", "12 or 2", False), ("no", "nothing, no", True), ("no", "know", False), ("Red car", "a red-car!", True), ("car", "cars", False), ("", "", False), (None, "x", False), ("x+y", "so x y it is", True), ("3.5", "The answer is: 3.5", True), ("yes", None, False)]
    assert told(spark, U.answer_holds, *[p[:2] for p in pairs]) == [p[2] for p in pairs]
    assert told(spark, U.plain_answer, "Final Answer： The <b>Twenty</b>_one; É!") == ["20 1 é"]


def test_verdicts_of_odd_prompts(spark):
    box = "1,1,9,1,9,9,1,9"
    q = lambda a, g, ask="where?": f"x\nQuery: {ask}\nAnswer: {a}\nGT: {g}"
    got = told(spark, P.rule_verdict, None, "Query: a", q(f"ship|{box}", f"boat|{box}"), q("ship", f"ship|{box}", "what category is it"), q("ship|1,1,9,9,9,1,1,5", f"ship|{box}"), q("ship|500,500,600,500,600,600,500,600", f"ship|{box}"))
    assert got[:2] == [None, None] and got[2:4] == ["ACCEPT"] * 2
    assert got[4] == "REJECT: invalid predicted OBB (self_intersecting)" and got[5] == "REJECT: predicted region mismatches target geometry (HBB IoU=0.000)"


def test_messages_in_tags(spark):
    got = told(spark, lambda t: F.to_json(P.tagged_message(t)), None, "<question> </question>", "<answer>a\nb</answer>", "Final Answer: c", '{"action": "final"}')
    assert got[:2] == [None, None] and '"answer":"a\\nb"' in got[2] and '"answer":"c"' in got[3] and got[4] is None
    assert told(spark, lambda t: P.verifier_json(t)["score"], "x {\"score\": 7} y", "{\"pass\": true}", "none", None) == [1.0, 0.0, None, None]


def test_contracts_of_short_rows(spark):
    df = spark.createDataFrame([(None, ["a"]), ([("user", "<image>")], ["a"]), ([("user", "<image>"), ("assistant", "x")], None), ([("user", "<image>"), ("assistant", None)], ["a"])], "m array<struct<role:string,content:string>>, g array<string>")
    no = F.lit(None).cast("string")
    got = [r[0] for r in df.select(U.contract_reasons(F.col("m"), F.col("g"), no, F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), no)).collect()]
    assert got == [["messages_invalid"], ["messages_invalid"], ["images_invalid"], ["assistant_content_empty"]]


def test_training_sets_must_share_their_questions(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    assert T.matched_datasets(rows(9), rows(1, 2, 2), rows(2, 1, 2), "id").count() == 8
    for other in ((1,), (1, 2), (1, 1, 2)):
        with pytest.raises(Exception, match="differ in"):
            T.matched_datasets(rows(9), rows(1, 2, 2), rows(*other), "id").collect()
