"""Queries of the trace rules, over observations and questions made from boxes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.operators import traces as T
from loomlake.operators.joins import CLASSES
from loomlake.plans.fixtures import OBJECTS, duck, frame

QUERIES, ORACLES = {}, {}
ID = ["image_id", "object_index"]

#: One observation and one question for each object; the target is the image's first class.
SAID = f"""
select image_id, object_index, class_name, min(class_name) over (partition by image_id) as target, part, supp, line, cx, cy, w, h,
  concat('The ', case line % 4 when 0 then 'target' when 1 then 'Object' when 2 then 'scene' else 'feature' end, ' near the road ',
    case part % 6 when 0 then 'is a ' when 1 then 'is not a ' when 2 then 'appears to be the ' when 3 then 'lies beside several grey ' when 4 then 'looks like an ' else 'shows no ' end,
    case supp % 4 when 0 then class_name when 1 then 'boat' when 2 then 'industrial building' else 'tank' end, case part % 5 when 0 then 's.' else '.' end) as said,
  concat('What ', case part % 4 when 0 then 'shape' when 1 then 'size' else 'colour' end, ' does the ', class_name, case supp % 3 when 0 then ' have?' when 1 then ' have, and the top-left corner?' else ' show to you?' end) as asked
from ({OBJECTS}) o"""
S = duck(SAID)
_IS = "(\\\\bis\\\\b|\\\\bappears?\\\\s+to\\\\s+be\\\\b|\\\\blooks?\\\\s+like\\\\b)\\\\s+(?:an?\\\\s+|the\\\\s+)?".replace("\\\\", "\\")
_SUBJECT = r"(\btarget\b|\bobject\b|\bfeature\b)[^.!?]{0,100}?"
_WORDS = {"plane": "plane|aircraft|airplane|jet", "ship": "ship|boat|vessel|watercraft", "storage tank": "storage tank|tank", "harbor": "harbor|marina|port|dockyard", "small vehicle": "small vehicle|car|sedan|suv|pickup"}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def said(spark, sf):
    return frame(spark, sf, SAID)


def by_class(pattern) -> str:
    """A CASE over the classes of the made observations, with the class's words in ``pattern``."""
    return "case target " + " ".join(f"when '{c}' then regexp_matches(t, '{pattern('(?:' + w + ')')}')" for c, w in _WORDS.items()) + " end"


@query("f8_denials", rf"select image_id, object_index, {by_class(lambda w: rf'\bno\s+(?:such\s+|clear\s+)?{w}s?\b|\bnot\s+(?:an?\s+|the\s+)?{w}\b')} as denied from (select *, lower(said) as t from ({S}))")
def _(spark, sf):
    return said(spark, sf).select(*ID, T.denies(F.col("said"), F.col("target")).alias("denied"))


@query("f9_class_claims", f"""with c as (select image_id, object_index, target, list_filter([{', '.join(f"case when regexp_matches(lower(said), '{_SUBJECT}{_IS}(?:{w})s?" + chr(92) + f"b') then '{c}' end" for c, w in _WORDS.items())}], lambda x: x is not null) as claimed from ({S}))
 select image_id, object_index, array_to_string(list_sort(claimed), ',') as claimed, len(claimed) > 1 or len(list_filter(claimed, lambda c: c <> target)) > 0 as another from c""")
def _(spark, sf):
    # classes come out of an explode, so that the two columns don't compute them twice
    df = said(spark, sf).select(*ID, "target", F.explode(F.array(T.claimed_classes(F.col("said")))).alias("found"))
    return df.select(*ID, F.array_join(F.array_sort("found"), ",").alias("claimed"), T.another_than(F.col("found"), F.col("target")).alias("another"))


@query("f10_substitutions", rf"""select image_id, object_index, case when regexp_matches(t, '{_SUBJECT.replace('100', '70')}{_IS}industrial building\b') then 'industrial building' end as scene,
 {by_class(lambda w: rf'\b(?:multiple|numerous|several|many|rows?\s+of)\s+(?:\w+\s+)?(?:\w+\s+)?{w}s?\b')} as many from (select *, lower(said) as t from ({S}))""")
def _(spark, sf):
    return said(spark, sf).select(*ID, T.scene_instead(F.col("said"), F.col("target")).alias("scene"), T.many_instead(F.col("said"), F.col("target")).alias("many"))


@query("f13_unsafe_question", f"select image_id, object_index, case when supp % 3 = 1 then 'partial_corner_coordinate_question' end as unsafe from ({S})")
def _(spark, sf):
    return said(spark, sf).select(*ID, T.unsafe_question(F.col("asked")).alias("unsafe"))


@query("f17_trace_contradictions", f"""select image_id, target, case target when 'small vehicle' then contains(t, 'industrial building') when 'ship' then contains(t, 'not a ship') when 'plane' then contains(t, 'object appears to be a runway') else false end as contradicts
 from (select image_id, target, string_agg(lower(said), ' ' order by object_index) as t from ({S}) group by image_id, target)""")
def _(spark, sf):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("object_index", "said"))), lambda x: x["said"]), " ")
    df = said(spark, sf).groupBy("image_id", "target").agg(text.alias("t"))
    return df.select("image_id", "target", T.contradicts(F.col("t"), F.col("target")).alias("contradicts"))


_FOCUS = "cast(round_even(cx - w, 0) as int) || ',' || cast(round_even(cy - h, 0) as int) || ',' || cast(round_even(cx + w, 0) as int) || ',' || cast(round_even(cy + h, 0) as int)"


@query("f4_focus_quoted", f"select image_id, object_index, least(cx - w, cy - h) >= 0 and greatest(cx + w, cy + h) <= 1000 and part % 3 < 2 as quoted from ({S})")
def _(spark, sf):
    """Questions that name the rounded focus region, or a box one off."""
    cx, cy, w, h = map(F.col, ("cx", "cy", "w", "h"))
    df = said(spark, sf).withColumn("focus", F.array(cx - w, cy - h, cx + w, cy + h))
    shown = F.transform("focus", lambda v: (F.bround(v, 0).cast("int") + F.when(F.col("part") % 3 == 2, 1).otherwise(0)).cast("string"))
    text = F.concat(F.lit("Look at the Focus  region ["), F.array_join(shown, ", "), F.lit("] only."))
    return df.select(*ID, T.quotes_focus(text, F.col("focus")).alias("quoted"))


@query("f3_coordinate_flags", f"""with n as (select image_id, object_index, part, [cx - w, cy - h, cx + w, cy - h, cx + w, cy + h, cx - w, cy + h] as v from ({S}))
 select image_id, object_index, len(list_filter(v, lambda x: x between 0 and case part % 3 when 0 then 1000 when 1 then 100 else 1e9 end)) = 8 and (part % 3 < 2 or (greatest(v[1], v[3]) <= 799 and greatest(v[2], v[6]) <= 899)) as ok from n""")
def _(spark, sf):
    """Answers of eight numbers in the range of norm1000, norm100 or an image of 800 by 900 pixels."""
    cx, cy, w, h = map(F.col, ("cx", "cy", "w", "h"))
    corners = [cx - w, cy - h, cx + w, cy - h, cx + w, cy + h, cx - w, cy + h]
    answer = F.concat("class_name", F.lit("|"), F.array_join(F.array(*[c.cast("string") for c in corners]), ","))
    target = F.when(F.col("part") % 3 == 0, "norm1000_obb").when(F.col("part") % 3 == 1, "norm100_obb").otherwise("pixel_obb")
    return said(spark, sf).select(*ID, T.answer_in_range(answer, target, F.lit(800), F.lit(900)).alias("ok"))


@query("w15_similar_questions")
def _(spark, sf):
    """Questions of a trace that repeat an earlier one; a test holds the operator against a loop."""
    return T.similar_questions(said(spark, sf), "image_id", "object_index", "asked", 0.9).select("image_id", "left", "right", F.round("similarity", 6).alias("similarity"))


@query("a11_bucket_traces", f"""with t as (select image_id, count(*) as n, max(part) % 4 as p, max(supp) % 3 as s, (max(line) * 17 % 100) / 100.0 as score from ({S}) group by image_id),
 y as (select *, list_filter([case when p = 3 then 'generation:broken' end, case when s = 2 then 'verifier:failed' end], lambda x: x is not null) as why from t),
 b as (select *, case when len(why) = 0 and n >= 2 and score >= 0.5 then 'strict' when len(why) = 0 and n = 1 and score >= 0.3 then 'single_round_verified' end as bucket from y)
 select image_id, bucket, case when bucket is null then array_to_string(list_filter(list_append(why, case when n < 2 then 'too_few_perception_rounds:' || n end), lambda x: x is not null), ',') else '' end as reasons from b""")
def _(spark, sf):
    t = said(spark, sf).groupBy("image_id").agg(F.count("*").cast("int").alias("perception_rounds"), (F.max("part") % 4).alias("p"), (F.max("supp") % 3).alias("s"), (F.max("line") * 17 % 100 / 100).alias("score"))
    df = t.withColumns({"success": F.col("p") != 3, "error": F.lit("broken"), "verified": F.col("s") != 2, "verifier_reason": F.lit(None).cast("string"), "geometry_ok": F.lit(True), "geometry_reason": F.lit(None).cast("string"), "repairs": F.lit(0)})
    out = T.bucket_traces(df, 2, 0.5, 0.3)
    return out.select("image_id", "bucket", F.array_join("reasons", ",").alias("reasons"))


def traces(spark, sf):
    turn = F.struct("object_index", F.concat(F.lit("<Thinking> see "), "class_name", F.lit(" </thinking> <question>where \n is it</question>")).alias("reasoner"), F.when(F.col("part") % 2 == 0, F.col("asked")).alias("query"), F.col("said").alias("perceiver"))
    g = said(spark, sf).groupBy("image_id").agg(F.array_sort(F.collect_list(turn)).alias("history"), F.min("class_name").alias("final_answer"))
    return g.withColumns({"lang": F.when(F.col("image_id") % 3 == 0, "zh-CN").otherwise("en"), "success": F.col("image_id") % 5 != 0, "error": F.when(F.col("image_id") % 7 == 0, "x")})


_MERGED = f"""select image_id, '<think>' || case when image_id % 3 = 0 then '好的，我将会以自问自答的方式逐步推理，最终给出回复。 ' else 'Alright, I will reason in a self Q&A style and give the final reply. ' end
 || string_agg('see ' || class_name || ' ' || case when part % 2 = 0 then asked else 'where is it' end || ' ' || said, ' ' order by object_index) || '</think>' || min(class_name) as thinking from ({S}) group by image_id"""


@query("c11_merge_trace", _MERGED)
def _(spark, sf):
    return traces(spark, sf).select("image_id", T.merge_trace(F.col("lang"), F.col("history"), F.col("final_answer")).alias("thinking"))


@query("c12_postprocess_traces", f"select * from ({_MERGED}) where image_id % 5 <> 0 and image_id % 7 <> 0")
def _(spark, sf):
    return T.postprocess_traces(traces(spark, sf)).select("image_id", "thinking")


@query("c16_final_only", f"select image_id, object_index, trim(asked) as question, '</think>' || chr(10) || class_name as answer from ({S})")
def _(spark, sf):
    df = T.final_only(said(spark, sf), "asked", "class_name")
    return df.select(*ID, F.get("messages", 0)["content"].alias("question"), F.get("messages", 1)["content"].alias("answer"))


@query("c17_matched_datasets", f"select dataset, kind, count(*) as n from (select unnest(['A', 'B', 'A', 'B']) as dataset, unnest(['direct', 'direct', 'final', 'trace']) as kind from ({S}) where object_index = 0) group by all")
def _(spark, sf):
    one = said(spark, sf).where("object_index = 0").select("image_id")
    kind = lambda k: one.withColumn("kind", F.lit(k))
    return T.matched_datasets(kind("direct"), kind("final"), kind("trace")).groupBy("dataset", "kind").agg(F.count("*").alias("n"))


@query("a5_final_gate", f"with r as (select class_name as name, bool_and(w > 9) as passed from ({S}) group by 1), q as (select unnest({CLASSES}) as name) select count(*) = 0 as passed, string_agg(coalesce(r.name || ' did not pass', 'missing report: ' || q.name), ',' order by coalesce(r.name || ' did not pass', 'missing report: ' || q.name)) as critical from q left join r using (name) where not coalesce(r.passed, false)")
def _(spark, sf):
    """A report for each class that occurs; all classes are required."""
    r = said(spark, sf).groupBy(F.col("class_name").alias("name")).agg(F.bool_and(F.col("w") > 9).alias("passed"))
    return T.final_gate(r, CLASSES).select("passed", F.array_join("critical", ",").alias("critical"))


@query("j9_subset_check", f"""with a as (select image_id * 100 + object_index as id, w, part from ({S})), s as (select id from a where w > 20 and part % 11 <> 0 union select id + 1000000000 from a where part % 50 = 0 union select id from a where part % 17 = 0)
 select (select count(*) from s where id not in (select id from a)) as unknown, (select count(*) from s join a using (id) where w <= 20) as unchosen, (select count(*) from a where w > 20 and id not in (select id from s)) as missing""")
def _(spark, sf):
    a = said(spark, sf).select((F.col("image_id") * 100 + F.col("object_index")).alias("id"), "w", "part")
    s = a.where("w > 20 and part % 11 <> 0").select("id").union(a.where("part % 50 = 0").select(F.col("id") + 1_000_000_000)).union(a.where("part % 17 = 0").select("id"))
    return T.subset_check(s, a, "id", F.col("w") > 20)
