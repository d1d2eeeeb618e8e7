"""Queries of the output parsers, over output texts made from boxes and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.operators import parsing as P, rules as U
from loomlake.operators.joins import LEAK_WORDS
from loomlake.plans.fixtures import OBJECTS, ROLLOUTS, duck, frame

QUERIES, ORACLES = {}, {}
E, O = duck(ROLLOUTS), duck(OBJECTS)
ID = ["image_id", "object_index"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def objects(spark, sf):
    return frame(spark, sf, OBJECTS)


def _four():
    return [F.bround(c, 0).cast("int").cast("string") for c in (F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2, F.col("cx") + F.col("w") / 2, F.col("cy") + F.col("h") / 2)]


_X = "cast(round_even(cx - w/2, 0) as int) as a, cast(round_even(cy - h/2, 0) as int) as b, cast(round_even(cx + w/2, 0) as int) as c, cast(round_even(cy + h/2, 0) as int) as d"


@query("b11_format_answer", f"select image_id, object_index, class_name || '|' || a || ',' || b || ',' || c || ',' || d as answer from (select *, {_X} from ({O}))")
def _(spark, sf):
    cx, cy, w, h = map(F.col, ("cx", "cy", "w", "h"))
    return objects(spark, sf).select(*ID, P.format_answer(F.col("class_name"), None, F.array(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)).alias("answer"))


@query("p1_parse_detections", f"""with i as (select image_id, count(distinct class_name || a || ',' || b || ',' || c || ',' || d) as n from (select *, {_X} from ({O})) group by image_id)
 select image_id, case image_id % 7 when 0 then 'no_block' when 1 then 'bad_line' else 'ok' end as status, case when image_id % 7 < 2 then 0 else n end as n from i""")
def _(spark, sf):
    """Every image's boxes as one output text; some lack the block, some hold a bad line."""
    a, b, c, d = _four()
    line = F.concat(F.col("class_name"), F.lit("|0.8|"), F.concat_ws(",", a, b, c, b, c, d, a, d))
    body = objects(spark, sf).groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    bad = F.when(F.col("image_id") % 7 == 1, "\nship|high|1,2,3").otherwise("")
    text = F.when(F.col("image_id") % 7 == 0, F.col("t")).otherwise(F.concat(F.lit("Some prose.\nFINAL_DETECTIONS\n"), "t", bad, F.lit("\nEND_DETECTIONS")))
    df = P.parse_detections(body.withColumn("text", text), "text", "image_id")
    return df.select("image_id", "status", F.size("detections").cast("long").alias("n"))


@query("p2_parse_boxes", f"select image_id, object_index, case when object_index % 4 = 3 then null else a end as x1, case when object_index % 4 = 3 then null else d end as y2 from (select *, {_X} from ({O}))")
def _(spark, sf):
    nums = F.concat_ws(", ", *_four())
    k = F.col("object_index") % 4
    text = F.when(k == 0, F.concat(F.lit('{"bbox": ['), nums, F.lit("]}"))).when(k == 1, F.concat(F.lit('{"box": ['), nums, F.lit("]}"))).when(k == 2, F.concat(F.lit("it is at ["), nums, F.lit("] there"))).otherwise("nowhere [1, 2]")
    df = objects(spark, sf).withColumn("box", P.parse_box(text))
    return df.select(*ID, F.get("box", 0).cast("int").alias("x1"), F.get("box", 3).cast("int").alias("y2"))


@query("p3_spatial_candidates", f"select image_id, object_index, kind, a as first from (select *, {_X} from ({O})), (values ('bbox'), ('obb')) k(kind) where kind = 'bbox' or object_index % 2 = 0")
def _(spark, sf):
    a, b, c, d = _four()
    text = F.concat(F.lit("I see bbox_2d=["), F.concat_ws(",", a, b, c, d), F.lit("] and obb_8: ["), F.when(F.col("object_index") % 2 == 0, F.concat_ws(", ", a, b, c, b, c, d, a, d)).otherwise(F.lit("1, 2")), F.lit("]."))
    df = P.spatial_candidates(objects(spark, sf).withColumn("text", text), "text", *ID)
    return df.select(*ID, "kind", F.get("values", 0).cast("int").alias("first"))


@query("p4_focus_from_text", f"select image_id, object_index, case when object_index % 3 > 0 and least(a, b, c, d) >= 0 then a + d end as total from (select *, {_X} from ({O}))")
def _(spark, sf):
    a, b, c, d = _four()
    text = F.when(F.col("object_index") % 3 > 0, F.concat(F.lit("Look at Region [ "), F.concat_ws(" , ", a, b, c, d), F.lit("] closely"))).otherwise("Look at the region")
    df = objects(spark, sf).withColumn("f", P.focus_from_text(text))
    return df.select(*ID, (F.get("f", 0) + F.get("f", 3)).alias("total"))


@query("p5_verdict", f"select row_id, event_type = 'purchase' as accepted, case event_type when 'purchase' then '' when 'error' then 'bad ' || row_id else 'unparsed' end as reason from ({E})")
def _(spark, sf):
    t = F.when(F.col("event_type") == "purchase", "accept, fine").when(F.col("event_type") == "error", F.concat(F.lit(" Reject: bad "), F.col("row_id").cast("string"))).otherwise("hm")
    return frame(spark, sf, ROLLOUTS).withColumn("v", P.verdict(t)).select("row_id", "v.accepted", "v.reason")


@query("p8_parse_messages", f"select row_id, case row_id % 4 when 0 then 'inspect' when 1 then 'final' end as action, case row_id % 4 when 0 then 'what' when 1 then event_type end as said from ({E})")
def _(spark, sf):
    k = F.col("row_id") % 4
    t = F.when(k == 0, '{"action": "inspect", "question": "what"}').when(k == 1, F.concat(F.lit('{"action": "final", "answer": "'), "event_type", F.lit('"}'))).when(k == 2, '{"action": "final", "answer": " "}').otherwise("not json")
    return frame(spark, sf, ROLLOUTS).withColumn("m", P.parse_message(t)).select("row_id", "m.action", F.coalesce("m.question", "m.answer").alias("said"))


@query("f5_mutated_convention", f"select image_id, object_index, w <> h or (part % 3 = 0) as mutated from ({O})")
def _(spark, sf):
    """Ranges named by width before and by height after, at times with one range more."""
    before = F.concat("class_name", F.lit(" in [0,"), F.col("w").cast("int").cast("string"), F.lit("]"))
    after = F.concat(F.lit("give the "), "class_name", F.lit(" within [0, "), F.col("h").cast("int").cast("string"), F.when(F.col("part") % 3 == 0, "] or [0,7]").otherwise("] please"))
    return objects(spark, sf).select(*ID, U.mutated_convention(before, after).alias("mutated"))


_SAID = "concat(case p_size % 4 when 0 then 'What kind of object is the ' when 1 then 'Name the CATEGORY of the ' else 'How long is the ' end, p_name, ' by the ', lower(p_type), '?')"
_ASKED = "concat(case object_index % 5 when 0 then 'Which CLASS lies at ' when 1 then 'What label has it at ' when 2 then 'How long is it at ' when 3 then 'Are there small ones near ' else 'What outline has it at ' end, cast(part as {string}), ' beside the ', upper(class_name), case when supp % 4 = 0 then 's' else '' end, case when line = 6 then ' with bolts?' else '?' end)"
_LEADS = r"regexp_matches({q}, '\b(?:class|category|label)\b', 'i') or regexp_matches({q}, '\b(?:ring|bolt|small|ship|harbor)s?\b', 'i')"


@query("f7_leading_question", rf"select 'part' as kind, p_partkey as id, 0 as n, {_LEADS.format(q=_SAID)} as leading from part union all select 'object', image_id, object_index, {_LEADS.format(q=_ASKED.replace('{string}', 'varchar'))} from ({O})")
def _(spark, sf):
    """Questions about every object and every part, with some names as class names."""
    leading = lambda q: U.leading_question(F.expr(q), ["ring", "bolt", "small", "ship", "harbor"]).alias("leading")
    of_parts = spark.read.parquet(f"{sf}/part.parquet").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.lit(0).alias("n"), leading(_SAID))
    return of_parts.unionByName(objects(spark, sf).select(F.lit("object").alias("kind"), F.col("image_id").alias("id"), F.col("object_index").alias("n"), leading(_ASKED.replace("{string}", "string"))))


@query("f11_usable_evidence", r"select conv_id, turn, length(trim(text)) >= 20 and turn % 5 <> 4 as usable from conversations")
def _(spark, sf):
    """Turns as observations; every fifth one ends in a service's error."""
    said = F.concat("text", F.when(F.col("turn") % 5 == 4, " APIConnectionError: refused").otherwise(""))
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", U.usable_evidence(said).alias("usable"))


_GROUND = f"""select *, cast(floor(cx - w / 2) as int) as a, cast(floor(cy - h / 2) as int) as b, cast(floor(cx + w / 2) as int) as c, cast(floor(cy + h / 2) as int) as d, part % 41 - 20 as s, part % 7 as k from ({OBJECTS}) o"""


@query("p5_rule_verdict", f"""with o as ({duck(_GROUND)}), i as (select *, greatest(0, c - a - abs(s)) * (d - b) as i, 2.0 * (c - a) * (d - b) as u from o)
 select image_id, object_index, case k when 0 then null when 1 then 'REJECT: answer is not a valid canonical label or structured grounding output' when 2 then case when class_name = 'ship' then 'ACCEPT' else 'REJECT: canonical class mismatch' end when 3 then 'ACCEPT' when 4 then 'REJECT: missing complete clockwise OBB'
  when 5 then 'REJECT: invalid predicted OBB (repeated_points)' else case when i / (u - i) >= 0.1 and abs(s) <= greatest(1, (c - a) * 0.35) + (c - a) / 2.0 then 'ACCEPT' else 'REJECT: predicted region mismatches target geometry' end end as verdict from i""")
def _(spark, sf):
    """Prompts of another form, of unknown and wrong classes, about classes, without corners, with double ones, and with moved boxes."""
    n = lambda *v: F.concat_ws(",", *[x.cast("string") for x in v])
    a, b, c, d, s, k = map(F.col, ("a", "b", "c", "d", "s", "k"))
    truth = F.concat("class_name", F.lit("|"), n(a, b, c, b, c, d, a, d))
    said = F.when(k == 1, "a cow").when(k == 2, "ship").when(k == 3, F.col("class_name")).when(k == 4, F.concat("class_name", F.lit("|1,2,3"))).when(k == 5, F.concat("class_name", F.lit("|"), n(a, b, a, b, c, d, a, d))).otherwise(F.concat("class_name", F.lit("|"), n(a + s, b, c + s, b, c + s, d, a + s, d)))
    asks = F.when(k.isin(2, 3), "Which class is it?").otherwise("Where\nis it?")
    prompt = F.when(k == 0, truth).otherwise(F.concat(F.lit("Judge.\nQuery: "), asks, F.lit("\nAnswer: "), said, F.lit("\nGT: "), truth))
    return frame(spark, sf, _GROUND).select(*ID, F.regexp_replace(P.rule_verdict(prompt), r" \(HBB.*", "").alias("verdict"))


@query("p8_tagged_messages", f"select row_id, case row_id % 6 when 0 then 'inspect' when 1 then 'final' when 2 then 'inspect' when 3 then 'final' end as action, case row_id % 6 when 0 then 'what' when 1 then event_type when 2 then 'which ' || event_type when 3 then event_type end as said, case when row_id % 6 in (2, 3) then 'hm' end as thinking from ({E})")
def _(spark, sf):
    """JSON, tags, both a question and an answer, and neither."""
    k, e = F.col("row_id") % 6, F.col("event_type")
    t = F.when(k == 0, '{"action": "inspect", "question": "what"}').when(k == 1, F.concat(F.lit('{"action": "final", "answer": "'), e, F.lit('"}'))).when(k == 2, F.concat(F.lit("<Think>hm</Think><question> which "), e, F.lit("</question>"))).when(k == 3, F.concat(F.lit("<thinking>hm</thinking>\n[Final Answer]: "), e)).when(k == 4, F.concat(F.lit("<question>a</question> Final Answer: "), e)).otherwise("nothing")
    return frame(spark, sf, ROLLOUTS).withColumn("m", P.tagged_message(t)).select("row_id", "m.action", F.coalesce("m.question", "m.answer").alias("said"), "m.thinking")


@query("p8_verifier_json", f"select row_id, case row_id % 4 when 0 then true when 3 then null else false end as passed, case row_id % 4 when 0 then least(1, tokens / 50.0) when 3 then null else 0 end as score from ({E})")
def _(spark, sf):
    k = F.col("row_id") % 4
    t = F.when(k == 0, F.concat(F.lit('so {"pass": true, "score": '), (F.col("tokens") / 50).cast("string"), F.lit(', "reason": "x"}'))).when(k == 1, '{"pass": false, "score": -2}').when(k == 2, '{"score": "high"}').otherwise("no object")
    return frame(spark, sf, ROLLOUTS).withColumn("v", P.verifier_json(t)).select("row_id", "v.passed", "v.score")


_TALKS = "select p_partkey, p_name, p_size, case p_size % 5 when 0 then 'yes' when 1 then cast(p_size as {string}) when 2 then 'The ' || p_name when 3 then 'three ' || p_name else '' end as truth, case p_partkey % 6 when 0 then 'Answer: ' || p_name when 1 then 'YES, I see ' || cast(p_size as {string}) || ' of a ' || p_name when 2 then 'no or yes' when 3 then '<b>3</b> ' || p_name || '!' when 4 then cast(p_size as {string}) || '0 things' else 'the answer is: ' || cast(p_size as {string}) end as said from {part}"


@query("a18_answer_rules", f"""with t as ({_TALKS.replace('{string}', 'varchar').replace('{part}', 'part')}),
 n as (select *, case p_size % 5 when 2 then p_name when 3 then '3 ' || p_name else truth end as a, case p_partkey % 6 when 0 then p_name when 1 then 'yes i see ' || p_size || ' of ' || p_name when 2 then 'no or yes' when 3 then '3 ' || p_name when 4 then p_size || '0 things' else cast(p_size as varchar) end as b from t)
 select p_partkey, p_size % 5 < 4 and (a = b or case p_size % 5 when 0 then p_partkey % 6 = 1 when 1 then regexp_extract(b, '[0-9]+') = a else contains(' ' || b || ' ', ' ' || a || ' ') end) as right from n""")
def _(spark, sf):
    """Answers with prefixes, tags, articles, number words and more words around."""
    t = spark.sql(_TALKS.replace("{string}", "string"), part=spark.read.parquet(f"{sf}/part.parquet"))
    return t.select("p_partkey", U.answer_holds(F.col("truth"), F.col("said")).alias("right"))


_LEAKY = f"""select image_id, object_index, class_name, part, supp, concat('the ', case part % 4 when 0 then 'Roughly Vertical' when 1 then 'diagonally descending' else 'grey' end, ' one') as ground,
 concat('what is the ', case supp % 6 when 0 then class_name when 1 then 'tanks' when 2 then 'Boat' when 3 then 'thing' when 4 then 'roughly horizontal thing' else 'tanker' end, ' there') as asked from ({OBJECTS}) o"""


@query("f2_class_leaks", f"""select image_id, object_index, array_to_string(list_filter([case when class_name in ('storage tank', 'harbor') and (part % 4 = 0 or supp % 6 = 4) then 'unstable_orientation_phrase' end, case when supp % 6 = 0 then 'classification_label_leak' end,
 case when supp % 6 = 0 or supp % 6 = 1 and class_name = 'storage tank' or supp % 6 = 2 and class_name = 'ship' then 'classification_alias_leak' end], lambda x: x is not null), ',') as flags from ({duck(_LEAKY)})""")
def _(spark, sf):
    return frame(spark, sf, _LEAKY).select(*ID, F.array_join(U.class_leaks(F.col("ground"), F.col("asked"), F.col("class_name"), LEAK_WORDS), ",").alias("flags"))


@query("f14_contract_reasons", f"""select image_id, object_index, case when line = 7 then 'messages_invalid' when line = 6 then 'images_invalid' else array_to_string(list_filter([case when part % 5 = 0 then 'image_tag_count_mismatch' end, case when supp % 7 = 0 then 'last_message_not_assistant' end, case when part % 9 = 8 then 'assistant_content_empty' end,
 case when supp % 2 = 0 and part % 9 = 0 then 'opening_think' end, case when supp % 2 = 0 and part % 9 > 2 then 'missing_closing_think' end, case when supp % 2 = 0 and part % 3 = 0 then 'final_not_teacher_forced' end,
 case when supp % 2 = 1 and line = 1 and part % 9 <> 3 then 'direct_detection_markers_missing' end, case when supp % 2 = 1 and line = 2 and part % 9 not in (0, 1, 2, 4) then 'final_only_gt_mismatch' end], lambda x: x is not null), ',') end as reasons from ({O})""")
def _(spark, sf):
    """Traces (even suppliers) and other rows whose answers, roles, marks and images break the contracts in turn."""
    k, c = F.col("part") % 9, F.col("class_name")
    text = F.when(k == 0, F.concat(F.lit("<think>a</think> "), c)).when(k.isin(1, 2), F.concat(F.lit("a</think>\n"), c)).when(k == 3, "FINAL_DETECTIONS\nEND_DETECTIONS").when(k == 4, c).when(k == 8, " ").otherwise("other")
    turn = lambda r, t: F.struct(r.alias("role"), t.alias("content"))
    user = turn(F.lit("user"), F.when(F.col("part") % 5 == 0, "ask").otherwise("<image>ask"))
    messages = F.when(F.col("line") == 7, F.array(user)).otherwise(F.array(user, turn(F.when(F.col("supp") % 7 == 0, "user").otherwise("assistant"), text)))
    images = F.when(F.col("line") != 6, F.array(F.lit("a.png")))
    task = F.when(F.col("line") == 1, "detection_obb_by_class").when(F.col("line") == 2, "ref_classification").otherwise("vqa")
    return objects(spark, sf).select(*ID, F.array_join(U.contract_reasons(messages, images, task, F.col("supp") % 2 == 0, F.col("part") % 3 > 0, c), ",").alias("reasons"))
