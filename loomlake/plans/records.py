"""Queries that make records, evaluation samples and run reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.operators import geometry as G, records as R, rollouts as O, sampling as S
from loomlake.plans.fixtures import OBJECTS, ROLLOUTS, duck, frame
from loomlake.plans.registry_tools import register
from loomlake.plans.text import _SPLIT_AT, _T, split_docs

QUERIES, ORACLES = {}, {}
query = register(QUERIES, ORACLES)
ID = ["image_id", "object_index"]
B, E = duck(OBJECTS), duck(ROLLOUTS)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def objects(spark, sf):
    return frame(spark, sf, OBJECTS)


@query("c8_vqa_records", """with c as (select conv_id, count(*) as n, string_agg(text, chr(0) order by turn) as t from conversations group by conv_id),
 s as (select conv_id, string_split(t, chr(0)) as t from c where n = 2 and conv_id % 3 > 0 and conv_id % 5 > 0)
 select conv_id, case when conv_id % 3 = 1 then '<image>' || chr(10) || '[VQA] ' || trim(t[1]) else '<Image> [vqa]' || rtrim(t[1]) end as query, trim(t[2]) as gt, 'i' || conv_id || '.png' as image from s where conv_id % 7 > 0""")
def _(spark, sf):
    """Conversations of two turns; some lack the mark, the image's name, or the image."""
    k = F.col("conv_id")
    turn = F.struct("turn", "role", F.when((F.col("turn") == 0) & (k % 3 == 1), F.concat(F.lit("[VQA] "), F.trim("text"))).when((F.col("turn") == 0) & (k % 3 == 2), F.concat(F.lit("<Image> [vqa]"), "text")).otherwise(F.col("text")).alias("content"))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("messages"))
    c = c.withColumn("image", F.when(k % 5 > 0, F.concat(F.lit("i"), k.cast("string"), F.lit(".png"))))
    out = R.vqa_records(c, "conv_id", c.where("conv_id % 7 > 0"))
    return out.select("conv_id", "query", "gt", F.get("image", 0)["name"].alias("image"))


_MODES = "['Optical', 'ir', ' SAR ', 'lidar']"


@query("c10_image_meta", f"""with m as (select p_partkey, p_size % 4 as n, list_transform(range(0, p_size % 4), lambda i: case (p_partkey + i) % 4 when 0 then 'RGB / Visible' when 1 then 'Infrared' when 2 then 'Synthetic Aperture Radar (SAR)' else 'lidar' end) as m from part)
 select p_partkey, case when n = 0 then 'meta:' when n = 1 then 'meta:- Modality: ' || m[1] || ' (size: ' || p_partkey || 'x0)' else 'meta:' || array_to_string(list_transform(range(1, n + 1), lambda i: '- Image ' || i || ': Modality: ' || m[i] || ', size: ' || p_partkey || 'x' || (i - 1) || chr(10)), '') end as meta from m""")
def _(spark, sf):
    df = table(spark, sf, "part")
    every = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.get(F.array(*map(F.lit, ("Optical", "ir", " SAR ", "lidar"))), ((F.col("p_partkey") + i) % 4).cast("int")).alias("modality"), F.col("p_partkey").alias("width"), i.alias("height")))
    return df.select("p_partkey", R.image_meta(F.lit("meta:"), F.slice(every, 1, F.col("p_size") % 4)).alias("meta"))


@query("c18_custom_sharegpt", f"""select image_id, 'Find ' || min(class_name) as question, rtrim(coalesce(string_agg('Reasoning: see ' || class_name || chr(10) || 'Visual question: which?' || chr(10) || 'Visual observation: ' || case when part % 3 = 0 then '' else 'box ' || part end, chr(10) order by object_index) filter (line <> 2), '')
  || case when image_id % 2 = 0 then case when count(*) filter (line <> 2) > 0 then chr(10) else '' end || 'Reasoning: so it is' else '' end) || chr(10) || '</think>' || chr(10) || min(class_name) as answer from ({B}) group by image_id""")
def _(spark, sf):
    """Second boxes are control rounds; some observations are null."""
    one = F.struct("object_index", F.struct(F.concat(F.lit("see "), "class_name").alias("thinking"), F.lit("which?").alias("visual_question"), F.when(F.col("part") % 3 > 0, F.concat(F.lit("box "), F.col("part").cast("string"))).alias("observation"), (F.col("line") == 2).alias("control_round")).alias("r"))
    g = objects(spark, sf).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"]).alias("rounds"), F.min("class_name").alias("teacher_forced_final"))
    g = g.withColumns({"id": F.col("image_id"), "query": F.concat(F.lit("Find "), "teacher_forced_final"), "final_thinking": F.when(F.col("image_id") % 2 == 0, "so it is"), "image_path": F.lit("x"), "task": F.lit("t"), "bucket": F.lit("strict")})
    return R.custom_sharegpt(g).select(F.col("id").alias("image_id"), F.get("messages", 0)["content"].alias("question"), F.get("messages", 1)["content"].alias("answer"))


_WHOLE = lambda v: f"cast(round_even(round_even(({v}) / 1000 * 1000, 4), 0) as int)"


@query("c19_rl_rows", f"""select image_id || '/' || object_index as id, 'Locate the object described by this referring expression: the ' || class_name as problem, concat_ws(',', {_WHOLE('cx - w/2')}, {_WHOLE('cy - h/2')}, {_WHOLE('cx + w/2')}, {_WHOLE('cy + h/2')}) as bbox,
 concat_ws(',', {_WHOLE('cx - w/2')}, {_WHOLE('cy - h/2')}, {_WHOLE('cx + w/2')}, {_WHOLE('cy - h/2')}, {_WHOLE('cx + w/2')}, {_WHOLE('cy + h/2')}, {_WHOLE('cx - w/2')}, {_WHOLE('cy + h/2')}) as obb from ({B})""")
def _(spark, sf):
    o = objects(spark, sf).select(F.concat_ws("/", *ID).alias("id"), F.concat(F.lit("the "), "class_name").alias("reference"), F.lit("x").alias("image_path"), "class_name", "class_id", G.corners().alias("points"), "image_width", "image_height")
    return R.rl_rows(o).select("answer.source_id", "problem", F.array_join("answer.bbox", ",").alias("bbox"), F.array_join("answer.obb", ",").alias("obb")).withColumnRenamed("source_id", "id")


@query("c27_grounding_samples", f"""select image_id, object_index, case when count(*) over (partition by image_id, class_name) = 1 then 'unique' else 'nonunique' end as ref_group, cx - w/2 as x1, cy + h/2 + greatest(tilt, 0) as y2,
 round(case part % 4 when 0 then cx when 1 then cx / 100 / 100 * 500 when 2 then cx / 10 / 100 * 500 else cx / 1000 * 500 end + case when part % 4 = 0 then 0 else 0 end, 6) as external from ({B})""")
def _(spark, sf):
    """Boxes of other sources in shares (of a hundredth), percent, thousandths or pixels of an image 500 wide."""
    o = objects(spark, sf).withColumns({"points": G.corners(tilt="tilt"), "gt_hbb": F.lit(None).cast("array<double>"), "coordinate_target": F.lit(None).cast("string")})
    n = o.groupBy("image_id", "class_name").agg(F.count(F.lit(1)).alias("same_class_count"))
    df = R.grounding_samples(o.join(n, ["image_id", "class_name"]))
    cx, k = F.col("cx"), F.col("part") % 4
    box = F.when(k == 0, F.array(cx, F.lit(1.0), F.lit(2000.0), F.lit(3.0))).when(k == 1, F.array(cx / 100 / 100, F.lit(0.0), F.lit(1.0), F.lit(1.0))).when(k == 2, F.array(cx / 10, F.lit(0.0), F.lit(2.0), F.lit(2.0))).otherwise(F.array(cx, F.lit(1.0), F.lit(900.0), F.lit(3.0)))
    return df.select(*ID, "ref_group", F.get("gt_hbb", 0).alias("x1"), F.get("gt_hbb", 3).alias("y2"), F.round(F.get(R.external_box(box, F.lit(500.0), F.lit(400.0)), 0), 6).alias("external"))


@query("c28_sharegpt_samples", f"""select image_id, object_index, 'where is ' || class_name as question, case part % 5 when 0 then 'obb' when 1 then 'hbb' when 2 then case when supp % 2 = 0 then 'obb' else 'vqa' end when 3 then 'hbb' else 'vqa' end as target_type, cast(part % 5 = 0 as int) as n_obb
 from ({B}) where line % 7 > 0 and line <> 6""")
def _(spark, sf):
    """Answers that are rotated boxes, boxes of four, or words, with tasks that decide for words; some rows lack the answer or the image."""
    k, n = F.col("part") % 5, lambda *v: F.concat_ws(",", *[x.cast("int").cast("string") for x in v])
    a, b, c, d = F.col("cx") - 5, F.col("cy") - 5, F.col("cx") + 5, F.col("cy") + 5
    answer = F.when(k == 0, F.concat(F.lit("<think>hm</think> "), "class_name", F.lit("|"), n(a, b, c, b, c, d, a, d))).when(k == 1, F.concat(F.lit("Answer: ["), n(a, b, c, d), F.lit("]"))).otherwise("over there")
    turn = lambda r, t: F.struct(F.lit(r).alias("role"), t.alias("content"))
    messages = F.array(turn("system", F.lit("s")), turn("human", F.concat(F.lit("where is "), "class_name")), turn("gpt", F.lit("first")), turn("human", F.lit("again")), turn("gpt", F.when(F.col("line") % 7 == 0, "").otherwise(answer)))
    task = F.when((k == 2) & (F.col("supp") % 2 == 0), "detection").when(k == 3, "visual_grounding")
    df = objects(spark, sf).select(F.concat_ws("/", *ID).alias("id"), *ID, messages.alias("messages"), F.when(F.col("line") == 6, F.array().cast("array<string>")).otherwise(F.array(F.lit("a.png"))).alias("images"), task.alias("task"), F.lit(2000).alias("width"), F.lit(2000).alias("height"))
    out = R.sharegpt_samples(df, "id").withColumn("p", F.split("id", "/"))
    return out.select(F.get("p", 0).cast("long").alias("image_id"), F.get("p", 1).cast("long").alias("object_index"), "question", "target_type", "n_obb")


@query("p6_tags_and_regions", """select p_partkey, case p_size % 6 when 0 then '<thinking>see ' || p_name || '</thinking> <question>what</question>' when 1 then '<thinking>' || p_name || '</thinking>' || chr(10) || '<question>what now</question>' when 2 then '<thinking>x</thinking>' || chr(10) || '[Final Answer]: ' || p_name
  when 3 then '<thinking>Format-normalized response based on the collected visual evidence.</thinking>' || chr(10) || '<question>' || p_name || '</question>' when 4 then p_name else '<thinking>see</thinking><question>' || p_name || '</question>' end as text, p_size % 6 not in (4, 5) as changed,
 case when p_size % 2 = 0 then 'In the focus region [hidden] and target ROI [hidden]: why?' else 'No numbers [1,2] here' end as hidden from part""")
def _(spark, sf):
    n, k = F.col("p_name"), F.col("p_size") % 6
    text = F.when(k == 0, F.concat(F.lit("```xml< Think >see "), n, F.lit("</ think > <question>what</question>```"))).when(k == 1, F.concat(n, F.lit(" [ question ]: what now "))).when(k == 2, F.concat(F.lit("<think>x</think>\n  final answer : "), n)).when(k == 3, F.concat(F.lit("[Question]:"), n)).when(k == 4, n).otherwise(F.concat(F.lit("<thinking>see</thinking><question>"), n, F.lit("</question>")))
    q = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("In the Focus Region around [ 1, 2.5,-3 ,"), F.col("p_partkey").cast("string"), F.lit("] and bbox_2d [1,2,3,4]: why?"))).otherwise("No numbers [1,2] here")
    return table(spark, sf, "part").select("p_partkey", R.canonical_tags(text).alias("c"), R.redact_regions(q).alias("hidden")).select("p_partkey", "c.text", "c.changed", "hidden")


_METRICS = """select 'detection' as source, p_brand as model, 'map50' as metric, cast(max(p_size) as {string}) as value from {part} group by p_brand
 union all select 'detection', p_brand, 'status', case when min(p_size) > 2 then 'VALID' else 'DEGRADED' end from {part} group by p_brand
 union all select 'classification', p_brand, 'accuracy', cast(count(*) as {string}) from {part} where p_size % 10 = 3 group by p_brand"""


@query("j12_compare_models", f"""with m as ({_METRICS.replace('{string}', 'varchar').replace('{part}', 'part')}), l as (select distinct p_brand as model from part union all select 'none')
 select 'run ' || l.model as experiment, l.model, max(value) filter (metric = 'status') as det_status, max(value) filter (metric = 'map50') as det_map50, max(value) filter (metric = 'accuracy') as cls_accuracy,
  array_to_string(list_filter(['detection', 'classification'], lambda s: not list_contains(coalesce(list(source), []), s)), ',') as missing from l left join m on l.model = m.model group by l.model""")
def _(spark, sf):
    part = table(spark, sf, "part")
    metrics = spark.sql(_METRICS.replace("{string}", "string"), part=part)
    labels = part.select(F.col("p_brand").alias("model")).distinct().union(spark.range(1).select(F.lit("none"))).select(F.concat(F.lit("run "), "model").alias("experiment"), "model")
    out = R.compare_models(labels, metrics, {"det_status": ("detection", "status"), "det_map50": ("detection", "map50"), "cls_accuracy": ("classification", "accuracy")})
    return out.withColumn("missing", F.array_join("missing", ","))


@query("a9_run_status", f"""with r as (select uid, count(*) as attempted, count(*) filter (event_type = 'view') as perceiver_calls, count(*) filter (event_type = 'error' and tokens > 80) as api_errors, count(*) filter (length = 5) as duplicate_questions, count(*) filter (event_type <> 'error') as total_grounding, count(*) filter (event_type = 'purchase') as strict_grounding,
  count(*) filter (event_type = 'purchase' or length = 3) as both_pass, count(*) filter (event_type = 'signup' and length > 6) as total_classification, count(*) filter (event_type = 'signup' and length > 7) as strict_classification, uid % 11 > 0 as log from ({E}) group by uid),
 f as (select uid, list_filter([case when not log then 'api_log_missing' when attempted > 0 and perceiver_calls = 0 then 'perceiver_calls=0' end, case when api_errors > 0 then 'api_errors=' || api_errors end], lambda x: x is not null) as hard,
  list_filter([case when total_grounding = 0 then 'no_grounding_samples' when strict_grounding / total_grounding < 0.3 then 'grounding_strict_rate=' || printf('%.3f', round(strict_grounding / total_grounding, 6)) || '<0.300' end,
   case when total_classification = 0 then 'no_classification_samples' when strict_classification / total_classification < 0.7 then 'classification_strict_rate=' || printf('%.3f', round(strict_classification / total_classification, 6)) || '<0.700' end, case when duplicate_questions > 0 then 'duplicate_questions=' || duplicate_questions end], lambda x: x is not null) as soft from r)
 select uid, case when len(hard) > 0 then 'FAIL' when len(soft) > 0 then 'WARN' else 'PASS' end as status, array_to_string(hard, ';') as hard, regexp_replace(array_to_string(soft, ';'), '=[0-9.]+', '=', 'g') as soft from f""")
def _(spark, sf):
    """A run for each user; rates are shown without figures, as the two engines write halves differently."""
    c = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    r = frame(spark, sf, ROLLOUTS).groupBy("uid").agg(
        F.count(F.lit(1)).alias("attempted"), c("event_type = 'view'", "perceiver_calls"), c("event_type = 'error' and tokens > 80", "api_errors"), c("length = 5", "duplicate_questions"), c("event_type <> 'error'", "total_grounding"), c("event_type = 'purchase'", "strict_grounding"),
        c("event_type = 'purchase' or length = 3", "both_pass"), c("event_type = 'signup' and length > 6", "total_classification"), c("event_type = 'signup' and length > 7", "strict_classification"),
    ).withColumn("log_present", F.col("uid") % 11 > 0)
    out = R.run_status(r, {"grounding": 0.3, "classification": 0.7}, ["api_errors"], ["duplicate_questions"])
    return out.select("uid", "status", F.array_join("hard_failures", ";").alias("hard"), F.regexp_replace(F.array_join("quality_failures", ";"), "=[0-9.]+", "=").alias("soft"))


def _lengths(s: str, t: str, c: int) -> str:
    most = f"(case when {t} * 2 < {c} then {c} when {s} * 2 < {c} then {c} - {s} else cast(floor({c} * ({t} / ({s} + {t}))) as bigint) end)"
    return f"least(greatest({c} - least({most}, {t}), 0), {s}) as {s}_n, least({most}, {t}) as {t}_n"


@query("k4_encode_feedback", f"""with t as (select doc_id, {_SPLIT_AT} from {_T}), l as (select doc_id, len(src) as s, len(case when doc_id % 3 > 0 then tgt else list_reverse(tgt)[:40] end) + 1 as t, doc_id % 3 > 0 as kto_tag from t),
 k as (select *, coalesce(lag(t) over (partition by doc_id // 16 order by doc_id), last_value(t) over (partition by doc_id // 16 order by doc_id rows between unbounded preceding and unbounded following)) as u from l),
 m as (select doc_id, kto_tag, {_lengths('s', 't', 300)} from k), n as (select doc_id, {_lengths('s', 'u', 300)} from k)
 select doc_id, kto_tag, m.s_n + t_n as n, -100 * m.s_n as masked, n.s_n + u_n as kl_n from m join n using (doc_id)""")
def _(spark, sf):
    """Two of three answers are desired; the others are cut and reversed. The answer of the row before is the mismatched one."""
    d = split_docs(spark, sf).withColumns({"prompt": F.col("src"), "desired": F.when(F.col("doc_id") % 3 > 0, F.col("tgt")), "undesired": F.when(F.col("doc_id") % 3 == 0, F.slice(F.reverse("tgt"), 1, 40)), "b": F.floor(F.col("doc_id") / 16)})
    d = O.kl_pairs(d.withColumn("both", F.struct("desired", "undesired")), "b", "doc_id", "both").withColumns({"kl_desired": F.col("kl_response.desired"), "kl_undesired": F.col("kl_response.undesired")})
    out = R.encode_feedback(d, 300, eos=2)
    masked = F.aggregate(F.filter("labels", lambda x: x == -100), F.lit(0).cast("long"), lambda a, v: a + v)
    return out.select("doc_id", "kto_tag", F.size("input_ids").cast("long").alias("n"), masked.alias("masked"), F.size("kl_input_ids").cast("long").alias("kl_n"))


@query("k4_feedback_counts", "select count(*) filter (doc_id % 3 > 0) as desirable, count(*) filter (doc_id % 3 = 0) as undesirable, false as one_kind from documents")
def _(spark, sf):
    d = split_docs(spark, sf).select(F.col("src").alias("prompt"), F.when(F.col("doc_id") % 3 > 0, F.array(F.lit(1))).alias("desired"), F.array(F.lit(2)).alias("undesired"), F.array(F.lit(1)).alias("kl_desired"), F.array(F.lit(2)).alias("kl_undesired"))
    return R.feedback_counts(R.encode_feedback(d, 300))


@query("u2_interleave_drawn", """with a as (select p_partkey as id, row_number() over (order by p_partkey) - 1 as r from part), b as (select c_custkey as id, row_number() over (order by c_custkey) - 1 as r from customer),
 n as (select (select count(*) from a) as na, (select count(*) from b) as nb), d as (select i, case when ('0x' || sha1('5||' || i)[1:8])::bigint / 4294967296.0 < 0.7 then 0 else 1 end as s from range(100000) t(i)),
 p as (select i, s, row_number() over (partition by s order by i) - 1 as k from d), e as (select min(i) as last from p, n where s = 0 and k = na - 1 or s = 1 and k = nb - 1)
 select i as place, s as source, coalesce(a.id, b.id) as id from p join e on i <= last left join a on s = 0 and k = a.r left join b on s = 1 and k = b.r""")
def _(spark, sf):
    """Parts with probability 0.7 and customers with 0.3, until one of the tables ends."""
    a, b = table(spark, sf, "part").select(F.col("p_partkey").alias("id")), table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return S.interleave_drawn([a, b], [0.7, 0.3], "id", seed=5).select("place", "source", "id")
