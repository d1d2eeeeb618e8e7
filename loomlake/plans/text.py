"""Queries of conversation, token and answer operators over ``conversations``, ``documents`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.operators import conversations as C, metrics as M, rewards as R, rules as U, tokens as K
from loomlake.plans.fixtures import frame

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def turns(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet")


def nested(spark, sf):
    return C.nest_turns(turns(spark, sf))


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


_N = "n as (select conv_id, list({'role': role, 'content': text} order by turn) as m from conversations group by conv_id)"
_A = f"""{_N}, s as (select conv_id, case when m[1].role = 'system' then m[1].content else '' end as sys, case when m[1].role = 'system' then m[2:] else m end as m from n),
 a as (select *, len(m) > 0 and len(m) % 2 = 0 and len(list_filter(m, lambda x, i: x.role <> (case when i % 2 = 1 then 'user' else 'assistant' end))) = 0 as ok from s)"""


@query("c2_align_sharegpt", f"with {_A} select conv_id, md5(sys) as sys, case when ok then len(m) - 1 else 0 end as n_prompt, case when ok then md5(m[-1].content) end as answer from a")
def _(spark, sf):
    df = C.align_sharegpt(nested(spark, sf))
    return df.select("conv_id", F.md5("_system").alias("sys"), F.size("_prompt").cast("long").alias("n_prompt"), F.md5(F.get("_response", 0)["content"]).alias("answer"))


@query("c3_nest_unnest", "select conv_id, row_number() over (partition by conv_id order by turn) - 1 as turn, role, md5(text) as text from conversations")
def _(spark, sf):
    return C.unnest_turns(nested(spark, sf)).select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query("c4_valid_examples", f"with {_A} select conv_id from a where ok")
def _(spark, sf):
    return C.valid_examples(C.align_sharegpt(nested(spark, sf))).select("conv_id")


@query("c1_align_alpaca", "select p_partkey, case when p_size % 2 = 0 then p_name || chr(10) || p_type else p_name end as prompt, case when p_size % 3 = 0 then '' else p_brand end as first_answer, 1 + cast(p_size % 3 < 2 as int) as n from part")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_name").alias("instruction"), F.expr("case when p_size % 2 = 0 then p_type else '' end").alias("input"), F.col("p_brand").alias("output"), F.expr("case when p_size % 3 = 0 then false when p_size % 3 = 1 then true end").alias("tag"))
    df = C.align_alpaca(df, kto_tag="tag")
    return df.select("p_partkey", F.get("_prompt", 0)["content"].alias("prompt"), F.get("_response", 0)["content"].alias("first_answer"), F.size("_response").alias("n"))


@query("c6_list_to_conversation", f"with {_N} select conv_id, len(m) - len(m) % 2 as n, md5(m[len(m) - len(m) % 2].content) as last from n where len(m) >= 2")
def _(spark, sf):
    df = nested(spark, sf).withColumn("c", C.list_to_conversation(F.transform("messages", lambda m: m["content"]))).where("c is not null")
    return df.select("conv_id", F.size("c").cast("long").alias("n"), F.md5(F.get("c", F.size("c") - 1)["content"]).alias("last"))


@query("c7_marked_text", f"with {_N} select conv_id, len(list_filter(m, lambda x: x.role <> 'system' and trim(x.content) <> '')) as n from n where len(list_filter(m, lambda x: x.role <> 'system')) > 0")
def _(spark, sf):
    parts = F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: F.concat(F.when(m["role"] == "user", "Human: ").otherwise("Assistant: "), m["content"]))
    df = nested(spark, sf).withColumn("p", parts).where(F.size("p") > 0)
    return df.select("conv_id", F.size(C.parse_marked_text(F.array_join("p", "\n"))).cast("long").alias("n"))


@query("c5_preference_dialogue", f"with {_A} select conv_id, md5(trim(m[-2].content)) as instruction, md5(trim(m[-1].content)) as chosen, 'no' as rejected, len(m) // 2 - 1 as n_history from a where ok")
def _(spark, sf):
    df = C.align_sharegpt(nested(spark, sf)).where(F.size("_response") == 1)
    head = F.array_join(F.transform("_prompt", lambda m: F.concat(F.when(m["role"] == "user", "\n\nHuman: ").otherwise("\n\nAssistant: "), m["content"])), "")
    df = df.select("conv_id", F.concat(head, F.lit("\n\nAssistant: "), F.get("_response", 0)["content"]).alias("chosen"), F.concat(head, F.lit("\n\nAssistant: no")).alias("rejected"))
    df = df.withColumn("p", C.preference_dialogue(F.col("chosen"), F.col("rejected")))
    return df.select("conv_id", F.md5("p.instruction").alias("instruction"), F.md5("p.chosen").alias("chosen"), "p.rejected", F.col("p.n_history").cast("long").alias("n_history"))


@query("c9_ensure_marker", "select conv_id, turn, md5(case when turn % 2 = 0 then '<image>' || chr(10) || text else '<image> ' || text end) as prefix, length(case when turn % 3 = 0 then text || ' <image>' else '<image>' || chr(10) || text end) as n from conversations")
def _(spark, sf):
    df = turns(spark, sf)
    some = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("<image> "), F.col("text")))
    other = F.when(F.col("turn") % 3 == 0, F.concat(F.col("text"), F.lit(" <image>"))).otherwise(F.col("text"))
    return df.select("conv_id", "turn", F.md5(C.ensure_marker(some)).alias("prefix"), F.length(C.ensure_marker(other, mode="contains")).cast("long").alias("n"))


_R = "'<think>' || text || '</think>' || chr(10) || case conv_id % 3 when 0 then 'Answer: ' when 1 then '[final answer]: ' else '' end || role || ' ' || turn"


def responses(spark, sf):
    mark = F.when(F.col("conv_id") % 3 == 0, "Answer: ").when(F.col("conv_id") % 3 == 1, "[final answer]: ").otherwise("")
    return turns(spark, sf).withColumn("r", F.concat(F.lit("<think>"), F.col("text"), F.lit("</think>\n"), mark, F.col("role"), F.lit(" "), F.col("turn").cast("string")))


@query("c13_final_text", "select conv_id, turn, role || ' ' || turn as final from conversations")
def _(spark, sf):
    return responses(spark, sf).select("conv_id", "turn", C.final_text(F.col("r")).alias("final"))


@query("c14_answer_tag", "select conv_id, turn, case when turn % 2 = 0 then role else 'turn ' || turn end as answer from conversations")
def _(spark, sf):
    df = turns(spark, sf)
    r = F.when(F.col("turn") % 2 == 0, F.concat(F.col("text"), F.lit("<answer>x</answer><answer> '"), F.col("role"), F.lit("'\n</answer>"))).otherwise(F.concat(F.lit("a\nturn "), F.col("turn").cast("string"), F.lit(" \n\n")))
    return df.select("conv_id", "turn", C.answer_tag(r).alias("answer"))


@query("c15_teacher_force", "select conv_id, turn, case when turn % 4 <> 0 then md5('<think>' || text || '</think>' || chr(10) || 'gold ' || role) end as forced from conversations")
def _(spark, sf):
    gold = F.when(F.col("turn") % 4 != 0, F.concat(F.lit(" gold "), F.col("role"))).otherwise(" ")
    return responses(spark, sf).select("conv_id", "turn", F.md5(C.teacher_force(F.col("r"), gold)).alias("forced"))


@query("c21_strip_thought", f"with {_N} select conv_id, sum(case when x.role = 'assistant' and i < len(m) then length(x.content) else length('<think>a' || chr(10) || 'b</think>' || chr(10) || x.content) end)::bigint as n from (select conv_id, m, unnest(m) as x, unnest(range(1, len(m) + 1)) as i from n) group by conv_id")
def _(spark, sf):
    df = nested(spark, sf).withColumn("messages", F.transform("messages", lambda m: C.message(m["role"], F.concat(F.lit("<think>a\nb</think>\n"), m["content"]))))
    df = df.withColumn("s", C.strip_thought(F.col("messages")))
    return df.select("conv_id", F.aggregate("s", F.lit(0), lambda a, m: a + F.length(m["content"])).cast("long").alias("n"))


@query("c20_render_chat", f"""with {_N} select conv_id, md5(string_agg(case x.role when 'system' then '<|im_start|>system' || chr(10) || x.content || '<|im_end|>' || chr(10)
 when 'user' then '<|im_start|>user' || chr(10) || x.content || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) else x.content || '<|im_end|>' || chr(10) end, '' order by i)) as text
 from (select conv_id, unnest(m) as x, unnest(range(1, len(m) + 1)) as i from n) group by conv_id""")
def _(spark, sf):
    return nested(spark, sf).select("conv_id", F.md5(C.render_chat(F.col("messages"), "chatml")).alias("text"))


@query("c22_tool_calls", "select conv_id, turn, case turn % 3 when 0 then 'look up' when 1 then 'find' end as name from conversations")
def _(spark, sf):
    df = turns(spark, sf)
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Action: look up\nAction Input: "), F.to_json(F.struct(F.col("role").alias("q"))))).when(F.col("turn") % 3 == 1, F.concat(F.lit('<tool_call>\n{"name": "find", "arguments": '), F.to_json(F.struct(F.col("turn").alias("k"))), F.lit("}\n</tool_call>"))).otherwise("Action: bad\nAction Input: {oops")
    return df.select("conv_id", "turn", F.get(C.tool_calls(text), 0)["name"].alias("name"))


@query("c23_media_consistency", f"with {_N} select conv_id, len(m) = conv_id % 4 as ok from n")
def _(spark, sf):
    df = nested(spark, sf).withColumn("messages", F.transform("messages", lambda m: C.message(m["role"], F.concat(F.lit("<image>"), F.translate(m["content"], "<", "")))))
    media = F.array_repeat(F.lit("a.png"), (F.col("conv_id") % 4).cast("int"))
    return df.select("conv_id", C.media_consistent(F.col("messages"), "<image>", media).alias("ok"))


# tokens: one for each word of a document
_T = "(select doc_id, list_transform(string_split(text, ' '), lambda w, i: cast((length(w) * 31 + i * 7) % 1000 as int)) as ids from documents)"


def tokens(spark, sf):
    return documents(spark, sf).select("doc_id", F.transform(F.split("text", " ", -1), lambda w, i: ((F.length(w) * 31 + (i + 1) * 7) % 1000).cast("int")).alias("ids"))


@query("k1_infer_seqlen", f"with t as (select doc_id, len(ids) as s, doc_id % 700 as t from {_T}), m as (select *, case when t * 2 < 512 then 512 when s * 2 < 512 then 512 - s else cast(floor(512 * (t / (s + t))) as bigint) end as most from t) select doc_id, least(greatest(512 - least(most, t), 0), s) as source_len, least(most, t) as target_len from m")
def _(spark, sf):
    df = tokens(spark, sf)
    s, t = K.infer_seqlen(F.size("ids"), (F.col("doc_id") % 700).cast("int"), 512)
    return df.select("doc_id", s.cast("long").alias("source_len"), t.cast("long").alias("target_len"))


def _ends(df, col):
    return [F.size(col).cast("long").alias("n"), F.aggregate(col, F.lit(0).cast("long"), lambda a, v: a + v).alias("total")]


_SPLIT_AT = "ids[: cast(floor(len(ids) * 0.6) as int)] as src, ids[cast(floor(len(ids) * 0.6) as int) + 1 :] as tgt"


def split_docs(spark, sf):
    at = F.floor(F.size("ids") * 0.6).cast("int")
    return tokens(spark, sf).select("doc_id", F.slice("ids", F.lit(1), at).alias("src"), F.slice("ids", at + 1, F.size("ids")).alias("tgt"))


@query("k5_encode_pair", f"""with t as (select doc_id, {_SPLIT_AT} from {_T}), l as (select *, len(src) as s, len(tgt) as t from t),
 m as (select *, case when t * 2 < 300 then 300 when s * 2 < 300 then 300 - s else cast(floor(300 * (t / (s + t))) as bigint) end as most from l),
 c as (select doc_id, src[: least(greatest(300 - least(most, t), 0), s)] as src, tgt[: least(most, t)] as tgt from m)
 select doc_id, len(src) + len(tgt) as n, cast(coalesce(list_sum(src), 0) + coalesce(list_sum(tgt), 0) as bigint) as total, cast(coalesce(list_sum(tgt), 0) as bigint) - 100 * len(src) as label_total from c""")
def _(spark, sf):
    df = K.encode_pair(split_docs(spark, sf), "src", "tgt", 300)
    return df.select("doc_id", *_ends(df, "input_ids"), F.aggregate("labels", F.lit(0).cast("long"), lambda a, v: a + v).alias("label_total"))


def _fitted(s: str, t: str, c: str) -> tuple[str, str]:
    """SQL of the source and target lengths that ``infer_seqlen`` leaves of lengths s and t within c."""
    most = f"(case when {t} * 2 < {c} then {c} when {s} * 2 < {c} then {c} - {s} else cast(floor({c} * ({t} / ({s} + {t}))) as bigint) end)"
    return f"least(greatest({c} - least({most}, {t}), 0), {s})", f"least({most}, {t})"


@query("k3_encode_pairwise", f"with t as (select doc_id, {_SPLIT_AT} from {_T}), l as (select doc_id, len(src) as s, len(tgt) as t from t) select doc_id, {' + '.join(_fitted('s', 't', '300'))} as n_chosen, {' + '.join(_fitted('s', 't', '300'))} as n_rejected from l")
def _(spark, sf):
    """Chosen and rejected encodings of one prompt; the rejected answer is the chosen one reversed."""
    df = split_docs(spark, sf).withColumn("rej", F.reverse("tgt"))
    df = K.encode_pair(K.encode_pair(df, "src", "tgt", 300, "chosen_"), "src", "rej", 300, "rejected_")
    return df.select("doc_id", F.size("chosen_input_ids").alias("n_chosen"), F.size("rejected_input_ids").alias("n_rejected"))


@query("k2_mask_labels", f"""with q as (select doc_id, len(ids) as n, greatest(len(ids) // 4, 1) as q from {_T}), l as (select doc_id, {', '.join(f'least(q, greatest(0, n - {k} * q)) as p{k}' for k in range(4))} from q),
 a as (select *, {_fitted('p2', 'p3', '256')[0]} as s2, {_fitted('p2', 'p3', '256')[1]} as t2 from l), r as (select *, 256 - s2 - t2 as room from a)
 select doc_id, s2 + t2 + case when room <= 0 then 0 else {' + '.join(_fitted('p0', 'p1', 'room'))} end as n, t2 as n_labels from r""")
def _(spark, sf):
    """Turn pairs of a document's quarters; tests hold the masks against a loop."""
    q = F.greatest(F.floor(F.size("ids") / 4), F.lit(1)).cast("int")
    part = lambda k: F.slice("ids", (q * k + 1).cast("int"), q)
    df = tokens(spark, sf).withColumn("pairs", F.array(*[F.struct(part(2 * i).alias("source"), part(2 * i + 1).alias("target")) for i in (0, 1)]))
    df = K.mask_labels(df, "pairs", 256, mask_history=True)
    return df.select("doc_id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != K.IGNORE)).alias("n_labels"))


@query("k6_pack_blocks", f"""with t as (select doc_id, doc_id % 20 as b, ids from {_T}), o as (select b, unnest(ids) as id, unnest(range(len(ids))) as i, doc_id from t),
 p as (select b, id, row_number() over (partition by b order by doc_id, i) - 1 as pos, count(*) over (partition by b) as n from o)
 select b, pos // 512 as block, cast(sum(id) as bigint) as total, count(*) as n from p where pos // 512 < n // 512 group by all""")
def _(spark, sf):
    df = K.pack_blocks(tokens(spark, sf).withColumn("b", F.col("doc_id") % 20), "b", "doc_id", "ids", 512)
    return df.select("b", "block", F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.size("input_ids").cast("long").alias("n"))


@query("k7_pack_knapsack")
def _(spark, sf):
    """Greedy packs of each batch of documents; tests hold it against the contract."""
    df = tokens(spark, sf).select("doc_id", F.floor(F.col("doc_id") / 1000).alias("batch"), F.size("ids").alias("n"))
    return K.pack_knapsack(df, "batch", "doc_id", "n", 1024)


@query("k7_packed_rows", f"""with t as (select doc_id // 500 as batch, len(ids) as n, cast(list_sum(ids) as bigint) as total from {_T})
 select batch, cast(sum(n) as bigint) as tokens, cast(sum(total) as bigint) as total, cast(sum(n * (n - 1) // 2) as bigint) as places, count(*) as rows from t where n <= 1024 group by batch""")
def _(spark, sf):
    """What all packs of a batch hold together: tokens, their sum, their positions, and rows."""
    df = tokens(spark, sf).select("doc_id", F.floor(F.col("doc_id") / 500).alias("batch"), "ids", F.size("ids").alias("n"))
    packs = K.packed_rows(K.pack_knapsack(df, "batch", "doc_id", "n", 1024), df, "batch", "doc_id", "ids", 1024)
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    per = packs.where((F.size("input_ids") == 1024) & (F.size("attention_mask") == 1024)).select("batch", F.size(F.filter("attention_mask", lambda v: v > 0)).alias("tokens"), add(F.col("input_ids")).alias("total"), add(F.col("position_ids")).alias("places"), F.array_max("attention_mask").alias("rows"))
    return per.groupBy("batch").agg(*[F.sum(c).alias(c) for c in ("tokens", "total", "places", "rows")])


@query("k2_mask_labels_eos", f"""with q as (select doc_id, len(ids) as n, greatest(len(ids) // 4, 1) as q from {_T}), l as (select doc_id, {', '.join(f'least(q, greatest(0, n - {k} * q)) as p{k}' for k in range(4))} from q),
 a as (select *, {_fitted('p0', 'p1', '255')[0]} as s1, {_fitted('p0', 'p1', '255')[1]} as t1 from l), r as (select *, 255 - s1 - t1 as room from a),
 f as (select *, case when room <= 0 then 0 else {_fitted('p2', 'p3', 'room')[0]} end as s2, case when room <= 0 then 0 else {_fitted('p2', 'p3', 'room')[1]} end as t2 from r)
 select doc_id, s1 + t1 + s2 + t2 + 1 as n, t1 + t2 + 1 + cast(s2 > 0 as int) as n_labels from f""")
def _(spark, sf):
    """The same pairs with the end of a turn as a label, and at the end of the row."""
    q = F.greatest(F.floor(F.size("ids") / 4), F.lit(1)).cast("int")
    part = lambda k: F.slice("ids", (q * k + 1).cast("int"), q)
    df = tokens(spark, sf).withColumn("pairs", F.array(*[F.struct(part(2 * i).alias("source"), part(2 * i + 1).alias("target")) for i in (0, 1)]))
    df = K.mask_labels(df, "pairs", 256, eos=2)
    return df.select("doc_id", F.size("input_ids").alias("n"), F.size(F.filter("labels", lambda x: x != K.IGNORE)).alias("n_labels"))


@query("k8_pad_truncate", f"select doc_id, cast(list_sum(ids[:64]) as bigint) as head, cast(list_sum(ids[greatest(1, len(ids) - 63):]) as bigint) as tail, 64 as n from {_T}")
def _(spark, sf):
    right, left = K.pad_truncate(F.col("ids"), 64), K.pad_truncate(F.col("ids"), 64, side="left")
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return tokens(spark, sf).select("doc_id", add(right).alias("head"), add(left).alias("tail"), F.size(left).alias("n"))


@query("k9_thumbnails", "select doc_id, least(doc_id % 3, doc_id % 5) as n from documents")
def _(spark, sf):
    flags = K.thumbnail_flags((F.col("doc_id") % 3).cast("int"), (F.col("doc_id") % 5).cast("int"))
    return documents(spark, sf).select("doc_id", F.size(F.filter(flags, lambda x: x)).cast("long").alias("n"))


@query("f16_filter_overlong", f"select doc_id from {_T} where len(ids) <= 200")
def _(spark, sf):
    return K.filter_overlong(tokens(spark, sf), F.size("ids"), 200).select("doc_id")


@query("a20_length_cdf", f"with h as (select (len(ids) // 100) * 100 as bucket, count(*) as n from {_T} group by 1) select bucket, n, round(sum(n) over (order by bucket) / sum(n) over (), 6) as cdf from h")
def _(spark, sf):
    return M.length_cdf(tokens(spark, sf), F.size("ids"), 100).select("bucket", "n", F.round("cdf", 6).alias("cdf"))


@query("a22_perplexity", "select vec_id, round(exp(list_avg(list_transform(embedding, lambda x: abs(x)::double))), 4) as ppl from embeddings")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("logp", F.transform("embedding", lambda x: -F.abs(x).cast("double")))
    return M.perplexity(df, "vec_id", "logp").select("vec_id", F.round("ppl", 4).alias("ppl"))


@query("a24_token_accuracy", f"with t as (select doc_id, unnest(ids) as id, unnest(range(len(ids))) as i, len(ids) as n from {_T}) select doc_id, count(*) filter (i > 0 and i % 5 <> 0) as n, round(count(*) filter (i > 0 and i % 5 <> 0 and i % 3 <> 0) / greatest(1, count(*) filter (i > 0 and i % 5 <> 0)), 6) as accuracy from t group by doc_id")
def _(spark, sf):
    """Predictions miss every third label; every fifth label is ignored."""
    df = tokens(spark, sf).withColumn("labels", F.transform("ids", lambda t, i: F.when(i % 5 == 0, K.IGNORE).otherwise(t)))
    df = df.withColumn("pred", F.transform("ids", lambda t, i: F.when((i + 1) % 3 == 0, -1).otherwise(F.coalesce(F.get("ids", i + 1), F.lit(-2)))))
    return M.token_accuracy(df, "pred", "labels").select("doc_id", F.col("n").cast("long").alias("n"), F.round("accuracy", 6).alias("accuracy"))


# answers: the part's size as ground truth, answers right, reworded or wrong
_P = "(select p_partkey, cast(p_size as varchar) as gt, case p_partkey % 4 when 0 then 'The answer is: ' || p_size when 1 then p_size || '.0' when 2 then 'maybe ' || (p_size + 1) else p_name end as pred, p_name, p_size from part)"


def answers(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_size", F.col("p_size").cast("string").alias("gt"), F.expr("case p_partkey % 4 when 0 then concat('The answer is: ', p_size) when 1 then concat(p_size, '.0') when 2 then concat('maybe ', p_size + 1) else p_name end").alias("pred"))


@query("a18_vqa_score", f"select p_partkey, p_partkey % 4 = 0 or (p_partkey % 4 = 3 and trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) = gt) as exact_or_number from {_P}")
def _(spark, sf):
    df = answers(spark, sf)
    return df.select("p_partkey", (U.answer_score(F.col("pred"), F.col("gt")) != "wrong").alias("exact_or_number"))


@query("a18_token_f1", """with w as (select p_partkey, string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ') as a, string_split(trim(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')), ' ') as b from part),
 x as (select p_partkey, len(a) as na, len(b) as nb, list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda y: y = t)), len(list_filter(b, lambda y: y = t))))) as i from w)
 select p_partkey, round(2 * (i / na) * (i / nb) / greatest(i / na + i / nb, 1e-9), 6) as f1 from x""")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet")
    return df.select("p_partkey", F.round(U.token_f1(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")), 6).alias("f1"))


@query("f1_answer_kind", f"select p_partkey, case when regexp_full_match(pred, '[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)(e[+-]?[0-9]+)?') then 'number' when pred in ('yes', 'no') then 'yes_no' else 'other' end as kind from {_P}")
def _(spark, sf):
    return answers(spark, sf).select("p_partkey", U.answer_kind(F.col("pred")).alias("kind"))


@query("f6_repeated_sentence", r"""with s as (select doc_id, trim(regexp_replace(lower(unnest(regexp_split_to_array(text, '[.!?\n]+'))), '\s+', ' ', 'g')) as s from documents),
 n as (select doc_id, s, count(*) as n from s where len(string_split(s, ' ')) >= 7 group by all)
 select doc_id, coalesce(max(n) >= 3, false) as repeated from documents left join n using (doc_id) group by doc_id""")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", U.repeated_sentence(F.col("text")).alias("repeated"))


@query("f2_reference_flags", """with t as (select l_orderkey as id, l_linenumber, case l_linenumber % 5 when 0 then 'the second ship' when 1 then 'ship at (10, 20)' when 2 then 'the leftmost of its class' when 3 then 'the area area on top' else 'the ship in the central area' end as s from lineitem)
 select id, l_linenumber as line, case l_linenumber % 5 when 0 then 'ordinal' when 1 then 'coordinates' when 2 then 'of_its_class' when 3 then 'area_area' else '' end as flags from t""")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"))
    text = F.get(F.array(*map(F.lit, ["the second ship", "ship at (10, 20)", "the leftmost of its class", "the area area on top", "the ship in the central area"])), (F.col("line") % 5).cast("int"))
    return df.select("id", "line", F.array_join(U.reference_flags(text), ",").alias("flags"))


@query("f15_required_fields", "select doc_id, case when doc_id % 7 = 0 then 'lang' else '' end as missing from documents")
def _(spark, sf):
    df = documents(spark, sf).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("lang")))
    return df.select("doc_id", F.array_join(U.missing_fields(["text", "lang", "source"]), ",").alias("missing"))


@query("f14_validate_sft", f"with {_N} select reason, count(*) as n from (select unnest(list_filter([case when len(m) < 2 then 'too_few_messages' end, case when m[-1].role <> 'assistant' then 'last_not_assistant' end, case when trim(m[-1].content) = '' then 'blank_answer' end], lambda x: x is not null)) as reason from n) group by reason")
def _(spark, sf):
    df = nested(spark, sf).withColumn("reason", F.explode(U.sft_reasons(F.col("messages"))))
    return df.groupBy("reason").agg(F.count("*").alias("n"))


_ASKED = "concat(case p_size % 6 when 0 then 'Give the bounding  box ' when 1 then 'Which rotated box ' when 2 then 'Give all four corners ' when 3 then 'State the location ' when 4 then 'Is the position top-left or bottom-right ' else 'What is there ' end, 'of the ', p_name, ', ', lower(p_type), ' in ', case p_size % 5 when 0 then 'size' when 1 then 'colour and material' when 2 then 'direction' when 3 then 'outline' else 'view' end, '?')"


@query("f19_question_kind", rf"""with q as (select p_partkey, regexp_replace(lower({_ASKED}), '\s+', ' ', 'g') as q from part)
 select p_partkey, case when not regexp_matches(q, '\b(coordinate|coordinates|bbox|bounding box|box_2d|hbb|obb|corner|corners|polygon|position|location|extent|envelope|locali[sz])\b') then 'none'
  when regexp_matches(q, '\b(?:obb(?:_8)?|rotated\s+(?:box|bounding\s+box)|polygon|four\s+corners?|clockwise)\b') then 'obb'
  when regexp_matches(q, '\b(?:bbox(?:_2d)?|box_2d|bounding\s+box|coarse\s+(?:box|hbb)|axis[- ]aligned|envelope|top[- ]left.*bottom[- ]right)\b') then 'bbox' else 'either' end as coordinates,
  case when regexp_matches(q, 'shape|outline|geometry|boundary|form') then 'shape' when regexp_matches(q, 'part|wing|tail|deck|roof|island|support') then 'parts' when regexp_matches(q, 'orient|direction|axis|horizontal|vertical|diagonal') then 'orientation'
   when regexp_matches(q, 'size|scale|length|width|relative|larger|smaller') then 'scale' when regexp_matches(q, 'surface|texture|color|material|reflective') then 'surface' when regexp_matches(q, 'marking|line|stripe|lane|goal|net') then 'markings'
   when regexp_matches(q, 'surround|adjacent|beneath|support|road|water|paved') then 'context' else 'other' end as dimension from q""")
def _(spark, sf):
    q = F.expr(_ASKED)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", U.coordinate_kind(q).alias("coordinates"), U.visual_dimension(q).alias("dimension"))


# rewards: responses with a box or number in them, made from part rows
_BOXED = "'<think>Let me look. wait, more words.</think> so \\boxed{0.1, 0.2, ' || (0.3 + (p_size % 5) / 10.0) || ', 0.6}'"


def boxed(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_size").cast("int").alias("size"))
    return df.withColumn("response", F.concat(F.lit("<think>Let me look. wait, more words.</think> so \\boxed{0.1, 0.2, "), F.format_string("%.1f", F.lit(0.3) + F.col("size") % 5 / 10), F.lit(", 0.6}")))


@query("r1_box_reward", """with p as (select p_partkey, p_size % 5 as k, 0.3 + (p_size % 5) / 10.0 as x2 from part),
 i as (select *, (least(x2, 0.5) - 0.1) * 0.4 / ((x2 - 0.1) * 0.4 + 0.16 - (least(x2, 0.5) - 0.1) * 0.4) as iou, abs((x2 + 0.1) / 2 - 0.3) as d, sqrt(0.32) / 2 as r from p)
 select p_partkey, round(iou, 6) as iou, round(0.8 * least(1, exp(iou * 5 - 1) / (exp(5) - 1)) + 0.2 * r / greatest(d, r), 6) as accuracy, round((exp(case when k < 3 then 5 else 4 end) - 1) / (exp(5) - 1), 6) as format from i""")
def _(spark, sf):
    df = boxed(spark, sf).withColumn("words", F.when(F.col("size") % 5 < 3, 10).otherwise(3))
    gt = [F.lit(v) for v in (0.1, 0.2, 0.5, 0.6)]
    df = R.box_reward(df, "response", gt, opening=F.lit("let me"), words=F.col("words"), waits=F.lit(1))
    return df.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("iou", "accuracy", "format")])


@query("r1_box_reward_adjusted", """with p as (select p_partkey, p_size % 5 as k, 0.3 + (p_size % 5) / 10.0 as x2, (p_size % 9) / 10.0 as e from part),
 i as (select *, (least(x2, 0.5) - 0.1) * 0.4 / ((x2 - 0.1) * 0.4 + 0.16 - (least(x2, 0.5) - 0.1) * 0.4) as iou, abs((x2 + 0.1) / 2 - 0.3) as d, sqrt(0.32) / 2 as r from p),
 a as (select *, 0.8 * least(1, exp(iou * 5 - 1) / (exp(5) - 1)) + 0.2 * r / greatest(d, r) as raw, (exp(case when k < 3 then 5 else 4 end) - 1) / (exp(5) - 1) as format from i)
 select p_partkey, round(raw, 6) as accuracy_raw, round((raw - e) / (1 - e), 6) as accuracy, round(case when k < 3 then 1 else 0.67 + 0.33 * 0.5 end, 6) as thinking, round(0.9 * (raw - e) / (1 - e) + 0.1 * format, 6) as overall from a""")
def _(spark, sf):
    df = boxed(spark, sf).withColumns({"words": F.when(F.col("size") % 5 < 3, 10).otherwise(3), "e": F.col("size") % 9 / 10})
    df = R.box_reward(df, "response", [F.lit(v) for v in (0.1, 0.2, 0.5, 0.6)], opening=F.lit("let me"), words=F.col("words"), waits=F.lit(1), expected=F.col("e"))
    return df.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("accuracy_raw", "accuracy", "thinking", "overall")])


@query("r6_class_box_reward", """with p as (select p_partkey, p_partkey % 3 as k, 100 + p_size % 50 as x from part),
 i as (select *, (300.0 - x) / (300 - 100 + x - 100) as iou from p)
 select p_partkey, case k when 2 then 0 when 1 then 0.5 else 1 end as format, case k when 0 then 1 else 0 end as class_score, round(case when k = 2 then 0 else iou end, 6) as iou, round(0.1 * (case k when 2 then 0 when 1 then 0.5 else 1 end) + 0.2 * (case k when 0 then 1 else 0 end) + 0.7 * (case when k = 2 then 0 else iou end), 6) as overall from i""")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.lit(100) + F.col("p_size") % 50).alias("x"), (F.col("p_partkey") % 3).alias("k"))
    body = F.concat(F.lit('Answer: {"class_name": "'), F.when(F.col("k") == 0, "ship").otherwise("plane"), F.lit('", "bbox": ['), F.col("x").cast("string"), F.lit(", 0, "), (F.col("x") + 200).cast("string"), F.lit(", 100]}"))
    df = df.withColumn("response", F.when(F.col("k") == 0, F.concat(F.lit("<think>x</think>\n"), body)).when(F.col("k") == 1, body).otherwise("Answer: none"))
    return R.class_box_reward(df, "response", F.lit("ship"), [F.lit(v) for v in (100.0, 0.0, 300.0, 100.0)]).select("p_partkey", "format", "class_score", F.round("iou", 6).alias("iou"), F.round("overall", 6).alias("overall"))


@query("r8_numeric_reward", """with p as (select p_partkey, p_size as k, p_size + p_partkey % 5 as x from part)
 select p_partkey, round(greatest(0, least(1, 1 - (exp(abs(x - k)) - 1) / (exp(abs(k)) - 1))), 6) as accuracy, 1 as format from p""")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_size").cast("string").alias("gt"), F.concat(F.lit("<think>a</think> \\boxed{"), (F.col("p_size") + F.col("p_partkey") % 5).cast("string"), F.lit("} ok")).alias("response"))
    return df.select("p_partkey", F.round(R.numeric_accuracy(R.boxed_content(F.col("response")), F.col("gt")), 6).alias("accuracy"), R.format_flag(F.col("response"), "boxed").alias("format"))


@query("r9_format_flags", "select doc_id, cast(doc_id % 2 = 0 as int) as answer, cast(doc_id % 3 = 0 as int) as boxed from documents")
def _(spark, sf):
    k = F.col("doc_id")
    a = F.when(k % 2 == 0, "<think>a\nb</think>\n <answer>c</answer>").otherwise("x<think>a</think><answer>c</answer>")
    b = F.when(k % 3 == 0, "<think>a</think> \\boxed{1} end").otherwise("\\boxed{1}")
    return documents(spark, sf).select("doc_id", R.format_flag(a, "answer").alias("answer"), R.format_flag(b, "boxed").alias("boxed"))


def _nested(sql: str, steps, form: str) -> str:
    """``form`` (with {x}, {old}, {new}) around ``sql`` once for each step."""
    for old, new in steps:
        q = lambda v: "'" + v.replace("'", "''") + "'"
        sql = form.replace("{x}", sql).replace("{old}", q(old)).replace("{new}", q(new))
    return sql


# answers in many notations and the truth in one; chr(92) is a backslash in either engine
_SAID = """case p_partkey % 7 when 0 then concat('$', chr(92), 'boxed{', p_size, '}$ feet') when 1 then concat('x = ', chr(92), 'frac', p_size % 9 + 1, p_partkey % 5 + 1) when 2 then concat('1,', 100 + p_size, ' dollars')
 when 3 then concat(chr(92), 'text{', p_name, '}.$') when 4 then concat('a ', p_name, ' in ', p_size, ' square km') when 5 then concat(chr(92), 'sqrt', p_size, '^', chr(92), 'circ') else concat('"', p_type, '"  or an ', p_brand) end"""
_TRUE = """case p_partkey % 7 when 0 then concat(p_size, '') when 1 then concat(chr(92), 'frac{', p_size % 9 + 1, '}{', p_partkey % 4 + 1, '}') when 2 then concat('1', 100 + p_size, '')
 when 3 then p_name when 4 then concat(p_name, 'in', p_size) when 5 then concat(chr(92), 'sqrt{', p_size % 10, '}') else concat(p_type, 'or', p_brand) end"""


def _normal(sql: str) -> str:
    out = _nested(f"string_split({sql}, '=')[-1]", [*R.REPLACED, *((r, "") for r in R.REMOVED)], "replace({x}, {old}, {new})")
    wrappers = [(r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), *((rf"(\\{w}\{{)(.*?)(\}})", r"\2") for w in ("text", "textbf", "overline")), (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"), (r"(sqrt)([^{])", r"sqrt{\2}")]
    return f"replace({_nested(out, wrappers, "regexp_replace({x}, {old}, {new}, 'g')")}, '$', '')"


@query("r7_answer_reward", f"""with p as (select p_partkey, p_size * 10 as n, case when p_partkey % 11 > 0 then {_normal(_SAID)} else '[INVALID]' end as said, {_normal(_TRUE)} as truth from part),
 t as (select *, trim(case when regexp_full_match(replace(said, ',', ''), '[0-9]+') then replace(said, ',', '') else said end) as a, trim(case when regexp_full_match(replace(truth, ',', ''), '[0-9]+') then replace(truth, ',', '') else truth end) as b from p),
 s as (select p_partkey, case when a = b then 1.0 else -1.0 end as accuracy, case when n <= 300 then 0.0 when n <= 400 then (300 - n) / 100.0 else -1.0 end as overlong from t)
 select p_partkey, accuracy, round(overlong, 6) as overlong, round(accuracy + 0.5 * overlong, 6) as overall, (accuracy + 1) / 2 as accuracy_normalized from s""")
def _(spark, sf):
    said = F.concat(F.lit("Answer: 0 at first\nanswer : "), F.expr(_SAID), F.lit("\nend"))
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_size") * 10).alias("n"), F.when(F.col("p_partkey") % 11 > 0, said).otherwise("no more").alias("response"), F.expr(_TRUE).alias("truth"))
    return R.answer_reward(df, "response", "truth", "n", 400, 100, 0.5).select("p_partkey", "accuracy", F.round("overlong", 6).alias("overlong"), F.round("overall", 6).alias("overall"), "accuracy_normalized")


@query("r5_box_tag_accuracy", """with p as (select p_partkey, p_partkey % 4 as k, 0.3 + (p_size % 5) / 10.0 as x2 from part),
 i as (select *, (least(x2, 0.5) - 0.1) * 0.4 / ((x2 - 0.1) * 0.4 + 0.16 - (least(x2, 0.5) - 0.1) * 0.4) as iou from p)
 select p_partkey, round(case when k < 2 then iou else 0 end, 6) as iou, round(case when k < 2 then least(1, exp(2.5 * iou - 1) / (exp(2.5) - 1)) else 0 end, 6) as accuracy from i""")
def _(spark, sf):
    k, x2 = F.col("p_partkey") % 4, F.format_string("%.1f", F.lit(0.3) + F.col("p_size") % 5 / 10)
    box = lambda *v: F.concat(F.lit("<|box_start|> "), F.concat_ws(", ", *v), F.lit(" <|box_end|>"))
    n = {v: F.lit(v) for v in ("0.1", "0.2", "0.6", "nan")}
    some = F.when(k == 0, box(n["0.1"], n["0.2"], x2, n["0.6"])).when(k == 1, box(x2, n["0.6"], n["0.1"], n["0.2"])).when(k == 2, box(n["0.1"], n["0.2"], x2)).otherwise(box(n["0.1"], n["0.2"], x2, n["nan"]))
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.concat(F.lit("<think>"), box(n["0.2"]), F.lit("</THINK> at "), some).alias("response"))
    return R.box_tag_accuracy(df, "response", [F.lit(v) for v in (0.1, 0.2, 0.5, 0.6)]).select("p_partkey", F.round("iou", 6).alias("iou"), F.round("accuracy", 6).alias("accuracy"))


#: Responses of boxes of 0 to 1000 in five layouts: c and d are the far corner.
_LAYOUTS = "(select *, p_partkey % 6 as k, 300 + p_size as c, 700 - p_size as d, (p_size % 10) / 20.0 as e from part)"
_OVERLAP = "(least(c, 320) - 100) * (least(d, 680) - 200) as i, (c - 100) * (d - 200) + 220.0 * 480 as s"


def layouts(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_partkey") % 6).alias("k"), (300 + F.col("p_size")).alias("c"), (700 - F.col("p_size")).alias("d"), (F.col("p_size") % 10 / 20).alias("e"))
    box = F.concat(F.lit("[100, 200, "), F.col("c").cast("string"), F.lit(", "), F.col("d").cast("string"), F.lit("]"))
    j = F.concat(F.lit('{"bbox": '), box, F.lit("}"))
    k = F.col("k")
    text = F.when(k == 0, F.concat(F.lit("<think> look </think> Answer: "), j)).when(k == 1, F.concat(F.lit("< think >look< / think >"), j)).when(k == 2, F.concat(F.lit("<think>"), F.replace(j, F.lit('"'), F.lit("")), F.lit(" "), j, F.lit("</think> Answer: none"))).when(k == 3, F.concat(F.lit("done</think> answer: at "), box)).when(k == 4, j).otherwise(F.concat(F.lit("<think>x</think> [1, 2] Answer: { bbox: "), box, F.lit("}")))
    return df.select("p_partkey", "e", text.alias("response"), F.array(*[F.lit(v) for v in (100.0, 200.0, 320.0, 680.0)]).alias("truth"))


@query("r3_json_box_reward", f"""with p as (select *, {_OVERLAP} from {_LAYOUTS}), i as (select *, case when k < 2 then i / (s - i) else 0 end as iou from p),
 f as (select *, case when k < 2 then least(1, exp(2.5 * iou - 1) / (exp(2.5) - 1)) else 0 end as raw, case k when 0 then 1.0 when 1 then 2 / 3.0 when 2 then 1 / 3.0 when 5 then 2 / 3.0 else 0 end as format from i)
 select p_partkey, round(iou, 6) as iou, round((raw - e) / (1 - e), 6) as accuracy, round(format, 6) as format_total, round(0.9 * (raw - e) / (1 - e) + 0.1 * format, 6) as overall from f""")
def _(spark, sf):
    df = R.json_box_reward(layouts(spark, sf), "response", "truth", F.col("e"))
    return df.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("iou", "accuracy", "format_total", "overall")])


@query("r4_answer_box_reward", f"""with p as (select *, {_OVERLAP} from {_LAYOUTS}), i as (select *, case when k in (0, 1, 3, 5) then i / (s - i) else 0 end as iou from p),
 f as (select *, case k when 0 then 1.0 when 1 then 1.0 when 2 then 0.25 when 3 then 0.25 when 5 then 1.0 else 0 end as format from i)
 select p_partkey, round(iou, 6) as iou, k = 3 as fallback, round((iou - e) / (1 - e), 6) as accuracy, format as format_total, round(0.9 * (iou - e) / (1 - e) + 0.1 * format, 6) as overall from f""")
def _(spark, sf):
    df = R.answer_box_reward(layouts(spark, sf), "response", "truth", F.col("e"))
    return df.select("p_partkey", "fallback", *[F.round(c, 6).alias(c) for c in ("iou", "accuracy", "format_total", "overall")])


@query("p7_response_boxes", f"""select p_partkey, case when k < 2 then c end as json, case when k in (0, 1, 3, 5) then c end as answer, k = 3 as fallback from {_LAYOUTS}""")
def _(spark, sf):
    """The far corner's x as two of the conventions read it."""
    t = layouts(spark, sf).withColumn("t", R.tight(F.col("response")))
    return t.select("p_partkey", F.get(R.response_box(F.col("t"), "json")["box"], 2).alias("json"), F.get(R.response_box(F.col("t"), "answer")["box"], 2).alias("answer"), R.response_box(F.col("t"), "answer")["fallback"].alias("fallback"))


@query("r2_iou_reward", """with p as (select p_partkey, p_size % 5 as k, 0.3 + (p_size % 5) / 10.0 as x2, case when p_size % 5 < 3 then 10 else 3 end as words, p_size % 3 as waits from part),
 i as (select *, (least(x2, 0.5) - 0.1) * 0.4 / ((x2 - 0.1) * 0.4 + 0.16 - (least(x2, 0.5) - 0.1) * 0.4) as iou, 3 + cast(words >= 6 as int) + cast(waits = 1 as int) as m from p)
 select p_partkey, round(iou, 6) as iou, m as format_m, round((exp(iou) - 1) / (exp(1) - 1), 6) as accuracy_raw, round(0.34 + 0.33 * least(1, words / 6.0) + 0.33 * case waits when 0 then 0 when 1 then 1 else 0.5 end, 6) as thinking, round(0.9 * iou + 0.1 * (exp(m) - 1) / (exp(5) - 1), 6) as overall from i""")
def _(spark, sf):
    """Six words and one wait are there; budgets and waits asked for vary."""
    df = boxed(spark, sf).withColumns({"words": F.when(F.col("size") % 5 < 3, 10).otherwise(3), "waits": F.col("size") % 3, "truth": F.array(*[F.lit(v) for v in (0.1, 0.2, 0.5, 0.6)])})
    df = R.iou_reward(df, "response", "truth", F.lit(" 'Let  me' "), F.col("words"), F.col("waits"), F.lit(0.1))
    return df.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("iou", "accuracy_raw", "thinking", "overall")], "format_m")


@query("r6_class_obb_reward", """with p as (select p_partkey, p_partkey % 4 as k, 100 + p_size % 50 as x from part), i as (select *, case when k in (0, 1) then (300.0 - x) / (100 + x) else 0 end as iou from p)
 select p_partkey, case k when 3 then 0 when 1 then 0.5 else 1 end as format, case when k in (0, 2) then 1 else 0 end as class_score, round(iou, 6) as iou, round(0.1 * (case k when 3 then 0 when 1 then 0.5 else 1 end) + 0.2 * case when k in (0, 2) then 1 else 0 end + 0.7 * iou, 6) as overall from i""")
def _(spark, sf):
    """Boxes moved to the right, one of six numbers, one answer without an object."""
    x, k = F.col("x"), F.col("k")
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.lit(100) + F.col("p_size") % 50).alias("x"), (F.col("p_partkey") % 4).alias("k"))
    numbers = F.concat_ws(", ", x, F.lit(0), x + 200, F.lit(0), x + 200, F.lit(100), *[F.when(k != 2, v) for v in (x, F.lit(100))])
    body = F.concat(F.lit('Answer: {"class_name": "'), F.when(k == 1, "plane").otherwise("Storage_Tank"), F.lit('", "obb": ['), numbers, F.lit("]}"))
    df = df.withColumn("response", F.when(k == 1, body).when(k == 3, "Answer: none").otherwise(F.concat(F.lit("<think>x</think>\n"), body)))
    df = df.withColumn("truth", F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((100.0, 0.0), (300.0, 0.0), (300.0, 100.0), (100.0, 100.0))]))
    return R.class_obb_reward(df, "response", F.lit("storage tank"), "truth").select("p_partkey", "format", "class_score", F.round("iou", 6).alias("iou"), F.round("overall", 6).alias("overall"))


@query("c29_first_nonempty", "select doc_id, coalesce(nullif(case when doc_id % 3 = 0 then '' else source end, ''), nullif(nullif(lang, 'en'), ''), cast(doc_id as varchar)) as name from documents")
def _(spark, sf):
    df = documents(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("a"), F.nullif("lang", F.lit("en")).alias("b"), F.col("doc_id").cast("string").alias("c"))
    return df.select("doc_id", C.first_nonempty(df, "a", "b", "c").alias("name"))


_NUMERAL = "case p_partkey % 3 when 0 then cast(p_size - 3 as string) when 1 then cast(cast(p_retailprice as decimal(12, 2)) as string) else concat(p_size, '.5e', p_size % 4) end"


@query("b12_perturb_number", f"""with p as (select p_partkey, p_partkey % 3 as k, {_NUMERAL} as t, case when p_size % 2 = 0 then 1 else -1 end as s from part), v as (select *, cast(t as double) as v from p),
 w as (select *, v + s * (case when k = 0 then greatest(round_even(case when v = 0 then 1 else abs(v) * 0.2 end, 0), 1) else abs(v) * 0.2 end) as w from v)
 select p_partkey, t as answer, case k when 0 then cast(cast(w as bigint) as varchar) when 1 then printf('%.2f', w) else printf('%.1e', w) end as wrong from w""")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").withColumn("answer", F.expr(_NUMERAL))
    return df.select("p_partkey", "answer", U.perturb_number(F.col("answer"), F.col("p_size") % 2 == 0).alias("wrong"))
