"""Queries of sampling, splitting, mixing, set and join operators over ``orders``, ``events`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.operators import joins as J, metrics as M, sampling as S
from loomlake.plans.fixtures import ROLLOUTS, duck, frame

QUERIES, ORACLES = {}, {}
E = duck(ROLLOUTS)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


def events(spark, sf):
    return frame(spark, sf, ROLLOUTS)


_N = "(select count(*) from orders)"


@query("l1_sample_random", f"select o_orderkey from orders order by sha1('7||' || o_orderkey) limit greatest(1, cast(floor({_N} * 0.1) as bigint))")
def _(spark, sf):
    return S.sample(orders(spark, sf), 0.1, "o_orderkey", seed=7).select("o_orderkey")


@query("l1_sample_stride", f"with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r from orders) select o_orderkey from r where r % ({_N} // (cast(floor({_N} * 0.03) as bigint))) = 0 and r < ({_N} // cast(floor({_N} * 0.03) as bigint)) * cast(floor({_N} * 0.03) as bigint)")
def _(spark, sf):
    return S.sample(orders(spark, sf), 0.03, "o_orderkey", mode="stride").select("o_orderkey")


@query("l2_exact_n", "with n as (select count(*) as n from events), r as (select event_id, row_number() over (order by sha1('0||' || event_id)) as r from events) select event_id, k as copy from events, (select unnest(range(2)) as k) union all select event_id, 2 from r, n where r <= n.n * 5 // 2 - 2 * n.n")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id")
    return S.exact_n(df, df.count() * 5 // 2, "event_id").withColumn("copy", F.col("copy").cast("long"))


@query("l3_limit", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 100")
def _(spark, sf):
    """Its result is the first rows: the limit is the feature."""
    return orders(spark, sf).select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("l4_split", "select o_orderkey, case when ('0x' || substr(sha1('3||' || o_custkey), 1, 8))::bigint % 100 < 30 then 'val' else 'train' end as split from orders")
def _(spark, sf):
    return S.split(orders(spark, sf), 30, 100, "o_custkey", seed=3).select("o_orderkey", "split")


@query("l5_scene_split", """with o as (select o_orderkey, o_custkey as scene, case when o_orderkey % 5 < 2 then 'val' else 'train' end as s from orders),
 c as (select scene, count(*) as n, count(*) filter (s = 'val') as v from o group by scene), m as (select *, case when v * 2 > n then 'val' else 'train' end as maj from c),
 h as (select cast(floor(0.4 * (select count(*) from orders)) as bigint) - coalesce(sum(n) filter (maj = 'val'), 0) as missing from m),
 b as (select scene, sum(n) over (order by n, scene) - n as before from m where maj = 'train')
 select scene, any_value(case when maj = 'val' or before < missing then 'val' else 'train' end) as scene_split, count(*) as n from o join m using (scene) left join b using (scene), h group by scene""")
def _(spark, sf):
    df = orders(spark, sf).select(F.col("o_custkey").alias("scene"), F.expr("case when o_orderkey % 5 < 2 then 'val' else 'train' end").alias("s"))
    out = S.scene_split(df, "scene", "s", int(0.4 * df.count()))
    return out.groupBy("scene").agg(F.first("scene_split").alias("scene_split"), F.count("*").alias("n"))


@query("l7_batches", "with r as (select o_orderkey, row_number() over (order by sha1('5||' || o_orderkey)) - 1 as r, count(*) over () as n from orders) select o_orderkey, r // 64 as batch from r where r // 64 < n // 64")
def _(spark, sf):
    return S.batches(orders(spark, sf).select("o_orderkey"), 64, "o_orderkey", seed=5).select("o_orderkey", "batch")


@query("l8_repeat", "select event_id, k as copy, row_number() over (order by event_id, k) as n from events, (select unnest(range(3)) as k)")
def _(spark, sf):
    from loomlake.operators.windows import global_rank

    df = S.repeat(spark.read.parquet(f"{sf}/events.parquet").select("event_id"), 3, "event_id")
    return global_rank(df, ["place"], "n").select("event_id", F.col("copy").cast("long").alias("copy"), (F.col("n") + 1).alias("n"))


@query("l8_chunks", "with n as (select count(*) as n from documents), r as (select doc_id, row_number() over (order by doc_id) - 1 as r from documents) select doc_id, cast(case when r < (n % 7) * (n // 7 + 1) then r // (n // 7 + 1) else n % 7 + (r - (n % 7) * (n // 7 + 1)) // (n // 7) end as int) as chunk from r, n")
def _(spark, sf):
    """Padded to a multiple, unpadded again, and dealt to seven parts in order."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    return S.chunks(S.unpad(S.pad_to(d, 64, "doc_id")), 7, "doc_id").select("doc_id", "chunk")


@query("l8_pad_to", "with n as (select count(*) as n from documents), r as (select doc_id, row_number() over (order by doc_id) as r from documents) select doc_id, false as pad from documents union all select doc_id, true from r, n where r <= (64 - n.n % 64) % 64")
def _(spark, sf):
    return S.pad_to(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), 64, "doc_id")


@query("l9_fill_batch", f"select row_id, uid from ({E}) qualify row_number() over (partition by uid order by row_id) <= 4")
def _(spark, sf):
    """The first four rollouts of each prompt."""
    from pyspark.sql import Window as W

    df = events(spark, sf).withColumn("r", F.row_number().over(W.partitionBy("uid").orderBy("row_id")))
    return df.where("r <= 4").select("row_id", "uid")


@query("w4_cap_per_group", "select o_orderkey, o_custkey from orders qualify row_number() over (partition by o_custkey order by sha1('1||' || o_orderkey)) <= 3")
def _(spark, sf):
    return S.cap_per_group(orders(spark, sf), "o_custkey", 3, "o_orderkey", seed=1).select("o_orderkey", "o_custkey")


@query("w5_round_robin", "select o_orderkey, row_number() over (partition by o_orderstatus, o_orderpriority order by sha1('2||' || o_orderkey)) as turn, sha1('2||' || o_orderstatus || '||' || o_orderpriority) as bucket_key from orders")
def _(spark, sf):
    df = S.round_robin(orders(spark, sf), ["o_orderstatus", "o_orderpriority"], "o_orderkey", seed=2)
    return df.select("o_orderkey", F.col("turn").cast("long").alias("turn"), "bucket_key")


_SRC = "(select doc_id, row_number() over (partition by doc_id % 3 order by doc_id) - 1 as r, doc_id % 3 as s, count(*) over (partition by doc_id % 3) as n from documents where doc_id % 7 <> 2 or doc_id % 3 <> 1)"


@query("u2_interleave_first", f"select doc_id, cast(s as int) as source, r * 3 + s as place from {_SRC} where r < (select min(n) from {_SRC})")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").where("doc_id % 7 <> 2 or doc_id % 3 <> 1")
    return S.interleave([df.where(F.col("doc_id") % 3 == i) for i in range(3)], "doc_id").select("doc_id", "source", "place")


@query("u2_interleave_all", f"select doc_id, cast(s as int) as source, (r + k * n) * 3 + s as place from {_SRC}, (select unnest(range(3)) as k) where r + k * n < (select max(n) from {_SRC})")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").where("doc_id % 7 <> 2 or doc_id % 3 <> 1")
    return S.interleave([df.where(F.col("doc_id") % 3 == i) for i in range(3)], "doc_id", stop="all").select("doc_id", "source", "place")


@query("u1_union_all", "select doc_id, text, cast(null as bigint) as quality from documents union all select doc_id, null, quality from labels")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return d.unionByName(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").cast("long").alias("quality")), allowMissingColumns=True)


@query("u3_id_difference", "select doc_id, 'left' as side from (select doc_id from documents except select doc_id from labels) union all select doc_id, 'right' from (select doc_id from labels except select doc_id from documents)")
def _(spark, sf):
    return S.id_difference(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")


@query("u4_sym_diff", "select count(*) filter (side = 'left') as only_left, count(*) filter (side = 'right') as only_right from (select doc_id, 'left' as side from (select doc_id from documents except select doc_id from labels) union all select doc_id, 'right' from (select doc_id from labels except select doc_id from documents))")
def _(spark, sf):
    d = S.id_difference(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return d.agg(F.count_if(F.col("side") == "left").alias("only_left"), F.count_if(F.col("side") == "right").alias("only_right"))


@query("u5_distinct_first", "select min(doc_id) as doc_id from documents group by lang, source, length(text) // 100")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return S.distinct_first(df, [F.col("lang"), F.col("source"), F.floor(F.length("text") / 100)], "doc_id").select("doc_id")


@query("u6_multiset_equal", "with a as (select text from documents), b as (select text from documents where doc_id % 10 <> 0) select (select count(*) from (select * from a except all select * from b)) as only_left, 0 as only_right, (select count(*) from documents where doc_id % 10 = 0) = 0 as equal")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return S.multiset_equal(d.select("text"), d.where("doc_id % 10 <> 0").select("text"))


@query("j1_join_inputs", "select o_orderkey, c_name, case when c_custkey is null then 'missing_input' else '' end as reason from orders left join (select * from customer where c_custkey % 9 <> 0) on o_custkey = c_custkey")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return J.join_inputs(orders(spark, sf), c, "o_custkey", "c_name").select("o_orderkey", "c_name", "reason")


@query("j2_todo", "select event_id from events where event_id not in (select doc_id from documents)")
def _(spark, sf):
    done = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("event_id"))
    return S.todo(spark.read.parquet(f"{sf}/events.parquet").select("event_id"), done, ["event_id"])


@query("j3_semi", "select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def _(spark, sf):
    return J.keep(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").select("doc_id", "lang")


@query("j5_pair_audit", """with a as (select doc_id, lang, n_chars from documents where doc_id % 11 <> 0), b as (select doc_id, case when doc_id % 13 = 0 then 'xx' else lang end as lang, n_chars from documents where doc_id % 17 <> 0)
 select case when a.doc_id is null then 'only_b' when b.doc_id is null then 'only_a' when a.lang <> b.lang then 'differs' else 'same' end as status, count(*) as n from a full join b on a.doc_id = b.doc_id group by 1""")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")
    b = d.where("doc_id % 17 <> 0").withColumn("lang", F.when(F.col("doc_id") % 13 == 0, "xx").otherwise(F.col("lang")))
    return J.pair_audit(d.where("doc_id % 11 <> 0"), b, "doc_id", ["lang", "n_chars"]).groupBy("status").agg(F.count("*").alias("n"))


@query("j10_batch_union", "select d.doc_id, lang, source, quality from documents d join labels using (doc_id)")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    b = d.select("doc_id", "lang", "source").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id")
    return S.batch_union(d.select("doc_id", "lang"), b, "doc_id").select("doc_id", "lang", "source", "quality")


_NAMES = ["plane", "ship", "storage_tank", "Harbor", "SUV", "pickup-truck", "heavy vehicle", "compact  van", "jet", "vessel", "swimming-pool", "tank", "marina", "trailer"]


@query("j11_canonical_class", f"""with c as (select p_partkey, replace(regexp_replace(lower({_NAMES}[p_size % 14 + 1]), '\\s+', ' ', 'g'), '_', ' ') as c from part where p_partkey % 3 < 2 union all select p_partkey, lower(p_type) from part where p_partkey % 3 = 2)
 select p_partkey, case when c in ('plane', 'ship', 'storage tank', 'harbor') then c when c in ('suv', 'pickup-truck', 'compact van') then 'small vehicle' when c in ('heavy vehicle', 'trailer') then 'large vehicle'
  when c = 'jet' then 'plane' when c = 'vessel' then 'ship' when c = 'swimming-pool' then 'swimming pool' end as class_name from c""")
def _(spark, sf):
    """Names as models write them, in brackets and with points; every third row has a text that is no class."""
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_size") % 14).cast("int"))
    raw = F.when(F.col("p_partkey") % 3 == 2, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" ["), name, F.lit("]. "))).otherwise(name)
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", J.canonical_class(raw).alias("class_name"))


@query("a6_run_report", f"with f as (select uid, arg_min(event_type, row_id) as reason from ({E}) group by uid) select reason, count(*) as n from f group by reason")
def _(spark, sf):
    return M.outcome_counts(events(spark, sf), "uid", "row_id", "event_type")


@query("a7_outcomes", f"select length as task, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'purchase') as success, count(*) filter (event_type not in ('error', 'purchase')) as unknown from ({E}) group by length")
def _(spark, sf):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "success").otherwise("unknown")
    return events(spark, sf).withColumn("k", kind).groupBy(F.col("length").alias("task")).pivot("k", ["error", "success", "unknown"]).count().na.fill(0)


@query("a8_api_rollup", f"select case when event_type = 'error' then 'api_error' else 'api_call' end as event, count(*) as calls, count(*) filter (tokens > 50) as long_calls, max(tokens) as max_tokens from ({E}) group by 1")
def _(spark, sf):
    return J.api_rollup(events(spark, sf), 50)


@query("a28_min_per_task", f"select event_type, count(*) as n, count(*) >= 150 as enough from ({E}) group by event_type")
def _(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= 150)


@query("a29_query_patterns", r"select count(*) filter (regexp_matches(text, '(?i)\bthe\b')) as the, count(*) filter (regexp_matches(text, '\d{4}')) as digits from documents")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return J.pattern_counts(d, "text", {"the": r"(?i)\bthe\b", "digits": r"\d{4}"})


@query("b8_shortcut_reward", """with m as (select distinct cast(p_size as int) % 12 + 1 as m from part), c as (select m, unnest(range(m + 1)) as c from m)
 select m, round(sum(exp(lgamma(m + 1) - lgamma(c + 1) - lgamma(m - c + 1)) / power(2, m) * (exp(2.0 * c / m) - 1) / (exp(2.0) - 1)), 6) as expected from c group by m""")
def _(spark, sf):
    return J.shortcut_rewards(spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_size").cast("int") % 12 + 1).alias("m")).distinct(), 2.0).select("m", F.round("expected", 6).alias("expected"))


@query("b10_stable_ids", "select o_orderkey, sha1(o_orderkey || '||' || o_orderstatus || '||None') as id from orders")
def _(spark, sf):
    return orders(spark, sf).select("o_orderkey", J.stable_id("o_orderkey", "o_orderstatus", F.lit(None).cast("string")).alias("id"))
