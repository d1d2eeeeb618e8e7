"""Queries of the rollout operators. Rollouts are the ``events`` (group: user), token arrays are derived from rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.operators import rollouts as R
from loomlake.plans.fixtures import ROLLOUTS, duck, frame

QUERIES, ORACLES = {}, {}
E = duck(ROLLOUTS)
#: Token rows: up to 9 tokens a response, rewards, values and log-probabilities by a rule of position and id.
TOKENS = "select row_id, length, i, cast((row_id * 31 + i * 17) % 50 as int) as token, cast((row_id * 7 + i * 3) % 11 as double) / 10 as reward, cast((row_id * 5 + i * 13) % 9 as double) / 10 as val, -cast((row_id * 3 + i * 5) % 23 as double) / 10 as logp, -cast((row_id * 11 + i * 7) % 19 as double) / 10 as ref"
TOK = f"({TOKENS} from ({E}) e, (select unnest(range(9)) as i) t where i < length)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rows(spark, sf):
    return frame(spark, sf, ROLLOUTS)


def arrays(spark, sf):
    """One row per response with its token arrays."""
    i = F.sequence(F.lit(0), F.col("length") - 1)
    r = F.col("row_id")
    part = lambda f: F.transform(i, f)
    return rows(spark, sf).select(
        "row_id", "uid", "score", "length", part(lambda i: ((r * 31 + i * 17) % 50).cast("int")).alias("tokens"), part(lambda i: ((r * 7 + i * 3) % 11).cast("double") / 10).alias("rewards"),
        part(lambda i: ((r * 5 + i * 13) % 9).cast("double") / 10).alias("vals"), part(lambda i: -((r * 3 + i * 5) % 23).cast("double") / 10).alias("logp"), part(lambda i: -((r * 11 + i * 7) % 19).cast("double") / 10).alias("ref"))


@query("w9_grpo", f"select row_id, round((score - avg(score) over g) / (stddev_samp(score) over g + 1e-6), 4) as advantage from ({E}) window g as (partition by uid) qualify count(*) over g > 1")
def _(spark, sf):
    return R.grpo(rows(spark, sf)).select("row_id", F.round("advantage", 4).alias("advantage"))


@query("w10_rloo", f"select row_id, round(score - (cast(sum(cast(score as decimal(38,12))) over g as double) - score) / (count(*) over g - 1), 9) as advantage from ({E}) window g as (partition by uid) qualify count(*) over g > 1")
def _(spark, sf):
    return R.rloo(rows(spark, sf)).select("row_id", F.round("advantage", 9).alias("advantage"))


@query("w11_remax", f"with b as (select uid, max(score) as baseline from ({E}) where event_type = 'view' group by uid) select row_id, round(score - baseline, 6) as advantage from ({E}) join b using (uid) where event_type <> 'view'")
def _(spark, sf):
    df = rows(spark, sf)
    base = df.where("event_type = 'view'").groupBy("uid").agg(F.max("score").alias("baseline"))
    return R.remax(df.where("event_type <> 'view'"), base).select("row_id", F.round("advantage", 6).alias("advantage"))


@query("w12_reinforce_pp", f"""with t as (select *, i < length - 1 as m from {TOK}),
 r as (select a.row_id, a.i, any_value(a.m) as m, sum(b.reward * power(0.9, b.i - a.i)) as ret from t a join t b on a.row_id = b.row_id and b.i >= a.i and (b.i = a.i or (a.m and b.m)) group by a.row_id, a.i, a.length),
 x as (select avg(ret) as mean, var_samp(ret) as var from r where m)
 select row_id, i, round(ret, 6) as ret, round((ret - mean) / sqrt(var + 1e-8), 4) as advantage from r, x""")
def _(spark, sf):
    df = arrays(spark, sf).withColumn("mask", F.transform("tokens", lambda t, i: (i < F.col("length") - 1).cast("int")))
    df = df.withColumn("ret", R.discounted(F.col("rewards"), F.col("mask"), 0.9)).withColumn("advantage", F.col("ret"))
    df = R.whitened(df, "advantage", "mask")
    return df.select("row_id", F.posexplode(F.arrays_zip("ret", "advantage")).alias("i", "z")).select("row_id", "i", F.round("z.ret", 6).alias("ret"), F.round("z.advantage", 4).alias("advantage"))


@query("w13_gae", f"""with t as (select *, reward + 0.9 * coalesce(lead(val) over (partition by row_id order by i), 0) - val as delta from {TOK})
 select a.row_id, a.i, round(sum(b.delta * power(0.9 * 0.8, b.i - a.i)), 6) as advantage from t a join t b on a.row_id = b.row_id and b.i >= a.i group by a.row_id, a.i""")
def _(spark, sf):
    df = arrays(spark, sf).select("row_id", F.posexplode(R.gae(F.col("rewards"), F.col("vals"), 0.9, 0.8)).alias("i", "a"))
    return df.select("row_id", "i", F.round("a", 6).alias("advantage"))


@query("w14_response_mask", f"select row_id, sum(cast(i <= coalesce(e, 99) as int)) as kept from (select *, min(case when token = 7 then i end) over (partition by row_id) as e from {TOK}) group by row_id")
def _(spark, sf):
    df = arrays(spark, sf).withColumn("mask", R.response_mask(F.col("tokens"), 7))
    return df.select("row_id", F.aggregate("mask", F.lit(0), lambda a, v: a + v).cast("long").alias("kept"))


@query("r10_token_rewards", f"select row_id, i, case when i = length - 2 then score else 0 end as reward from (select t.*, e.score from {TOK} t join ({E}) e using (row_id))")
def _(spark, sf):
    df = arrays(spark, sf).withColumn("r", R.token_rewards(F.col("score"), F.col("tokens"), F.col("length") - 1))
    return df.select("row_id", F.posexplode("r").alias("i", "reward"))


_KL = "select row_id, i, round(logp - ref, 6) as kl, round(abs(logp - ref), 6) as abs_kl, round(0.5 * (logp - ref) * (logp - ref), 6) as mse, round(least(10, exp(ref - logp) - (ref - logp) - 1), 6) as low_var from {t}"


@query("r11_kl_tokens", _KL.replace("{t}", TOK))
def _(spark, sf):
    df = arrays(spark, sf)
    cols = {n: R.kl(F.col("logp"), F.col("ref"), k) for n, k in (("kl", "kl"), ("abs_kl", "abs"), ("mse", "mse"), ("low_var", "low_var_kl"))}
    df = df.withColumns(cols).select("row_id", F.posexplode(F.arrays_zip(*cols)).alias("i", "z"))
    return df.select("row_id", "i", *[F.round(f"z.{c}", 6).alias(c) for c in cols])


@query("r11_kl_penalty", f"with t as (select row_id, avg(reward - 0.1 * (logp - ref)) as r, avg(logp - ref) as k from {TOK} group by row_id) select count(*) as n, round(avg(r), 6) as mean_reward, round(avg(k), 6) as mean_kl from t")
def _(spark, sf):
    df = arrays(spark, sf).withColumn("kl", R.kl(F.col("logp"), F.col("ref")))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    df = df.withColumn("r", mean(F.zip_with("rewards", "kl", lambda r, k: r - 0.1 * k))).withColumn("k", mean(F.col("kl")))
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("mean_reward"), F.round(F.avg("k"), 6).alias("mean_kl"))


@query("f18_online_filter", f"select row_id, uid, score from ({E}) qualify avg(score) over (partition by uid) > 40 and avg(score) over (partition by uid) < 60")
def _(spark, sf):
    return R.online_filter(rows(spark, sf), 40.0, 60.0).select("row_id", "uid", "score")


@query("a25_rollout_metrics", f"select metric, round(avg(v), 6) as mean, max(v) as max, min(v) as min, round(var_samp(v), 4) as var from (select 'score' as metric, score as v from ({E}) union all select 'length', cast(length as double) from ({E})) group by metric")
def _(spark, sf):
    return R.metrics(rows(spark, sf), ["score", "length"]).select("metric", F.round("mean", 6).alias("mean"), "max", "min", F.round("var", 4).alias("var"))


@query("a25_token_metrics", f"""with t as (select row_id, length, unnest(range(length)) as i from ({E})), v as (select ((row_id * 7 + i * 3) % 11) / 10.0 as rewards, ((row_id * 5 + i * 13) % 9) / 10.0 as vals from t where i < length - row_id % 2)
 select 'rewards' as metric, round(avg(rewards), 6) as mean, max(rewards) as max, min(rewards) as min from v union all select 'vals', round(avg(vals), 6), max(vals), min(vals) from v
 union all select 'explained_variance', round(1 - var_samp(rewards - vals) / (var_samp(rewards) + 1e-5), 6), null, null from v union all select 'response_length', round(avg(length - row_id % 2), 6), max(length - row_id % 2), min(length - row_id % 2) from ({E}) union all select 'clip_ratio', round(avg(cast(length - row_id % 2 = 9 as int)), 6), null, null from ({E})""")
def _(spark, sf):
    """Rewards as returns against values; the last token of every other response is masked."""
    df = arrays(spark, sf).withColumn("mask", F.transform("rewards", lambda _, i: F.when(i < F.col("length") - F.col("row_id") % 2, 1).otherwise(0)))
    out = R.token_metrics(df, ["rewards"], "mask", 9, "vals", "rewards")
    return out.select("metric", F.round("mean", 6).alias("mean"), "max", "min")


@query("w16_balance_shards", f"with r as (select length, row_number() over (order by length desc, row_id) - 1 as k from ({E})), s as (select length, case when (k // 8) % 2 = 0 then k % 8 else 7 - k % 8 end as shard from r) select cast(shard as int) as shard, count(*) as rows, cast(sum(length) as bigint) as tokens from s group by shard")
def _(spark, sf):
    """Rows and lengths of eight balanced shards; a test holds it against the contract."""
    df = R.balance_shards(rows(spark, sf), 8)
    return df.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("length").alias("tokens"))


@query("w17_micro_batches", f"""with r as (select *, greatest(1, ceil(sum(length) over g / 30.0)) as k, row_number() over (partition by uid order by length desc, row_id) - 1 as r from ({E}) window g as (partition by uid))
 select row_id, cast(case when floor(r / k) % 2 = 0 then r % k else k - 1 - r % k end as int) as micro from r""")
def _(spark, sf):
    return R.micro_batches(rows(spark, sf), 30).select("row_id", "micro")


@query("w18_smooth", f"""with recursive s as (select uid, score as v, row_number() over (partition by uid order by row_id) as i, row_id, 1.8 * (1 / (1 + exp(-0.05 * count(*) over (partition by uid))) - 0.5) as w from ({E})),
 y as (select uid, i, row_id, v, v * w + (1 - w) * v as y from s where i = 1 union all select s.uid, s.i, s.row_id, s.v, y.y * s.w + (1 - s.w) * s.v from y join s on s.uid = y.uid and s.i = y.i + 1)
 select uid, row_id, round(y, 4) as smoothed from y""")
def _(spark, sf):
    return R.smoothed(rows(spark, sf), "uid", "row_id", "score").select("uid", "row_id", F.round("smoothed", 4).alias("smoothed"))


@query("w8_kl_pairs", f"select row_id, coalesce(lag(score) over (partition by row_id // 16 order by row_id), last_value(score) over (partition by row_id // 16 order by row_id rows between unbounded preceding and unbounded following)) as kl_response from ({E})")
def _(spark, sf):
    df = rows(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 16))
    return R.kl_pairs(df, "batch", "row_id", "score").select("row_id", "kl_response")
