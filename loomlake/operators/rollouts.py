"""Rollout tables: one row per response. Advantages are windows over the group, token values array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomlake.operators.windows import global_rank
from loomlake.session import materialize


def grpo(df: DataFrame, group: str = "uid", score: str = "score", eps: float = 1e-6) -> DataFrame:
    """Adds ``advantage``: (score - mean) / (sample deviation + eps) in the group. Groups of one have none and are
    left out, as the estimator needs several rollouts."""
    w = W.partitionBy(group)
    df = df.withColumn("__n", F.count(score).over(w)).where("__n > 1")
    return df.withColumn("advantage", (F.col(score) - F.avg(score).over(w)) / (F.stddev_samp(score).over(w) + eps)).drop("__n")


def rloo(df: DataFrame, group: str = "uid", score: str = "score") -> DataFrame:
    """Adds ``advantage``: score less the mean of the group's other scores; groups of one are left out."""
    w = W.partitionBy(group)
    df = df.withColumn("__n", F.count(score).over(w)).where("__n > 1")
    total = F.sum(F.col(score).cast("decimal(38,12)")).over(w).cast("double")  # exact, so the order of rows does not matter
    return df.withColumn("advantage", F.col(score) - (total - F.col(score)) / (F.col("__n") - 1)).drop("__n")


def remax(df: DataFrame, baselines: DataFrame, group: str = "uid", score: str = "score", baseline: str = "baseline") -> DataFrame:
    """Adds ``advantage``: score less the group's baseline; rows without a baseline are left out."""
    return df.join(baselines.select(group, baseline), group).withColumn("advantage", F.col(score) - F.col(baseline))


#: Values that are gathered before they join all others, so that arrays are not copied for each value.
TOGETHER = 128


def _from_the_end(values: Column, step) -> Column:
    """(run, shown) = step(run, x) of each of ``values`` from the last to the first; the shown numbers in the order of ``values``.

    Results are appended in blocks and turned round once, so the time is near linear in the length.
    """
    state = lambda run, out: F.struct(run.alias("run"), out.alias("out"))
    none, more = F.array().cast("array<double>"), F.array().cast("array<array<double>>")
    back = F.reverse(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / TOGETHER).cast("int")), lambda i: F.slice(back, i * TOGETHER + 1, TOGETHER))

    def inner(a: Column, x: Column) -> Column:
        run, shown = step(a["run"], x)
        return state(run, F.concat(a["out"], F.array(shown)))

    outer = lambda a, block: F.get(F.transform(F.array(F.aggregate(block, state(a["run"], none), inner)), lambda r: state(r["run"], F.concat(a["out"], F.array(r["out"])))), 0)
    return F.when(F.size(values) > 0, F.reverse(F.flatten(F.aggregate(blocks, state(F.lit(0.0), more), outer)["out"]))).otherwise(none)


def discounted(rewards: Column, mask: Column, gamma: float) -> Column:
    """Discounted return of each token, from the end, starting anew where the mask is 0."""
    pairs = F.zip_with(rewards, mask, lambda r, m: F.struct(r.alias("r"), m.cast("double").alias("m")))
    return _from_the_end(pairs, lambda run, x: ((x["r"] + gamma * run) * x["m"], x["r"] + gamma * run))


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage of each token, not whitened: delta + gamma * lam * (advantage of the next token)."""
    deltas = F.transform(rewards, lambda r, i: r + gamma * F.coalesce(F.get(values, i + 1), F.lit(0.0)) - F.get(values, i))
    return _from_the_end(deltas, lambda run, d: (d + gamma * lam * run, d + gamma * lam * run))


def gae_advantages(df: DataFrame, rewards: str, values: str, mask: str, gamma: float, lam: float) -> DataFrame:
    """Adds ``returns`` (advantages plus values) and ``advantages``, whitened by the masked tokens of all rows."""
    df = df.withColumn("advantages", gae(F.col(rewards), F.col(values), gamma, lam))
    df = df.withColumn("returns", F.zip_with("advantages", values, lambda a, v: a + v))
    return whitened(df, "advantages", mask)


def whitened(df: DataFrame, values: str, mask: str, eps: float = 1e-8) -> DataFrame:
    """Array ``values`` less their masked mean, over their masked sample deviation, over all rows.

    The moments are one row, joined by broadcast.
    """
    kept = df.select(F.explode(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m"))).alias("t")).where("t.m = 1").agg(F.avg("t.v").alias("__mean"), F.var_samp("t.v").alias("__var"))
    out = df.crossJoin(F.broadcast(kept))
    return out.withColumn(values, F.transform(values, lambda v: (v - F.col("__mean")) / F.sqrt(F.col("__var") + eps))).drop("__mean", "__var")


def response_mask(tokens: Column, eos: int) -> Column:
    """1 up to the first end-of-sequence token, it included, then 0."""
    at = F.array_position(tokens, F.lit(eos))
    return F.transform(tokens, lambda t, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def kl(logp: Column, ref: Column, kind: str = "kl") -> Column:
    """Token-wise divergence estimates: kl, abs, mse or low_var_kl."""
    def one(p: Column, q: Column) -> Column:
        d = p - q
        if kind == "kl":
            return d
        if kind == "abs":
            return F.abs(d)
        if kind == "mse":
            return 0.5 * d * d
        if kind == "low_var_kl":
            x = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), -d))
            return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(x) - x - 1))
        raise ValueError(f"unknown estimate {kind}")

    return F.zip_with(logp, ref, one)


def token_rewards(score: Column, tokens: Column, valid: Column) -> Column:
    """The score at the last valid token, 0 elsewhere."""
    return F.transform(tokens, lambda t, i: F.when(i == valid - 1, score).otherwise(F.lit(0.0)))


def online_filter(df: DataFrame, low: float, high: float, group: str = "uid", score: str = "score") -> DataFrame:
    """Groups whose mean score lies strictly between the bounds."""
    mean = F.avg(score).over(W.partitionBy(group))
    return df.withColumn("__mean", mean).where((F.col("__mean") > low) & (F.col("__mean") < high)).drop("__mean")


def metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: mean, max, min, sample variance."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    return values.groupBy("x.metric").agg(F.avg("x.v").alias("mean"), F.max("x.v").alias("max"), F.min("x.v").alias("min"), F.var_samp("x.v").alias("var"))


def token_metrics(df: DataFrame, tokens: list[str], mask: str, most: int, values: str | None = None, returns: str = "returns") -> DataFrame:
    """(metric, mean, max, min) of token arrays over tokens where ``mask`` is 1; of response_length, with the share of responses of ``most``
    tokens as clip_ratio; and with ``values`` explained_variance: 1 - var(returns - values) / (var(returns) + 1e-5).

    One pass explodes all arrays side by side; one aggregation sums them.
    """
    every = [*tokens, *([values] if values and values not in tokens else [])]
    t = df.select(F.explode(F.arrays_zip(*[F.col(c).alias(c) for c in every], F.col(mask).alias("__m"))).alias("t")).where("t.__m = 1")
    cols = [x for c in every for x in (F.avg(f"t.{c}").alias(f"{c}.mean"), F.max(f"t.{c}").cast("double").alias(f"{c}.max"), F.min(f"t.{c}").cast("double").alias(f"{c}.min"))]
    if values:
        cols.append((1 - F.var_samp(F.col(f"t.{returns}") - F.col(f"t.{values}")) / (F.var_samp(f"t.{returns}") + 1e-5)).alias("explained"))
    one = t.agg(*cols)
    n = F.aggregate(mask, F.lit(0), lambda a, v: a + v)
    lengths = df.select(n.alias("n")).agg(F.avg("n").alias("mean"), F.max("n").cast("double").alias("max"), F.min("n").cast("double").alias("min"), F.avg((F.col("n") == most).cast("double")).alias("clip"))
    row = lambda name, *v: F.struct(F.lit(name).alias("metric"), *[x.cast("double").alias(k) for x, k in zip(v, ("mean", "max", "min"))])
    none = F.lit(None)
    a = one.select(F.inline(F.array(*[row(c, *[F.col(f"`{c}.{k}`") for k in ("mean", "max", "min")]) for c in every], *([row("explained_variance", F.col("explained"), none, none)] if values else []))))
    return a.union(lengths.select(F.inline(F.array(row("response_length", F.col("mean"), F.col("max"), F.col("min")), row("clip_ratio", F.col("clip"), none, none)))))


def balance_shards(df: DataFrame, k: int, length: str = "length", order: str = "row_id", block: int | None = None) -> DataFrame:
    """Adds ``shard``: all rows by falling length go forth and back over the ``k`` shards.

    Disjoint, complete, sizes at most one apart. The rank is one over the whole table, taken in ``block`` sorted
    ranges (see ``global_rank``): their number decides how many tasks share the sort, never the result.
    """
    ranked = global_rank(df, [F.col(length).desc(), F.col(order)], "__rank", blocks=block)
    turn, place = F.floor(F.col("__rank") / k), F.col("__rank") % k
    return ranked.withColumn("shard", F.when(turn % 2 == 0, place).otherwise(k - 1 - place).cast("int")).drop("__rank")


def micro_batches(df: DataFrame, max_tokens: int, group: str = "uid", length: str = "length", order: str = "row_id") -> DataFrame:
    """Adds ``micro``: in each group ceil(tokens / max_tokens) batches filled by serpentine of falling length."""
    w = W.partitionBy(group)
    k = F.greatest(F.lit(1), F.ceil(F.sum(length).over(w) / max_tokens))
    rank = F.row_number().over(w.orderBy(F.col(length).desc(), order)) - 1
    df = df.withColumn("__k", k).withColumn("__r", rank)
    turn, place = F.floor(F.col("__r") / F.col("__k")), F.col("__r") % F.col("__k")
    return df.withColumn("micro", F.when(turn % 2 == 0, place).otherwise(F.col("__k") - 1 - place).cast("int")).drop("__k", "__r")


#: Steps of a block of a smoothed series, and blocks that a start looks back: 0.9 ** (256 * 64) times any double is 0.
BLOCK, BACK = 256, 64


def smoothed(df: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """Exponential smoothing of each series; the weight follows the series' length: 1.8 * (sigmoid(0.05 n) - 0.5).

    Series may be of any length: rows are ranked over the whole table, and each ``BLOCK`` of ranks of a series is
    reduced to its affine map y -> w ** n * y + sum. A window over the blocks (two numbers each) gives each its
    start, then the steps are run through inside the blocks. The weight is under 0.9, so blocks further back than
    ``BACK`` add nothing but nulls, infinities and NaN, which are carried on apart.
    """
    rows = df.select(F.col(key).alias("k"), F.col(step).alias("s"), F.col(value).cast("double").alias("v"))
    ranked = global_rank(rows, ["k", "s", "v"], "at").withColumn("b", F.floor(F.col("at") / BLOCK))
    blocks = ranked.groupBy("k", "b").agg(F.min("at").alias("id"), F.array_sort(F.collect_list(F.struct("at", "s", "v"))).alias("x"))
    blocks = materialize(blocks, "blocks")
    weight = 1.8 * (1 / (1 + F.exp(-0.05 * F.sum("n").over(W.partitionBy("k")))) - 0.5)
    weights = blocks.select("k", "id", F.size("x").alias("n")).select("id", weight.alias("w"))
    blocks = materialize(blocks.join(weights, "id"), "weighted")
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a * F.col("w") + (1 - F.col("w")) * x["v"])
    sums = blocks.select("k", "id", F.get("x", 0)["v"].alias("v0"), F.pow("w", F.size("x")).alias("f"), total.alias("t"))
    series = W.partitionBy("k").orderBy("id")
    before = series.rowsBetween(W.unboundedPreceding, -1)
    odd = F.col("t").isNotNull() & (F.isnan("t") | (F.abs("t") == float("inf")))
    carry = sums.select(
        "id", F.first("v0").over(series.rowsBetween(W.unboundedPreceding, 0)).alias("v0"), F.collect_list(F.struct("f", "t")).over(series.rowsBetween(-BACK, -1)).alias("back"),
        F.coalesce(F.max(F.col("t").isNull()).over(before), F.lit(False)).alias("null"), F.sum(F.when(odd, F.col("t"))).over(before).alias("odd"))
    start = F.aggregate("back", F.col("v0"), lambda y, x: y * x["f"] + x["t"])
    starts = carry.select("id", F.when(~F.col("null"), F.coalesce(F.col("odd"), start)).alias("y0"))
    first = F.struct(F.col("y0").alias("last"), F.array().cast("array<double>").alias("out"))

    def go(a: Column, x: Column) -> Column:
        now = a["last"] * F.col("w") + (1 - F.col("w")) * x["v"]
        return F.struct(now.alias("last"), F.concat(a["out"], F.array(now)).alias("out"))

    out = blocks.join(starts, "id").withColumn("y", F.aggregate("x", first, go, lambda a: a["out"]))
    return out.select("k", F.explode(F.arrays_zip("x", "y")).alias("z")).select(F.col("k").alias(key), F.col("z.x.s").alias(step), F.col("z.y").alias("smoothed"))


def kl_pairs(df: DataFrame, batch: str, order: str, response: str) -> DataFrame:
    """Adds ``kl_response``: the response of the row before in the batch; the first row gets the last one's."""
    w = W.partitionBy(batch).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.withColumn("kl_response", F.coalesce(F.lag(response).over(w), F.last(response).over(whole)))
