"""Tokenised examples: budgets, label masks, packing, padding. Token arrays are columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

IGNORE = -100


def infer_seqlen(source: Column, target: Column, cutoff: Column | int) -> tuple[Column, Column]:
    """Source and target lengths after truncation to ``cutoff``: the shorter side is kept whole where it is under half."""
    c = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    most = F.when(target * 2 < c, c).when(source * 2 < c, c - source).otherwise(F.floor(c * (target / (source + target))).cast("int"))
    t = F.least(most, target)
    return F.least(F.greatest(c - t, F.lit(0)), source).cast("int"), t.cast("int")


def _fit(df: DataFrame, source: str, target: str, cutoff: int) -> DataFrame:
    s, t = infer_seqlen(F.size(source), F.size(target), cutoff)
    return df.withColumn("__s", s).withColumn("__t", t).withColumn("__src", F.slice(source, F.lit(1), F.col("__s"))).withColumn("__tgt", F.slice(target, F.lit(1), F.col("__t")))


def encode_pair(df: DataFrame, source: str, target: str, cutoff: int, prefix: str = "") -> DataFrame:
    """Adds {prefix}input_ids and {prefix}labels: truncated source and target, the source ignored in the labels."""
    df = _fit(df, source, target, cutoff)
    ids = F.concat("__src", "__tgt")
    labels = F.concat(F.array_repeat(F.lit(IGNORE), F.col("__s")), F.col("__tgt"))
    return df.withColumn(f"{prefix}input_ids", ids).withColumn(f"{prefix}labels", labels).drop("__s", "__t", "__src", "__tgt")


def mask_labels(df: DataFrame, pairs: str, cutoff: int, mask_history: bool = False, train_on_prompt: bool = False, eos: int | None = None) -> DataFrame:
    """Adds input_ids and labels over turn pairs (array of (source, target) token arrays).

    Turns are fitted one after the other into what is left of ``cutoff``; with ``mask_history`` from the last
    turn back, and only that one keeps its labels. With ``eos`` (templates that mark the end of a turn by the begin of the next) that token
    ends the row, for which a place of ``cutoff`` is kept, and is the label of the first source token of each turn but the first one fitted.
    """
    none = F.array().cast("array<int>")
    first = F.struct(F.lit(0 if eos is None else 1).alias("used"), F.lit(0).alias("turn"), none.alias("ids"), none.alias("labels"))

    def step(a: Column, p: Column) -> Column:
        s, t = infer_seqlen(F.size(p["source"]), F.size(p["target"]), F.lit(cutoff) - a["used"])
        src, tgt = F.slice(p["source"], F.lit(1), s), F.slice(p["target"], F.lit(1), t)
        hidden = lambda x: F.transform(x, lambda _: F.lit(IGNORE))
        shown = hidden(src) if eos is None else F.when((a["turn"] > 0) & (s > 0), F.concat(F.array(F.lit(eos)), F.slice(hidden(src), F.lit(2), s))).otherwise(hidden(src))
        own = F.concat(src if train_on_prompt else shown, F.when(a["turn"] > 0, hidden(tgt)).otherwise(tgt) if mask_history else tgt)
        ids = F.concat(src, tgt)
        now = F.struct((a["used"] + s + t).alias("used"), (a["turn"] + 1).alias("turn"), (F.concat(ids, a["ids"]) if mask_history else F.concat(a["ids"], ids)).alias("ids"), (F.concat(own, a["labels"]) if mask_history else F.concat(a["labels"], own)).alias("labels"))
        return F.when(a["used"] >= cutoff, a).otherwise(now)

    order = F.reverse(pairs) if mask_history else F.col(pairs)
    df = df.withColumn("__o", order).withColumn("__r", F.aggregate("__o", first, step))
    end = (lambda c: c) if eos is None else (lambda c: F.concat(c, F.array(F.lit(eos))))
    return df.withColumn("input_ids", end(F.col("__r.ids"))).withColumn("labels", end(F.col("__r.labels"))).drop("__o", "__r")


def pad_truncate(ids: Column, n: int, pad: int = 0, side: str = "right", cut: str | None = None) -> Column:
    """Exactly ``n`` tokens: padded on ``side``; longer ones are cut on the ``cut`` side (that of the padding if not given), or
    with "error" fail the job."""
    if side not in ("left", "right") or cut not in (None, "left", "right", "error"):
        raise ValueError(f"unknown side {side} or {cut}")
    cut = cut or side
    long = F.size(ids) > n
    if cut == "error":
        kept = F.when(long, F.raise_error(F.concat(F.lit(f"more than {n} tokens: "), F.size(ids).cast("string")))).otherwise(ids)
    else:
        kept = F.slice(ids, 1, n) if cut == "right" else F.when(long, F.slice(ids, -n, n)).otherwise(ids)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(n) - F.size(ids)))
    return F.concat(kept, fill) if side == "right" else F.concat(fill, kept)


def pack_blocks(df: DataFrame, batch: str, order: str, ids: str, block: int) -> DataFrame:
    """(batch, block, input_ids): the tokens of each batch end to end, cut into blocks; the rest of a batch goes.

    A running sum of lengths places every row; a row gives each block it touches its slice.
    """
    w = W.partitionBy(batch).orderBy(order)
    df = df.withColumn("__n", F.size(ids).cast("long")).where("__n > 0").withColumn("__end", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__at", F.col("__end") - F.col("__n"))
    total = F.sum("__n").over(W.partitionBy(batch))
    df = df.withColumn("__all", F.floor(total / block)).withColumn("block", F.explode(F.sequence(F.floor(F.col("__at") / block), F.floor((F.col("__end") - 1) / block))))
    lo = F.greatest(F.lit(0), F.col("block") * block - F.col("__at")).cast("int")
    hi = F.least(F.col("__n"), (F.col("block") + 1) * block - F.col("__at")).cast("int")
    part = df.where(F.col("block") < F.col("__all")).select(batch, "block", "__at", F.slice(ids, lo + 1, hi - lo).alias("part"))
    return part.groupBy(batch, "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__at", "part"))), lambda x: x["part"])).alias("input_ids"))


def pack_knapsack(df: DataFrame, batch: str, key: str, length: str, cutoff: int) -> DataFrame:
    """(batch, key, pack, at): greedy packing in each batch: a pack takes the longest row that still fits, again and
    again. Rows longer than ``cutoff`` go. A batch is a bounded group (a thousand rows, say) by contract."""
    import bisect

    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left = sorted((int(n), k) for k, n in zip(group[key], group[length]) if n <= cutoff)
        sizes = [n for n, _ in left]
        out, pack = [], 0
        while left:
            room, at = cutoff, 0
            while (i := bisect.bisect_right(sizes, room)) > 0:
                n, k = left.pop(i - 1)
                sizes.pop(i - 1)
                out.append((group[batch].iloc[0], k, pack, at))
                room, at = room - n, at + n
            pack += 1
        return pd.DataFrame(out, columns=[batch, key, "pack", "at"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (batch, key)}
    return df.select(batch, key, length).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {key} {kinds[key]}, pack long, at long")


def packed_rows(packs: DataFrame, df: DataFrame, batch: str, key: str, ids: str, cutoff: int, pad: int = 0) -> DataFrame:
    """(batch, pack, input_ids, attention_mask, position_ids) of ``pack_knapsack``'s packs, each of ``cutoff`` tokens.

    attention_mask numbers the rows of a pack from 1, so that they do not see each other, and is 0 on the padding; position_ids begin anew with
    each row. A pack is bounded by ``cutoff``.
    """
    rows = packs.join(df.select(batch, key, ids), [batch, key]).groupBy(batch, "pack").agg(F.array_sort(F.collect_list(F.struct("at", F.col(ids).alias("t")))).alias("x"))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.lit(cutoff) - F.size(c)))
    every = lambda f: F.flatten(F.transform("x", f))
    mask, place = every(lambda x, i: F.transform(x["t"], lambda _: i + 1)), every(lambda x: F.transform(x["t"], lambda _, j: j))
    return rows.select(batch, "pack", fill(every(lambda x: x["t"]), pad).alias("input_ids"), fill(mask, 0).alias("attention_mask"), fill(place, 0).alias("position_ids"))


def thumbnail_flags(n_marks: Column, n_images: Column) -> Column:
    """For each image whether it is one of the first ``n_marks``."""
    return F.when(n_images > 0, F.transform(F.sequence(F.lit(0), n_images - 1), lambda i: i < n_marks)).otherwise(F.array().cast("array<boolean>"))


def filter_overlong(df: DataFrame, length: Column, most: int) -> DataFrame:
    return df.where(length <= most)
