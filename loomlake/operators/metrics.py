"""Audits and evaluation metrics: grouped aggregates and windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomlake.operators.windows import global_rank
from loomlake.session import materialize




def audit(df: DataFrame, split: str, reasons: str = "reasons", cls: str = "class_id", image: str = "image_id") -> DataFrame:
    """Long table (split, metric, key, value): images, objects, valid, invalid, counts of reasons and classes."""
    # one pass: each object gives its counts, which are summed before the shuffle
    valid = F.coalesce((F.size(reasons) == 0).cast("long"), F.lit(0).cast("long"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    count = lambda m, k, v: F.struct(F.lit(m).alias("metric"), k.cast("string").alias("key"), v.alias("v"))
    whole = F.array(*[count(m, F.lit(""), v) for m, v in (("images", none), ("objects", one), ("valid", valid), ("invalid", 1 - valid))], count("class", F.col(cls), one))
    why = F.transform(reasons, lambda r: count("reason", r, one))
    each = df.select(split, F.col(image).alias("__image"), F.explode(F.concat(whole, F.coalesce(why, F.slice(whole, 1, 0)))).alias("x"))
    seen = F.countDistinct(F.when(F.col("x.metric") == "images", F.col("__image")))
    sums = each.groupBy(split, F.col("x.metric").alias("metric"), F.col("x.key").alias("key")).agg(F.sum("x.v").alias("n"), seen.alias("i"))
    return sums.select(split, "metric", "key", F.when(F.col("metric") == "images", F.col("i")).otherwise(F.col("n")).alias("value"))


def split_overlap(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in several splits, with their splits."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def gate(df: DataFrame, flags: dict[str, Column], fatal: set[str]) -> DataFrame:
    """One row per rule: violations, severity, and whether the rule passes (a warning always does)."""
    sums = df.agg(*[F.count_if(c).alias(n) for n, c in flags.items()])
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit("critical" if n in fatal else "warning").alias("severity"), F.col(n).alias("violations")) for n in flags])
    return sums.select(F.explode(rules).alias("r")).select("r.*", ((F.col("r.severity") == "warning") | (F.col("r.violations") == 0)).alias("passed"))


def dup_within(df: DataFrame, group: str, key: str) -> DataFrame:
    """Per group the number of rows beyond the first of each key."""
    return df.groupBy(group, key).agg(F.count("*").alias("n")).groupBy(group).agg(F.sum(F.col("n") - 1).alias("duplicates"))


def outcome_counts(df: DataFrame, key: str, order: str, reason: str) -> DataFrame:
    """First row of each key by ``order``, counted by reason."""
    first = df.groupBy(key).agg(F.min_by(reason, order).alias("reason"))
    return first.groupBy("reason").agg(F.count("*").alias("n"))


def confusion(df: DataFrame, gt: str, pred: str) -> DataFrame:
    return df.groupBy(gt, pred).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, gt: str, pred: str) -> DataFrame:
    """Per class that occurs: precision, recall, f1 (0 where undefined)."""
    cells = confusion(df, gt, pred).select(F.explode(F.array(F.struct(F.col(gt).alias("cls"), F.col("n").alias("gt"), F.lit(0).cast("long").alias("pred"), F.when(F.col(gt) == F.col(pred), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col(pred).alias("cls"), F.lit(0).cast("long").alias("gt"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    s = cells.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("gt", "pred", "hit")])
    p, r = F.col("hit") / F.greatest("pred", F.lit(1)), F.col("hit") / F.greatest("gt", F.lit(1))
    return s.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def at_k(df: DataFrame, question: str, correct: str, majority: str = "ceil") -> DataFrame:
    """One row: questions, Avg@k, Conv@k (a majority of runs is right: ceil(n / 2) or floor(n / 2) + 1) and Pass@k."""
    q = df.groupBy(question).agg(F.avg(F.col(correct).cast("double")).alias("a"), F.sum(F.col(correct).cast("long")).alias("c"), F.count("*").alias("n"))
    need = F.ceil(F.col("n") / 2) if majority == "ceil" else F.floor(F.col("n") / 2) + 1
    return q.agg(F.count("*").alias("questions"), F.avg("a").alias("avg_at_k"), F.avg((F.col("c") >= need).cast("double")).alias("conv_at_k"), F.avg((F.col("c") > 0).cast("double")).alias("pass_at_k"))


def k_check(df: DataFrame, question: str, k: int) -> DataFrame:
    """How many questions have how many runs, and whether that is ``k``."""
    return df.groupBy(question).agg(F.count("*").alias("runs")).groupBy("runs").agg(F.count("*").alias("questions")).withColumn("complete", F.col("runs") == k)


def localisation(df: DataFrame, iou: str, group: str, thresholds: list[float]) -> DataFrame:
    """Per group and threshold: rows, mean IoU, share at or above the threshold."""
    x = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return x.groupBy(group, "threshold").agg(F.count("*").alias("n"), F.avg(iou).alias("mean_iou"), F.avg((F.col(iou) >= F.col("threshold")).cast("double")).alias("accuracy"))


def greedy_match(pairs: DataFrame, keys: list[str], thresholds: list[float] | None = None) -> DataFrame:
    """Predictions by falling confidence take their best free ground truth: rows (keys, pred, gt, iou), or with ``thresholds``
    (keys, threshold, pred, gt, iou), where each threshold has a matching of its own among the pairs that reach it.

    ``pairs`` holds the candidate pairs (keys, pred, confidence, gt, iou). Groups are those of one image and
    class, so the sorted pairs of a group are a small array that one ``aggregate`` goes through; they are shuffled once for all thresholds.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "pred", (-F.col("iou")).alias("i"), "gt")))
    g = pairs.groupBy(*keys).agg(order.alias("x"))
    if thresholds is not None:
        g = g.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("x", F.filter("x", lambda p: -p["i"] >= F.col("threshold"))).where(F.size("x") > 0)
        keys = [*keys, "threshold"]
    first = F.struct(F.array().cast("array<bigint>").alias("p"), F.array().cast("array<bigint>").alias("g"), F.array().cast("array<double>").alias("i"))

    def step(a: Column, x: Column) -> Column:
        free = ~F.array_contains(a["p"], x["pred"]) & ~F.array_contains(a["g"], x["gt"])
        return F.when(free, F.struct(F.array_append(a["p"], x["pred"]).alias("p"), F.array_append(a["g"], x["gt"]).alias("g"), F.array_append(a["i"], -x["i"]).alias("i"))).otherwise(a)

    m = g.select(*keys, F.aggregate("x", first, step).alias("m"))
    return m.select(*keys, F.explode(F.arrays_zip(F.col("m.p").alias("pred"), F.col("m.g").alias("gt"), F.col("m.i").alias("iou"))).alias("z")).select(*keys, "z.*")


def average_precision(preds: DataFrame, truths: DataFrame, matches: DataFrame, keys: list[str], cls: str, thresholds: list[float] | None = None) -> DataFrame:
    """(class, threshold, ap): AP over 101 recall points. ``preds``: (keys, pred, confidence), ``matches``: (keys, threshold, pred).

    Classes with ground truths only; one without a match at a threshold has AP 0. ``thresholds``: all that there are, if some may be without any match. Predictions are ranked once over the
    whole table by range partitions, and matches once more, so no class meets in one task; what is left
    for windows are 101 recall points for each class and threshold.
    """
    starts = lambda df, by, name: df.groupBy(*by).agg(F.min("__at").alias(name))
    ranked = global_rank(preds.select(*keys, "pred", "confidence"), [cls, F.col("confidence").desc(), *[k for k in keys if k != cls], "pred"], "__at")
    ranked = ranked.join(F.broadcast(starts(ranked, [cls], "__first")), cls).select(*keys, "pred", (F.col("__at") - F.col("__first") + 1).alias("n"))
    reached = matches.groupBy(*keys, "pred").agg(F.collect_list("threshold").alias("__t"))  # one row for each prediction is shuffled, whatever the number of thresholds
    hits = global_rank(reached.join(ranked, [*keys, "pred"]).select(cls, F.explode("__t").alias("threshold"), "n"), [cls, "threshold", "n"], "__at")
    hits = hits.join(F.broadcast(starts(hits, [cls, "threshold"], "__first")), [cls, "threshold"]).withColumn("hits", F.col("__at") - F.col("__first") + 1)
    total = truths.groupBy(cls).agg(F.count("*").alias("total"))
    reach = F.floor(F.col("hits") / F.col("total") * 100 + 1e-9).cast("int")
    best = hits.join(F.broadcast(total), cls).groupBy(cls, "threshold", reach.alias("r")).agg(F.max(F.col("hits") / F.col("n")).alias("precision"))
    w = W.partitionBy(cls, "threshold")
    # a running maximum from the right; recall point 0 is reached by the first hit
    env = best.withColumn("precision", F.max("precision").over(w.orderBy(F.col("r").desc()).rowsBetween(W.unboundedPreceding, 0)))
    env = env.withColumn("before", F.coalesce(F.lag("r").over(w.orderBy("r")), F.lit(-1)))
    ap = env.groupBy(cls, "threshold").agg((F.sum((F.col("r") - F.col("before")) * F.col("precision")) / 101).alias("ap"))
    if thresholds is None:
        every = total.select(cls).join(F.broadcast(matches.select("threshold").distinct()), how="cross")
    else:
        every = total.select(cls, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return every.join(ap, [cls, "threshold"], "left").select(cls, "threshold", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def cumulative_counts(preds: DataFrame, cls: str, confidence: str, hit: str, key: list[str], totals: DataFrame) -> DataFrame:
    """Adds tp, fp, precision and recall of the predictions of a class down to each one, by falling confidence (ties by ``key``).

    ``hit``: whether a prediction is right; ``totals``: (class, total) ground truths. Ranks and counts of right ones run over ranges of the whole table.
    """
    df = preds.withColumn("__h", F.coalesce(F.col(hit), F.lit(False)).cast("long"))
    ranked = global_rank(df, [cls, F.col(confidence).desc(), *key], "__at", running="__h")
    starts = ranked.groupBy(cls).agg(F.min("__at").alias("__first"), F.min("__before").alias("__none"))
    out = ranked.join(starts, cls).join(totals, cls, "left")
    tp, n = F.col("__before") + F.col("__h") - F.col("__none"), F.col("__at") - F.col("__first") + 1
    out = out.withColumns({"tp": tp, "fp": n - tp, "precision": tp / n, "recall": tp / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1))})
    return out.drop("__h", "__at", "__before", "__first", "__none", "total")


def detection_ap(pairs: DataFrame, preds: DataFrame, truths: DataFrame, keys: list[str], cls: str, thresholds: list[float]) -> DataFrame:
    """(class, threshold, ap) with, besides each class and threshold, rows of class null: mean over classes of each
    threshold, and of threshold null: mean over thresholds. ``pairs``: (keys, pred, confidence, gt, iou)."""
    matches = materialize(greedy_match(pairs.where(F.col("iou") >= min(thresholds)), keys, thresholds).select(*keys, "threshold", "pred"), "matches")
    ap = average_precision(preds, truths, matches, keys, cls, thresholds)
    return ap.cube(cls, "threshold").agg(F.avg("ap").alias("ap"))


def detection_summary(pairs: DataFrame, queries: DataFrame, query: str, thresholds: list[float]) -> DataFrame:
    """(threshold, matches, precision, recall, f1, mean_iou, negative_accuracy), threshold by threshold.

    ``queries``: (query, n_pred, n_gt), ``pairs``: (query, pred, gt, iou). Each query's pairs are matched one to one by
    falling IoU; unmatched ground truths count with IoU 0, and ``negative_accuracy`` is the share of queries
    without ground truths that have no predictions. What has nothing to count is 0.
    """
    m = greedy_match(pairs.withColumn("confidence", F.col("iou")), [query])
    reached = F.array(*[F.count_if(F.col("iou") >= t) for t in thresholds])
    found = m.agg(F.arrays_zip(F.array(*map(F.lit, thresholds)).alias("threshold"), reached.alias("matches")).alias("__m"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("__s"))
    all_ = queries.agg(F.coalesce(F.sum("n_pred"), F.lit(0)).alias("__p"), F.coalesce(F.sum("n_gt"), F.lit(0)).alias("__g"), F.count_if(F.col("n_gt") == 0).alias("__neg"), F.count_if((F.col("n_gt") == 0) & (F.col("n_pred") == 0)).alias("__ok"))
    x = found.join(all_, how="cross").select("*", F.inline("__m"))  # one row each
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = share(F.col("matches"), F.col("__p")), share(F.col("matches"), F.col("__g"))
    return x.select("threshold", "matches", p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"), share(F.col("__s"), F.col("__g")).alias("mean_iou"), share(F.col("__ok"), F.col("__neg")).alias("negative_accuracy"))


def length_cdf(df: DataFrame, length: Column, width: int) -> DataFrame:
    """Histogram of lengths by intervals of ``width`` with running share."""
    h = df.groupBy((F.floor(length / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    w = W.orderBy("bucket")  # over buckets, not rows
    return h.withColumn("cdf", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum("n").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def perplexity(df: DataFrame, key: str, logp: str) -> DataFrame:
    """exp of the mean negative log-probability of each sequence's tokens (array column)."""
    mean = F.aggregate(logp, F.lit(0.0), lambda a, v: a - v) / F.greatest(F.size(logp), F.lit(1))
    return df.select(key, F.exp(mean).alias("ppl"))


def category_accuracy(df: DataFrame, category: str, correct: str) -> DataFrame:
    """Accuracy of each category, and of all rows as "Average"."""
    g = df.rollup(category).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count("*").alias("n"), F.grouping(category).alias("all"))
    return g.select(F.when(F.col("all") == 1, "Average").otherwise(F.col(category).cast("string")).alias("category"), "accuracy", "n")


def token_accuracy(df: DataFrame, predicted: str, labels: str, ignore: int = -100) -> DataFrame:
    """Adds n and accuracy: predictions against labels one to the right, without ignored ones."""
    n = F.size(labels)
    pairs = F.filter(F.zip_with(F.slice(predicted, 1, F.greatest(n - 1, F.lit(0))), F.slice(labels, 2, F.greatest(n - 1, F.lit(0))), lambda p, t: F.struct(p.alias("p"), t.alias("t"))), lambda x: x["t"] != ignore)
    df = df.withColumn("__p", pairs).withColumn("n", F.size("__p"))
    return df.withColumn("accuracy", F.size(F.filter("__p", lambda x: x["p"] == x["t"])) / F.greatest("n", F.lit(1))).drop("__p")


def id_gaps(df: DataFrame, key: str) -> DataFrame:
    """(kind, id): ids that occur several times, and whole numbers between the least and the largest that don't occur."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("kind"), F.col(key).alias("id"))
    after = F.lead(key).over(W.partitionBy(F.floor(F.col(key) / 100_000)).orderBy(key))
    edges = df.select(key).distinct()
    # gaps inside blocks of 100,000 ids come from a window; those across blocks from the blocks' ends
    inside = edges.withColumn("next", after).where(F.col("next") > F.col(key) + 1).select(F.col(key).alias("a"), "next")
    ends = edges.groupBy(F.floor(F.col(key) / 100_000).alias("b")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    across = ends.withColumn("next", F.lead("lo").over(W.orderBy("b"))).where("next > hi + 1").select(F.col("hi").alias("a"), "next")
    # a long gap is dealt out in stretches of 100,000 ids
    gone = inside.union(across).select(F.explode(F.sequence(F.col("a") + 1, F.col("next") - 1, F.lit(100_000))).alias("from"), "next")
    gone = gone.select(F.lit("gap").alias("kind"), F.explode(F.sequence("from", F.least(F.col("from") + 99_999, F.col("next") - 1))).alias("id"))
    return twice.unionByName(gone)


def completeness(results: DataFrame, expected: int, bad: Column, degraded: Column) -> DataFrame:
    """One row: rows found against expected, and INVALID (rows missing), DEGRADED (some failed) or VALID."""
    s = results.agg(F.count("*").alias("rows"), F.count_if(degraded | bad).alias("failed"))
    status = F.when(F.col("rows") < expected, "INVALID").when(F.col("failed") > 0, "DEGRADED").otherwise("VALID")
    return s.select("rows", F.lit(expected).alias("expected"), "failed", status.alias("status"))


#: What a detection score near zero most likely comes from.
CAUSES = ["no_parsed_predictions", "most_images_without_predictions", "boxes_elsewhere", "class_names_wrong", "training_or_prompt"]


def diagnose(images: DataFrame, preds: DataFrame, truths: DataFrame, pairs: DataFrame, image: str = "image_id") -> DataFrame:
    """One row on why a detection score is near zero: totals, means of each prediction's best IoU, and likely causes.

    ``images`` has one row an image, ``preds`` (image, pred), ``truths`` (image, gt), and ``pairs`` (image, pred, iou,
    same_class) the overlapping pairs of any class. A prediction without a pair counts as 0; without predictions both means are 0.
    """
    best = pairs.groupBy(image, "pred").agg(F.max("iou").alias("any"), F.max(F.when(F.col("same_class"), F.col("iou"))).alias("same"))
    held = preds.select(image, "pred").join(best, [image, "pred"], "left").agg(
        F.count(F.lit(1)).alias("pred_total"), F.coalesce(F.avg(F.coalesce("any", F.lit(0.0))), F.lit(0.0)).alias("mean_best_iou_any_class"), F.coalesce(F.avg(F.coalesce("same", F.lit(0.0))), F.lit(0.0)).alias("mean_best_iou_same_class")
    )
    rows = images.join(preds.select(image).distinct().withColumn("__p", F.lit(1)), image, "left").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__p").isNull()).alias("rows_no_predictions"))
    out = rows.crossJoin(held).crossJoin(truths.agg(F.count(F.lit(1)).alias("gt_total")))  # one row each
    anyc, same = F.col("mean_best_iou_any_class"), F.col("mean_best_iou_same_class")
    told = [F.col("pred_total") == 0, F.col("rows_no_predictions") * 2 > F.greatest("rows", F.lit(1)), (anyc < 0.1) & (F.col("pred_total") > 0), (anyc > 0.3) & (same < 0.1)]
    causes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in zip(told, CAUSES)]))
    rest = (F.size(causes) == 0) & (F.col("gt_total") > 0) & (F.col("pred_total") > 0)
    return out.withColumn("causes", F.when(rest, F.array(F.lit(CAUSES[4]))).otherwise(causes))


def _common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence: a row of bits for the shorter list, one step for each item of the longer."""
    if len(a) > len(b):
        a, b = b, a
    places: dict = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & places.get(t, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def text_overlap(df: DataFrame, key: list[str], pred: str, label: str) -> DataFrame:
    """(key, rouge_1, rouge_2, rouge_l, bleu_4) in percent, four decimals, of each prediction against its label.

    ROUGE-N is the F1 of clipped n-gram counts of words (between white space), ROUGE-L that of the longest common subsequence of
    words; 0 where either has none. BLEU-4 is over characters, with brevity penalty, and the orders without a match smoothed: the
    k-th of them counts 1 / (2^k n-grams). N-grams are counted on both sides by one shuffle on (key, n-gram), summed
    before it; so a long text is no large group. ``key`` is unique; null texts are empty.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    chars = lambda c: F.regexp_extract_all(text(c), F.lit("(?s)."), F.lit(0))
    words = lambda c: F.regexp_extract_all(text(c), F.lit(r"\S+"), F.lit(0))
    base = df.select(*key, *[f(c).alias(n) for f, k in ((chars, "c"), (words, "w")) for c, n in ((pred, f"__{k}p"), (label, f"__{k}l"))])

    def grams(kind: str, side: str, n: int) -> Column:
        tokens = F.col(f"__{kind}{side}")
        every = F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), "\x01"))).otherwise(F.array().cast("array<string>"))
        return F.transform(every, lambda g: F.struct(F.lit(f"{kind}{n}").alias("kind"), g.alias("gram"), F.lit(int(side == "p")).alias("p")))

    rows = base.select(*key, F.explode(F.concat(*[grams(k, s, n) for k, top in (("c", 4), ("w", 2)) for n in range(1, top + 1) for s in "pl"])).alias("g")).select(*key, "g.*")
    counts = rows.groupBy(*key, "kind", "gram").agg(F.sum("p").alias("p"), F.sum(1 - F.col("p")).alias("l"))
    kinds = ["c1", "c2", "c3", "c4", "w1", "w2"]
    of = lambda k, v: F.coalesce(F.sum(F.when(F.col("kind") == k, v)), F.lit(0))
    sums = counts.groupBy(*key).agg(*[x for k in kinds for x in (of(k, F.least("p", "l")).alias(f"m{k}"), of(k, F.col("p")).alias(f"p{k}"), of(k, F.col("l")).alias(f"l{k}"))])

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_common_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int64")

    long = base.select(*key, F.size("__wp").alias("np"), F.size("__wl").alias("nl"), common("__wp", "__wl").alias("lcs"))
    out = long.join(sums, key, "left").na.fill(0)

    def f1(m: Column, p: Column, l: Column) -> Column:  # noqa: E741
        a, b = m / p, m / l
        return F.when((p > 0) & (l > 0), 2 * a * b / (a + b + 1e-8)).otherwise(F.lit(0.0))

    logs, empty = F.lit(0.0), F.lit(0)
    for n in range(1, 5):
        m, d = F.col(f"mc{n}"), F.greatest(F.lit(1), F.col("pc1") - (n - 1))
        empty = empty + (m == 0).cast("int")
        logs = logs + 0.25 * F.log(F.when(m > 0, m / d).otherwise(1 / (F.pow(F.lit(2.0), empty) * d)))
    bleu = F.when(F.col("mc1") == 0, 0.0).otherwise(F.when(F.col("pc1") > F.col("lc1"), 1.0).otherwise(F.exp(1 - F.col("lc1") / F.col("pc1"))) * F.exp(logs))
    score = lambda v, name: F.round(v * 100, 4).alias(name)
    return out.select(*key, score(f1(F.col("mw1"), F.col("pw1"), F.col("lw1")), "rouge_1"), score(f1(F.col("mw2"), F.col("pw2"), F.col("lw2")), "rouge_2"), score(f1(F.col("lcs"), F.col("np"), F.col("nl")), "rouge_l"), score(bleu, "bleu_4"))
