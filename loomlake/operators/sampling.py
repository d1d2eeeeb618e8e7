"""Sampling, splitting, ordering, mixing and set operations; random choices are hashes of (seed, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomlake.operators.windows import global_rank


def dice(seed: int, *keys: str) -> Column:
    """A random order that depends on seed and keys only, the same in any engine."""
    return F.sha1(F.concat_ws("||", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _first(df: DataFrame, order: Column, n: int) -> DataFrame:
    """The first ``n`` rows in an order, where n may grow with the table: ranked in ranges, so no task holds them all."""
    return global_rank(df.withColumn("__o", order), ["__o"], "__r").where(F.col("__r") < n).drop("__o", "__r")


def sample(df: DataFrame, ratio: float, key: str, mode: str = "random", seed: int = 0) -> DataFrame:
    """max(1, floor(n * ratio)) rows: the first in random order, or every floor(n / k)-th in order of ``key``."""
    n = df.count()
    k = max(1, int(n * ratio))
    if mode == "random":
        return _first(df, dice(seed, key), k)
    step = max(1, n // k)
    ranked = global_rank(df, [key], "__r")
    return ranked.where((F.col("__r") % step == 0) & (F.col("__r") < step * k)).drop("__r")


def exact_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows: whole copies of the table, then the first rows in random order. Adds ``copy``."""
    size = df.count()
    if not size:
        return df.withColumn("copy", F.lit(0))
    whole, rest = divmod(n, size)
    parts = [df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(whole - 1))))] if whole else []
    if rest:
        parts.append(_first(df, dice(seed, key), rest).withColumn("copy", F.lit(whole)))
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0).withColumn("copy", F.lit(0))


def split(df: DataFrame, val: int, buckets: int, *keys: str, seed: int = 0) -> DataFrame:
    """Adds ``split``: "val" for about ``val`` of ``buckets`` parts of the keys, by hash; rows of a key stay together."""
    b = F.conv(F.substring(dice(seed, *keys), 1, 8), 16, 10).cast("long") % buckets
    return df.withColumn("split", F.when(b < val, "val").otherwise("train"))


def cap_per_group(df: DataFrame, group: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of each group, chosen at random."""
    w = W.partitionBy(group).orderBy(dice(seed, key))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def round_robin(df: DataFrame, buckets: list[str], key: str, seed: int = 0) -> DataFrame:
    """Adds ``turn`` (place in its bucket) and ``bucket_key``: ordered by both, rows take turns over the buckets."""
    w = W.partitionBy(*buckets).orderBy(dice(seed, key))
    return df.withColumn("turn", F.row_number().over(w)).withColumn("bucket_key", dice(seed, *buckets))


def scene_split(df: DataFrame, scene: str, split_col: str, target: int) -> DataFrame:
    """Adds ``scene_split``: all rows of a scene in one split, by majority (a tie is train). If val then has too few
    rows, train scenes move, the smallest first, as long as the rows moved so far do not reach what is missing."""
    s = df.groupBy(scene).agg(F.count("*").alias("n"), F.count_if(F.col(split_col) == "val").alias("v"))
    s = s.withColumn("maj", F.when(F.col("v") * 2 > F.col("n"), "val").otherwise("train"))
    have = s.where("maj = 'val'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    missing = target - have
    if missing > 0:
        moved = global_rank(s.where("maj = 'train'"), ["n", scene], "__r", running="n")
        moved = moved.where(F.col("__before") < missing).select(scene, F.lit(True).alias("__m"))
        s = s.join(moved, scene, "left").withColumn("maj", F.when(F.col("__m"), "val").otherwise(F.col("maj"))).drop("__m")
    return df.join(s.select(scene, F.col("maj").alias("scene_split")), scene)


def batches(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Adds ``batch``: rows in random order, ``n`` to a batch; an incomplete last batch goes."""
    total = df.count()
    ranked = global_rank(df.withColumn("__d", dice(seed, key)), ["__d"], "__r")
    return ranked.withColumn("batch", F.floor(F.col("__r") / n)).where(F.col("batch") < total // n).drop("__r", "__d")


def repeat(df: DataFrame, n: int, key: str, interleave: bool = True) -> DataFrame:
    """Each row ``n`` times. ``place`` sorts copies next to each other, or whole tables after each other."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("place", F.struct(F.col(key), F.col("copy")) if interleave else F.struct(F.col("copy"), F.col(key)))


def pad_to(df: DataFrame, divisor: int, key: str) -> DataFrame:
    """Rows from the start again until the number divides; ``pad`` marks them, so dropping them restores the table."""
    n = df.count()
    more = -n % divisor
    out = df.withColumn("pad", F.lit(False))
    while more > 0:
        out = out.unionByName(_first(df, F.col(key), more).withColumn("pad", F.lit(True)))
        more -= min(more, max(1, n))
    return out


def chunks(df: DataFrame, n: int, key: str, name: str = "chunk") -> DataFrame:
    """Adds ``name``, 0 to n - 1: consecutive rows by ``key`` in n parts whose sizes differ by at most one, larger ones first.

    Ranks are of the whole table, in ranges; the table is counted once.
    """
    size = df.count()
    small, more = divmod(size, n)
    r = F.col("__r")
    part = F.when(r < more * (small + 1), F.floor(r / (small + 1))).otherwise(F.lit(more) + F.floor((r - more * (small + 1)) / max(1, small)))
    return global_rank(df, [key], "__r").withColumn(name, part.cast("int")).drop("__r")


def unpad(df: DataFrame) -> DataFrame:
    """The rows that ``pad_to`` was given."""
    return df.where(~F.col("pad")).drop("pad")


def interleave(sources: list[DataFrame], key: str, stop: str = "first") -> DataFrame:
    """Rows of the sources in turn: ``place`` orders them. Stops when the first source ends, or goes on until the
    last one ends, beginning shorter ones anew."""
    sizes = [s.count() for s in sources]
    out = []
    for i, (s, n) in enumerate(zip(sources, sizes)):
        r = global_rank(s, [key], "__r")
        if stop == "first":
            r = r.where(F.col("__r") < min(sizes))
        elif n:
            again = -(-max(sizes) // n)
            r = r.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(again - 1)))).withColumn("__r", F.col("__r") + F.col("__k") * n).where(F.col("__r") < max(sizes)).drop("__k")
        out.append(r.withColumn("source", F.lit(i)).withColumn("place", F.col("__r") * len(sources) + i).drop("__r"))
    return reduce(DataFrame.unionByName, out)


def interleave_drawn(sources: list[DataFrame], probabilities: list[float], key: str, stop: str = "first", seed: int = 0) -> DataFrame:
    """Rows of the sources, each place's source drawn by its probability from a hash of (seed, place); ``place`` orders them.

    The n-th draw of a source takes its n-th row by ``key``. With "first" the last place is where some source has given its last row,
    with "all" where all have, and sources that end earlier begin anew. Draws are ranked by range partitions and
    joined to ranked rows; sources are never collected.
    """
    if stop not in ("first", "all") or len(sources) != len(probabilities) or min(probabilities) <= 0 or abs(sum(probabilities) - 1) > 1e-9:
        raise ValueError("one positive probability for each source, of sum 1, and stop first or all")
    spark, sizes = sources[0].sparkSession, [s.count() for s in sources]
    if min(sizes) == 0:
        return reduce(DataFrame.unionByName, [s.limit(0) for s in sources]).withColumns({"source": F.lit(0), "place": F.lit(0).cast("long")})
    bounds = [sum(probabilities[: i + 1]) for i in range(len(sources))]
    unit = F.conv(F.substring(F.sha1(F.concat_ws("||", F.lit(str(seed)), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    which = F.lit(len(sources) - 1)
    for i in range(len(sources) - 2, -1, -1):
        which = F.when(unit < bounds[i], i).otherwise(which)
    ends, places = [], int(max(n / p for n, p in zip(sizes, probabilities)) * 1.2) + 100
    while True:
        draws = spark.range(places).select(F.col("id").alias("place"), which.alias("source"))
        ranked = global_rank(draws, ["source", "place"], "__at")
        starts = ranked.groupBy("source").agg(F.min("__at").alias("__first"))
        ranked = ranked.join(F.broadcast(starts), "source").withColumn("__k", F.col("__at") - F.col("__first"))
        last = F.create_map(*[x for i, n in enumerate(sizes) for x in (F.lit(i), F.lit(n - 1).cast("long"))])
        ends = [r.place for r in ranked.where(F.col("__k") == F.element_at(last, F.col("source"))).select("place").collect()]  # one row a source at most
        if len(ends) == len(sources) or (stop == "first" and ends):
            break
        places *= 2
    end = min(ends) if stop == "first" else max(ends)
    ranked = ranked.where(F.col("place") <= end).select("place", "source", "__k")
    out = [global_rank(s, [key], "__r").join(ranked.where(F.col("source") == i).withColumn("__r", F.col("__k") % n).drop("__k"), "__r").drop("__r") for i, (s, n) in enumerate(zip(sources, sizes))]
    return reduce(DataFrame.unionByName, out)


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ids in one table only."""
    only = lambda x, y, s: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(s))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of each table that the other has not, counted with repeats, and whether there are none."""
    b = b.select(a.columns)
    x, y = a.exceptAll(b).agg(F.count("*").alias("only_left")), b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return x.crossJoin(y).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def distinct_first(df: DataFrame, key: list[Column], order: str) -> DataFrame:
    """The first row, by ``order``, of each key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("__r = 1").drop("__r")


def todo(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not done yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def batch_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both by row id; columns that both have must agree, else the job fails."""
    shared = [c for c in b.columns if c in a.columns and c != key]
    j = a.join(b.select(key, *[F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in b.columns if c != key]), key)
    for c in shared:
        j = j.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")))).drop(f"__{c}")
    return j
