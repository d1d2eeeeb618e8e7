"""Sharding by sampled splitters, with DataFrame functions only.

Rows are ordered by (md5 of the text, id), so equal texts are neighbours. A size-weighted sample of these
keys gives quantile boundaries; rows are range-partitioned by them. Inside a range a running sum of sizes
tells each row's exact place in the whole order of bytes, so a range that is overfull, or lies across a
shard boundary, is subdivided at exactly the row where the next shard begins. As the id is part of the
key, a text that fills many ranges on its own is split like any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from loomlake.session import materialize

#: Keys sampled for each range; with 60, hardly any range gets over 1.5 times its share.
SAMPLES = 60


def shard_bytes(docs: DataFrame, n_shards: int = 16, rows_per_range: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    ``size`` is the UTF-8 bytes of the text plus 1; a null text has size 1 and the CRC of nothing, 0.
    The order of all rows by (md5 of text, id) is cut where the running size passes each multiple of
    total / ``n_shards`` (a row belongs where its middle byte lies), so shards differ by less than two rows'
    sizes. Slots count from 0 in that order. Rows with equal keys (the same id and text twice, or null
    ids) get different slots in the order of row numbers that are written with them, so many of them make many ranges. An empty table gives no rows. Texts are read once; all further
    steps use about 60 bytes a row. Boundaries on the driver: one key a range.
    """
    text = F.col(f"`{text_col}`")
    key = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"), key.alias("key"))
    narrow = materialize(narrow.withColumn("row", F.monotonically_increasing_id()), "shard")  # tells equal keys apart
    rows, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(4096, max(48, -(-rows // rows_per_range)))
    point = F.struct("key", F.col("id").cast("string").alias("id"), "row")
    # each row is drawn with a chance in proportion to its size: about SAMPLES * ranges keys in all
    chance = F.col("size") * F.lit(SAMPLES * ranges / max(1, total))
    drawn = narrow.where((F.pmod(F.xxhash64("key", "id", "row", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < chance).select(point.alias("p"))
    place = F.ntile(ranges).over(W.orderBy("p"))
    bounds = [r[0] for r in drawn.select("p", place.alias("t")).groupBy("t").agg(F.min("p").alias("p")).where("t > 1").orderBy("p").select("p").toLocalIterator()]
    # 64 boundaries at a time, so that a row is compared with few of them however many ranges there are
    place_of = lambda cut: F.size(F.filter(cut, lambda s: s <= point))
    keys = lambda some: F.array(*[F.struct(F.lit(b["key"]).alias("key"), F.lit(b["id"]).cast("string").alias("id"), F.lit(b["row"]).cast("long").alias("row")) for b in some])
    if bounds:
        coarse = place_of(keys(bounds[63::64])) if len(bounds) > 63 else F.lit(0)
        ranged = narrow.withColumn("coarse", coarse).withColumn("range", F.col("coarse") * 64 + place_of(F.slice(keys(bounds), F.col("coarse") * 64 + 1, 64)))
    else:
        ranged = narrow.withColumn("range", F.lit(0))
    inside = W.partitionBy("range").orderBy("key", F.col("id").cast("string"), "row")
    upto = ranged.withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.row_number().over(inside).cast("long"))
    upto = materialize(upto, "ranges")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = upto.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))  # a row for each range
    starts = sums.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"))
    middle = (F.col("bytes0") + F.col("upto")) * 2 - F.col("size")
    placed = upto.join(F.broadcast(starts), "range").withColumn("middle", middle).withColumn("rank", F.col("rows0") + F.col("n") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast(least({n_shards - 1}, ({n_shards} * middle) div {2 * max(1, total)}) as int)"))
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
