"""Whole-table ranks without one big window: range partitions are ranked on their own and shifted by their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def global_rank(df: DataFrame, order: list[str | Column], name: str, running: str | None = None, blocks: int | None = None) -> DataFrame:
    """Adds ``name``: the row's place (from 0) in the order of all rows; with ``running`` also ``__before``, the sum of
    that column over all earlier rows.

    Rows go to sorted range partitions; a small table has each partition's size. No task holds more than
    its own range. There are as many ranges as spark.sql.shuffle.partitions tells, or ``blocks`` of them.
    """
    ranged = (df.repartitionByRange(blocks, *order) if blocks else df.repartitionByRange(*order)).withColumn("__b", F.spark_partition_id())
    inside = W.partitionBy("__b").orderBy(*order)
    ranged = ranged.withColumn("__n", F.row_number().over(inside))
    if running:
        ranged = ranged.withColumn("__s", F.sum(running).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    from loomlake.session import materialize

    ranged = materialize(ranged, "ranked")  # partition numbers must not change between the two uses
    sums = ranged.groupBy("__b").agg(F.count("*").alias("__c"), *([F.sum(running).alias("__t")] if running else []))
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c0"), *([F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__t0")] if running else []))
    out = ranged.join(F.broadcast(starts), "__b").withColumn(name, F.col("__c0") + F.col("__n") - 1)
    if running:
        out = out.withColumn("__before", F.col("__t0") + F.col("__s") - F.col(running)).drop("__s", "__t0")
    return out.drop("__b", "__n", "__c0")
