"""Dense row numbers over a whole frame without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lagline.staging import staged


def number_rows(frame: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Add a dense number in `order` (which must be unique).

    Range partitioning spreads the sort. The ranged frame is stored once, because
    its partition numbers must not change between counting and numbering.
    """
    ranged = staged(frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition of the stored frame: bounded by the partition count.
    offsets = (
        ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (
        ranged.withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_local") - 1 + start).cast("bigint"))
        .drop("_part", "_local", "_offset")
    )
