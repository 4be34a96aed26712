"""Checks and combinations of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def append_disjoint(base: DataFrame, extra: DataFrame, key: str = "row_id") -> DataFrame:
    """Union of a prepared history and newer rows; shared ids are an error."""
    if not shared_keys(base, extra, key).isEmpty():
        raise ValueError(f"both sides hold the same {key}")
    return base.unionByName(extra)


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key)).where(F.col(key).isNotNull())


def check_single_date(rows: DataFrame, column: str, day: str) -> DataFrame:
    """Rows outside the one date a daily file may hold."""
    return rows.where(~F.to_date(column).eqNullSafe(F.lit(day).cast("date")))


def split_overlap(prepared: DataFrame, key: str = "row_id", split: str = "split") -> DataFrame:
    """Ids that occur in more than one of train, validation and test."""
    return (
        prepared.where(F.col(split).isin("train", "validation", "test")).groupBy(key)
        .agg(F.min(split).alias("_a"), F.max(split).alias("_b")).where("_a <> _b").select(key)
    )


def compare_builds(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(change, groups): groups added, removed, unchanged and changed between two builds."""
    side = lambda frame, name: frame.select(*keys, F.struct(*values).alias(name))
    both = side(old, "_old").join(side(new, "_new"), keys, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), F.lit("added"))
        .when(F.col("_new").isNull(), F.lit("removed"))
        .when(F.col("_old").eqNullSafe(F.col("_new")), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("groups"))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Equal as bags of rows, whatever the order."""
    columns = left.columns
    if set(columns) != set(right.columns):
        return False
    other = right.select(*columns)
    return left.exceptAll(other).isEmpty() and other.exceptAll(left).isEmpty()
