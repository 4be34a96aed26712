"""Grouped departure timing with daily cluster-robust intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lagline.operators.clean import GROUP

TIMING_MAX_DELAY = 3600
EARLY_BELOW = -60
LATE_ABOVE = 300
MIN_OBSERVATIONS = 30
MIN_DATES = 5
Z_95 = 1.96
CATEGORIES = ["early", "within", "late"]


def in_timing_range(limit: int = TIMING_MAX_DELAY) -> Column:
    return F.abs("delay") <= limit


def daily_counts(visits: DataFrame, keys: list[str] = GROUP, limit: int = TIMING_MAX_DELAY) -> DataFrame:
    delay = F.col("delay")
    return (
        visits.where(in_timing_range(limit))
        .groupBy(*keys, "day")
        .agg(
            F.count(F.lit(1)).alias("visits"),
            F.count_if(delay < EARLY_BELOW).alias("early"),
            F.count_if(delay.between(EARLY_BELOW, LATE_ABOVE)).alias("within"),
            F.count_if(delay > LATE_ABOVE).alias("late"),
            F.count_if(delay < 0).alias("before_schedule"),
        )
    )


def group_summary(
    daily: DataFrame,
    keys: list[str] = GROUP,
    min_observations: int = MIN_OBSERVATIONS,
    min_dates: int = MIN_DATES,
) -> DataFrame:
    """Sums, squares and cross-products of the daily counts of every large enough group."""
    sums = [F.sum(c).alias(c) for c in ("visits", *CATEGORIES, "before_schedule")]
    squares = [F.sum(F.col(c) * F.col(c)).alias(f"{c}_squares") for c in ("visits", *CATEGORIES)]
    cross = [F.sum(F.col(c) * F.col("visits")).alias(f"{c}_cross") for c in CATEGORIES]
    return (
        daily.groupBy(*keys)
        .agg(
            *sums, F.count(F.lit(1)).alias("dates"),
            F.min("day").alias("coverage_start"), F.max("day").alias("coverage_end"), *squares, *cross,
        )
        .where((F.col("visits") >= min_observations) & (F.col("dates") >= min_dates))
    )


def group_quantiles(visits: DataFrame, keys: list[str] = GROUP, limit: int = TIMING_MAX_DELAY) -> DataFrame:
    """Exact p10, median and p90. The range filter bounds a group's value counts at
    2 * limit + 1, so partial results stay small however many visits a group has."""
    quantiles = F.percentile("delay", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return (
        visits.where(in_timing_range(limit))
        .groupBy(*keys)
        .agg(quantiles.alias("_q"))
        .select(
            *keys, F.col("_q")[0].alias("p10_seconds"), F.col("_q")[1].alias("median_seconds"),
            F.col("_q")[2].alias("p90_seconds"),
        )
    )


def share_intervals(summary: DataFrame) -> DataFrame:
    """Add shares and their 95 % intervals, each date one independent cluster."""
    columns = {"before_schedule_share": F.col("before_schedule") / F.col("visits")}
    for name in CATEGORIES:
        share = F.col(name) / F.col("visits")
        residuals = (
            F.col(f"{name}_squares") - 2 * share * F.col(f"{name}_cross") + share * share * F.col("visits_squares")
        )
        # A one-date group has no spread between dates; like a zero divisor it gives null.
        correction = F.try_divide(F.col("dates"), F.col("dates") - 1)
        variance = correction * residuals / (F.col("visits") * F.col("visits"))
        margin = Z_95 * F.sqrt(F.greatest(F.lit(0.0), variance))
        columns[f"{name}_share"] = share
        columns[f"{name}_low"] = F.round(F.greatest(F.lit(0.0), share - margin), 4)
        columns[f"{name}_high"] = F.round(F.least(F.lit(1.0), share + margin), 4)
    return summary.withColumns(columns)


def timing_groups(
    visits: DataFrame,
    keys: list[str] = GROUP,
    limit: int = TIMING_MAX_DELAY,
    min_observations: int = MIN_OBSERVATIONS,
    min_dates: int = MIN_DATES,
    reports: DataFrame | None = None,
) -> DataFrame:
    """Timing statistics per group; `reports` adds the nearby report count (100 m profile).

    Summary and quantiles both end hash-partitioned by the group, so joining them
    moves nothing again.
    """
    summary = group_summary(daily_counts(visits, keys, limit), keys, min_observations, min_dates)
    joined = share_intervals(summary).join(group_quantiles(visits, keys, limit), keys)
    columns = [
        *keys, F.col("visits").alias("observations"), F.col("dates").alias("distinct_dates"),
        "coverage_start", "coverage_end", "median_seconds", "p10_seconds", "p90_seconds",
        *[f"{c}_share" for c in CATEGORIES], "before_schedule_share",
        *[f"{c}_{end}" for c in CATEGORIES for end in ("low", "high")],
    ]
    result = joined.select(*columns)
    if reports is None:
        return result
    nearby = reports.select(*keys, F.col("reports_100m").alias("_nearby"))
    return result.join(nearby, keys, "left").withColumn(
        "nearby_reports", F.coalesce("_nearby", F.lit(0)).cast("bigint")
    ).drop("_nearby")


def reference_exposure(visits: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Recorded visits and dates per group, late visits included.

    Counting per day first replaces a distinct count over raw rows.
    """
    return (
        visits.groupBy(*keys, "day")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("recorded_departures"), F.count(F.lit(1)).alias("departure_dates"),
            F.min("day").alias("reference_start"), F.max("day").alias("reference_end"),
        )
    )
