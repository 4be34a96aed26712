"""Profiles of sources and prepared departures: counts, calendars, histograms, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lagline.functions.clock import RECENT_FORMAT, wall_time
from lagline.functions.text import strict_integer
from lagline.operators.clean import as_metrics


def source_profile(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Row, null, invalid and distinct counts of the text source as (metric, value) rows.

    Distinct counts run as separate aggregates: several in one would copy every row.
    """
    time = wall_time(F.col("scheduled_time_raw"), RECENT_FORMAT)
    scalars = raw.agg(
        F.count(F.lit(1)).alias("source_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
        F.count_if(time.isNull()).alias("invalid_scheduled_times"),
        F.count_if(strict_integer(F.col("deviation_raw")).isNull()).alias("invalid_deviations"),
        F.count_if(F.contains(F.col("deviation_raw"), F.lit(","))).alias("deviations_with_commas"),
        F.count("row_id").alias("_ids"),
    )
    stops = raw.select("stop_number").where("stop_number is not null").distinct().agg(
        F.count(F.lit(1)).alias("unique_stops")
    )
    routes = raw.select("route_number").where("route_number is not null").distinct().agg(
        F.count(F.lit(1)).alias("unique_routes")
    )
    # Candidates are rows beyond the first of each 64-bit id digest, nulls sharing one.
    ids = raw.groupBy(F.xxhash64("row_id").alias("_h")).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_id_candidates")
    )
    parts = [as_metrics(scalars.drop("_ids")), as_metrics(stops), as_metrics(routes), as_metrics(ids)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def value_counts(rows: DataFrame, column: str | Column, name: str = "value") -> DataFrame:
    """Most common first; ties by value."""
    value = F.col(column) if isinstance(column, str) else column
    return (
        rows.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name)
        .agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), name)
    )


def order_breaks(rows: DataFrame, time: str, order: str, block: int = 1_000_000) -> DataFrame:
    """One row: rows, rows earlier than their predecessor in source order, and `is_sorted`.

    Source order is the number `order`, which may have gaps. Windows cover one block of it
    each; block ends meet in a window over one row per block that has rows.
    """
    blocks = rows.select(F.col(order).alias("_o"), F.col(time).alias("_t")).withColumn(
        "_b", F.floor(F.col("_o") / block)
    )
    previous = F.lag("_t").over(W.partitionBy("_b").orderBy("_o"))
    inside = blocks.withColumn("_drop", F.col("_t") < previous).groupBy("_b").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("_drop").alias("drops"),
        F.count_if(F.col("_t").isNull()).alias("gaps"),
        F.min_by("_t", "_o").alias("_first"), F.max_by("_t", "_o").alias("_last"),
    )
    return (
        inside.withColumn("_before", F.lag("_last").over(W.orderBy("_b")))
        .agg(
            F.sum("rows").alias("rows"),
            (F.sum("drops") + F.count_if(F.col("_first") < F.col("_before"))).alias("backward_steps"),
            F.sum("gaps").alias("unreadable_times"),
        )
        .withColumn("is_sorted", (F.col("backward_steps") == 0) & (F.col("unreadable_times") == 0))
    )


def split_profile(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("baseline_eligible").alias("baseline_eligible"),
        F.count_if("flag_extreme_delay").alias("extreme_delay"),
        F.count_if("flag_duplicate_candidate").alias("duplicate_candidates"),
        F.min("scheduled_time_local").alias("date_min"),
        F.max("scheduled_time_local").alias("date_max"),
    )


def route_profile(prepared: DataFrame) -> DataFrame:
    """Flag totals and extremes of one route as (metric, value) rows."""
    flags = [c for c in prepared.columns if c.startswith("flag_")]
    extreme = F.col("flag_extreme_delay")
    return as_metrics(
        prepared.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if("baseline_eligible").alias("baseline_eligible_rows"),
            F.count_if(~F.col("valid_required_fields")).alias("invalid_required_rows"),
            *[F.count_if(F.col(c)).alias(c) for c in flags],
            F.count_if(extreme & (F.col("delay_seconds") < 0)).alias("extreme_early_rows"),
            F.count_if(extreme & (F.col("delay_seconds") > 0)).alias("extreme_late_rows"),
        )
    )


def delay_quantiles(prepared: DataFrame, value: str = "delay_seconds") -> DataFrame:
    """Fixed quantiles of all delays; counts per value come first, so the final
    aggregate sees each distinct second once."""
    wanted = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
    counted = prepared.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    spread = F.percentile("_v", F.array(*[F.lit(q) for q in wanted]), F.col("_n"))
    return (
        counted.agg(spread.alias("_q"))
        .select(F.posexplode("_q").alias("_i", "delay_seconds"))
        .select(F.array(*[F.lit(q) for q in wanted])[F.col("_i")].alias("quantile"), "delay_seconds")
    )


def daily_coverage(rows: DataFrame, day: str = "day") -> DataFrame:
    """Rows per calendar day from the first to the last day, absent days as zero."""
    observed = rows.where(F.col(day).isNotNull()).groupBy(F.col(day).alias("day")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    calendar = observed.agg(F.sequence(F.min("day"), F.max("day")).alias("days")).select(
        F.explode("days").alias("day")
    )
    return calendar.join(observed, "day", "left").select("day", F.coalesce("_n", F.lit(0)).alias("rows"))


def missing_dates(rows: DataFrame, day: str = "day") -> DataFrame:
    return daily_coverage(rows, day).where("rows = 0").select("day")


def extreme_by_date(prepared: DataFrame) -> DataFrame:
    return prepared.where("flag_extreme_delay").groupBy("scheduled_date").agg(F.count(F.lit(1)).alias("rows"))


def hour_profile(rows: DataFrame, minimum_count: int = 20, value: str = "delay_seconds") -> DataFrame:
    """Median delay by day type for each of the 24 hours; thin hours stay, without a median."""
    medians = (
        rows.where(F.col("day_type").isNotNull() & F.col("hour").isNotNull() & F.col(value).isNotNull())
        .groupBy("day_type", "hour", F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("day_type", "hour")
        .agg(F.percentile("_v", F.lit(0.5), F.col("_n")).alias("median"), F.sum("_n").alias("count"))
    )
    spine = medians.select("day_type").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    kept = medians.where(F.col("count") >= minimum_count)
    return spine.join(kept, ["day_type", "hour"], "left")


def delay_histogram(
    rows: DataFrame, value: str = "delay_seconds", low_minutes: int = -10, high_minutes: int = 30, bins: int = 100
) -> DataFrame:
    """Counts per equal bin of the delay range; bin 0 holds what lies outside. Whole
    seconds decide the bin, and the last bin includes its upper edge."""
    low, high = low_minutes * 60, high_minutes * 60
    seconds = F.col(value)
    number = F.least(F.floor((seconds - low) * bins / F.lit(high - low)) + 1, F.lit(bins))
    return (
        rows.where(seconds.isNotNull())
        .select(F.when(seconds.between(low, high), number).otherwise(0).cast("int").alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))
    )


def top_delays(prepared: DataFrame, limit: int = 6) -> DataFrame:
    """The report's list of largest flagged delays; row id breaks ties."""
    return (
        prepared.where("flag_extreme_delay").withColumn("magnitude", F.abs("delay_seconds"))
        .orderBy(F.desc("magnitude"), "row_id").limit(limit)
        .select("row_id", "stop_number", "destination", "scheduled_time_local", "delay_seconds")
    )


def top_stops(rows: DataFrame, minimum_count: int = 100, limit: int = 10, value: str = "delay_seconds") -> DataFrame:
    """The report's list of stops and destinations with the highest median delay."""
    keys = ["stop_number", "destination"]
    return (
        rows.where(F.col(value).isNotNull() & F.col("stop_number").isNotNull() & F.col("destination").isNotNull())
        .groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(F.percentile("_v", F.lit(0.5), F.col("_n")).alias("median"), F.sum("_n").alias("count"))
        .where(F.col("count") >= minimum_count)
        .orderBy(F.desc("median"), *keys).limit(limit)
    )


def filter_reports(
    reports: DataFrame,
    first_day: str,
    last_day: str,
    route: str | None = None,
    kind: str | None = None,
    query: str | None = None,
) -> DataFrame:
    """Inclusive local dates, optional route and type, and case-blind text in id or
    destination. An empty route is a route like any other."""
    kept = reports.where(F.to_date("reported").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    if route is not None:
        kept = kept.where(F.coalesce("route", F.lit("")) == route)
    if kind is not None:
        kept = kept.where(F.col("type") == kind)
    if query:
        text = F.lower(F.concat_ws(" ", "rid", "dest"))
        kept = kept.where(F.contains(text, F.lit(query.lower())))
    return kept


def report_summary(reports: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Zero-filled months, hours and weekdays (Monday 0), counts per route and type,
    reports without a location and the total, as (part, member, records) rows."""
    at = F.col("reported")
    month = F.date_format(at, "yyyy-MM")
    members = {
        "month": month, "hour": F.format_string("%02d", F.hour(at)), "weekday": F.weekday(at).cast("string"),
        "route": F.coalesce("route", F.lit("")), "type": F.coalesce("type", F.lit("")),
        "missing_location": F.when(F.col("lon").isNull() | F.col("lat").isNull(), F.lit("all")),
        "records": F.lit("all"),
    }
    # Joint counts first; the parts then share those counts instead of copying rows.
    joint = reports.select(*[c.alias(n) for n, c in members.items()]).groupBy(*members).agg(
        F.count(F.lit(1)).alias("_n")
    )
    tags = F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).alias("member")) for n in members])
    counted = (
        joint.withColumn("_t", F.explode(tags)).where(F.col("_t.member").isNotNull())
        .groupBy(F.col("_t.part").alias("part"), F.col("_t.member").alias("member"))
        .agg(F.sum("_n").alias("_n"))
    )
    spark = reports.sparkSession
    first, last = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    month_steps = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
    expected = {
        "month": F.transform(month_steps, lambda d: F.date_format(d, "yyyy-MM")),
        "hour": F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.format_string("%02d", h)),
        "weekday": F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: d.cast("string")),
        "missing_location": F.array(F.lit("all")), "records": F.array(F.lit("all")),
    }
    parts = F.array(*[F.struct(F.lit(n).alias("part"), m.alias("members")) for n, m in expected.items()])
    spine = spark.range(1).select(F.explode(parts).alias("_p")).select(
        "_p.part", F.explode("_p.members").alias("member")
    )
    return (
        spine.join(counted, ["part", "member"], "full_outer")
        .select("part", "member", F.coalesce("_n", F.lit(0)).alias("records"))
    )
