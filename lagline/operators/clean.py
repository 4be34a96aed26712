"""From raw departure rows to one row per recorded visit, with an audit of what was dropped.

Raw rows: id, route, stop, dest, scheduled (wall time), delay, service, lon, lat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lagline.functions.clock import day_type, expected_service_day, window_start_hour

CUTOFF = "2025-06-29"
MAX_VALID_DELAY = 7 * 24 * 3600
WINDOW_HOURS = 2

RAW_COLUMNS = ["id", "route", "stop", "dest", "scheduled", "delay", "service", "lon", "lat"]
CONTENT = ["route", "stop", "dest", "scheduled", "delay", "service"]
IDENTITY = ["route", "stop", "dest", "scheduled"]
GROUP = ["route", "stop", "dest", "daytype", "hour"]


def structurally_valid(max_delay: int = MAX_VALID_DELAY) -> Column:
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("id", "route", "stop", "dest")]
    bounded = F.coalesce(F.abs("delay") <= max_delay, F.lit(False))
    return bounded & filled[0] & filled[1] & filled[2] & filled[3]


def usable_rows(raw: DataFrame, cutoff: str = CUTOFF, max_delay: int = MAX_VALID_DELAY) -> DataFrame:
    """Distinct valid rows from the cutoff on; overlapping files collapse here."""
    after = F.col("scheduled") >= F.lit(cutoff).cast("timestamp_ntz")
    return raw.select(*RAW_COLUMNS).where(after & structurally_valid(max_delay)).distinct()


def source_ids(usable: DataFrame) -> DataFrame:
    """One row per source id: its content, whether copies disagree, and coordinate sums.

    Conflict is `min <> max` of the content, so this is one map-side combined
    aggregate. It also carries everything a consistent id contributes to its visit,
    which spares an anti join of all rows against the conflicting ids.
    """
    content = F.struct(*CONTENT)
    return (
        usable.groupBy("id")
        .agg(
            F.min(content).alias("content"), F.max(content).alias("_last"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~F.col("service").eqNullSafe(expected_service_day(F.col("scheduled")))).alias("off_calendar"),
            F.sum("lon").alias("lon_sum"), F.count("lon").alias("lon_n"),
            F.sum("lat").alias("lat_sum"), F.count("lat").alias("lat_n"),
        )
        .withColumn("is_conflict", ~F.col("content").eqNullSafe(F.col("_last")))
        .drop("_last")
    )


def conflicting_ids(usable: DataFrame) -> DataFrame:
    return source_ids(usable).where("is_conflict").select("id")


def visit_identities(ids: DataFrame) -> DataFrame:
    """Collapse rows that describe one visit; disagreeing delays mark it as a conflict."""
    kept = ids.where(~F.col("is_conflict")).select(
        "content.*", "rows", "lon_sum", "lon_n", "lat_sum", "lat_n"
    )
    return (
        kept.where(F.col("service") == expected_service_day(F.col("scheduled")))
        .groupBy(*IDENTITY)
        .agg(
            F.min("delay").alias("delay"), (F.min("delay") != F.max("delay")).alias("is_conflict"),
            (F.sum("lon_sum") / F.nullif(F.sum("lon_n"), F.lit(0))).alias("lon"),
            (F.sum("lat_sum") / F.nullif(F.sum("lat_n"), F.lit(0))).alias("lat"),
            F.sum("rows").alias("copies"),
        )
    )


def with_group(visits: DataFrame, moment: str = "scheduled", hours: int = WINDOW_HOURS) -> DataFrame:
    """Calendar day and timing-group columns taken from a wall time."""
    at = F.col(moment)
    return visits.withColumns(
        {"day": F.to_date(at), "daytype": day_type(at), "hour": window_start_hour(at, hours)}
    )


def visits_of(identities: DataFrame, hours: int = WINDOW_HOURS) -> DataFrame:
    kept = identities.where(~F.col("is_conflict")).select(*IDENTITY, "delay", "lon", "lat")
    return with_group(kept, hours=hours)


def clean_visits(
    raw: DataFrame, cutoff: str = CUTOFF, max_delay: int = MAX_VALID_DELAY, hours: int = WINDOW_HOURS
) -> DataFrame:
    return visits_of(visit_identities(source_ids(usable_rows(raw, cutoff, max_delay))), hours)


def clean_audit(raw: DataFrame, cutoff: str = CUTOFF, max_delay: int = MAX_VALID_DELAY) -> DataFrame:
    """Counts of every cleaning step as (metric, value) rows."""
    ids = source_ids(usable_rows(raw, cutoff, max_delay))
    identities = visit_identities(ids)
    scanned = raw.agg(
        F.count(F.lit(1)).alias("sourceRows"),
        F.count_if(F.col("scheduled") < F.lit(cutoff).cast("timestamp_ntz")).alias("beforeOverhaulRows"),
        F.count_if(F.col("scheduled").isNull() | ~structurally_valid(max_delay)).alias("invalidRows"),
    )
    by_id = ids.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("distinctSourceRows"),
        F.count_if("is_conflict").alias("conflictingSourceIds"),
        F.coalesce(F.sum("off_calendar"), F.lit(0)).alias("calendarMismatchRows"),
    )
    by_visit = identities.agg(
        F.count_if("is_conflict").alias("conflictingVisitIdentities"),
        F.coalesce(F.sum(F.when(~F.col("is_conflict"), F.col("copies") - 1)), F.lit(0)).alias(
            "collapsedConsistentCopies"
        ),
        F.count_if(~F.col("is_conflict")).alias("retainedRecordedVisits"),
    )
    parts = [as_metrics(part) for part in (scanned, by_id, by_visit)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def as_metrics(one_row: DataFrame) -> DataFrame:
    """Turn a one-row frame of counts into (metric, value) rows."""
    wide = one_row.select(*[F.col(c).cast("bigint").alias(c) for c in one_row.columns])
    return wide.unpivot([], wide.columns, "metric", "value")
