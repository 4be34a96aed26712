"""Exact, ambiguity-refusing linkage of live events to later measured departures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lagline.functions.clock import instant_of
from lagline.functions.once import with_columns_once
from lagline.functions.skew import HOT_ROWS, attach_by_key
from lagline.functions.text import destination_match_key
from lagline.operators.asof import EVENT

MATCH = ["match_route", "match_stop", "match_destination", "match_instant"]


def _identity(rows: DataFrame, route: str, stop: str, destination: str, time: str, unicode_aware: bool) -> DataFrame:
    """Match key columns, all null where any part is missing or the time is refused."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    valid = F.col("_instant").isNotNull() & filled(stop) & filled(destination)
    parts = {
        "match_route": F.coalesce(F.col(route).cast("string"), F.lit("None")),
        "match_stop": F.col(stop).cast("string"),
        "match_destination": F.col("_name"),
        "match_instant": F.col("_instant"),
    }
    name = destination_match_key(F.col(destination), unicode_aware)
    return (
        with_columns_once(rows.withColumn("_name", name), {"_instant": instant_of(F.col(time))})
        .withColumns({name: F.when(valid, part) for name, part in parts.items()})
        .drop("_instant", "_name")
    )


def live_events(observations: DataFrame, unicode_aware: bool = True) -> DataFrame:
    """One row per event; its identity comes from its first row in receipt order."""
    details = F.struct("route_number", "stop_number", "variant_name")
    order = F.struct("received_at_utc", "snapshot_id")
    first = observations.groupBy(*EVENT).agg(
        F.count(F.lit(1)).alias("snapshots"), F.min_by(details, order).alias("_first")
    ).select(*EVENT, "snapshots", "_first.*")
    return _identity(first, "route_number", "stop_number", "variant_name", "scheduled_departure_raw", unicode_aware)


def identified_outcomes(outcomes: DataFrame, unicode_aware: bool = True) -> DataFrame:
    """Measured departures with their match key; all its columns are null where a part is missing or refused."""
    return _identity(outcomes, "route_number", "stop_number", "route_destination", "scheduled_time", unicode_aware)


def outcome_keys(outcomes: DataFrame, unicode_aware: bool = True) -> DataFrame:
    """One row per match key: how many outcomes share it, and the outcome when only one does."""
    keyed = identified_outcomes(outcomes, unicode_aware).where(F.col("match_instant").isNotNull())
    outcome = F.struct("row_id", F.col("deviation").cast("double").alias("deviation"))
    return keyed.groupBy(*MATCH).agg(
        F.count(F.lit(1)).alias("outcomes"), F.min(outcome).alias("outcome")
    )


def link_outcomes(
    observations: DataFrame, outcomes: DataFrame, unicode_aware: bool = True, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Event ledger: status of every live event and its outcome where exactly one fits."""
    events = live_events(observations, unicode_aware)
    shared = events.groupBy(*MATCH).agg(F.count(F.lit(1)).alias("live_events"))
    facts = (
        shared.join(outcome_keys(outcomes, unicode_aware), MATCH, "left")
        .withColumn("_weight", F.col("live_events"))
    )
    linked = attach_by_key(events, facts, MATCH, "_weight", hot_rows)
    outcomes_n = F.coalesce("outcomes", F.lit(0))
    status = (
        F.when(F.col("match_instant").isNull(), F.lit("invalid_live_identity"))
        .when(F.col("live_events") > 1, F.lit("multiple_live_events_same_match_key"))
        .when(outcomes_n == 0, F.lit("no_exact_outcome"))
        .when(outcomes_n > 1, F.lit("multiple_outcomes"))
        .otherwise(F.lit("matched"))
    )
    matched = F.col("status") == "matched"
    return linked.withColumn("status", status).select(
        *EVENT, "snapshots", "stop_number", "variant_name", "status",
        F.when(matched, F.col("outcome.row_id")).alias("outcome_row_id"),
        F.when(matched, -F.col("outcome.deviation")).alias("actual_delay_seconds"),
        F.when(matched, F.col("match_instant")).alias("measured_schedule_utc"),
    )
