"""Audits of captured responses: reconciliation, coverage, polling and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lagline.functions.clock import LOCAL_ZONE, epoch_seconds, instant_of, local_of
from lagline.functions.once import with_columns_once
from lagline.functions.quantiles import exact_quantiles
from lagline.operators.asof import SIGNAL_HORIZONS, select_arrivals
from lagline.operators.clean import as_metrics
from lagline.operators.normalize import judged_payloads, numbered_observations
from lagline.staging import staged

ESTIMATE_GROUP = ["resource_type", "trip_key", "scheduled_stop_key", "scheduled_departure_raw"]


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def capture_counts(snapshots: DataFrame, observations: DataFrame) -> DataFrame:
    """Scalar capture counts as (metric, value) rows."""
    lead, delay = F.col("scheduled_lead_seconds"), F.col("estimated_delay_seconds")
    dated_stop = (F.col("resource_type") == "stop") & delay.isNotNull()
    parts = [
        snapshots.agg(
            F.count(F.lit(1)).alias("responses"),
            F.count_if(F.coalesce("attempt_number", F.lit(1)) > 1).alias("retry_attempts"),
        ),
        observations.agg(
            F.count(F.lit(1)).alias("observations"),
            F.count_if(F.col("bus_key").isNull()).alias("missing_bus_observations"),
            F.count_if(F.col("cancelled")).alias("cancelled_observations"),
            F.count_if(dated_stop).alias("dated_stop_estimates"),
            F.count_if(dated_stop & (lead > 0)).alias("dated_stop_estimates_before_departure"),
            F.count_if(F.col("time_issues")["scheduled"] == "date_missing").alias("clock_only_scheduled_times"),
        ),
    ]
    # One aggregate per distinct count; sharing one would copy every observation.
    for name, column in [("distinct_trips", "trip_key"), ("distinct_buses", "bus_key"), ("distinct_stops", "stop_key")]:
        parts.append(observations.where(_given(column)).select(column).distinct().agg(F.count(F.lit(1)).alias(name)))
    result = as_metrics(parts[0])
    for part in parts[1:]:
        result = result.unionByName(as_metrics(part))
    return result


def capture_histograms(snapshots: DataFrame, observations: DataFrame) -> DataFrame:
    """(part, member, records): statuses, errors, origins, resources and time issues."""
    def tally(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
        joint = rows.select(*[c.cast("string").alias(n) for n, c in parts.items()]).groupBy(*parts).agg(
            F.count(F.lit(1)).alias("_n")
        )
        tags = F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).alias("member")) for n in parts])
        return (
            joint.select("_n", F.explode(tags).alias("_t")).where(F.col("_t.member").isNotNull())
            .groupBy("_t.part", "_t.member").agg(F.sum("_n").alias("records"))
        )

    issues = (
        observations.select(F.explode(F.map_entries("time_issues")).alias("_i"))
        .groupBy(F.lit("time_issue").alias("part"), F.concat_ws(":", "_i.key", "_i.value").alias("member"))
        .agg(F.count(F.lit(1)).alias("records"))
    )
    of_snapshots = tally(
        snapshots,
        {
            "http_status": F.coalesce(F.col("http_status").cast("string"), F.lit("None")),
            "error": F.nullif(F.col("error_kind"), F.lit("")), "origin": F.col("origin"),
        },
    )
    return of_snapshots.unionByName(tally(observations, {"resource": F.col("resource_type")})).unionByName(issues)


def estimate_groups(observations: DataFrame) -> DataFrame:
    """Repeatedly captured events and whether their estimate ever changed.

    More than one distinct value means minimum and maximum differ: no distinct count.
    """
    raw = F.col("estimated_departure_raw")
    order = F.struct("received_at_utc", "snapshot_id", "row_number")
    return (
        observations.where(_given("trip_key") & _given("scheduled_stop_key"))
        .groupBy(*ESTIMATE_GROUP)
        .agg(
            F.count(F.lit(1)).alias("snapshots"),
            F.coalesce(F.min(raw) != F.max(raw), F.lit(False)).alias("changed"),
            F.min_by(raw, order).alias("first_estimated_departure_raw"),
            F.max_by(raw, order).alias("last_estimated_departure_raw"),
        )
        .where("snapshots > 1")
    )


def revised_estimate_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy("resource_type").agg(
        F.count(F.lit(1)).alias("repeated_groups"), F.count_if("changed").alias("changed_groups")
    )


def revised_examples(groups: DataFrame, limit: int = 5) -> DataFrame:
    """The report's short list of revised stop estimates."""
    keys = ESTIMATE_GROUP[1:]
    return (
        groups.where((F.col("resource_type") == "stop") & F.col("changed")).orderBy(*keys).limit(limit)
        .select(*keys, "first_estimated_departure_raw", "last_estimated_departure_raw", "snapshots")
    )


def poll_gaps(requests: DataFrame, stop: str = "stop", at: str = "requested_at", block_seconds: int = 86400) -> DataFrame:
    """Per stop: polls, median and longest gap between consecutive requests in seconds.

    Gaps are taken inside time blocks; a table with one row per stop and block bridges
    them. Requests are read and sorted once. The median comes from `exact_quantiles`, as
    gaps never repeat.
    """
    rows = requests.select(F.col(stop).alias("stop"), epoch_seconds(F.col(at)).alias("_t")).withColumn(
        "_b", F.floor(F.col("_t") / block_seconds)
    )
    previous = F.lag("_t").over(W.partitionBy("stop", "_b").orderBy("_t"))
    stepped = staged(rows.withColumn("gap", F.col("_t") - previous), "gaps")
    blocks = staged(stepped.groupBy("stop", "_b").agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count(F.lit(1)).alias("_n"), F.max("gap").alias("_longest")
    ), "blocks")
    before = F.lag("_last").over(W.partitionBy("stop").orderBy("_b"))
    bridged = blocks.withColumn("gap", F.col("_first") - before)
    facts = bridged.groupBy("stop").agg(F.sum("_n").alias("polls"), F.greatest(F.max("gap"), F.max("_longest")).alias("max_gap_seconds"))
    median = exact_quantiles(stepped.select("stop", "gap").unionByName(bridged.select("stop", "gap")), ["stop"], "gap", {"median_gap_seconds": 0.5})
    named = median.withColumnRenamed("stop", "_stop")
    return (
        facts.join(named, F.col("stop").eqNullSafe(F.col("_stop")), "left")
        .select("stop", "polls", F.round("median_gap_seconds", 3).alias("median_gap_seconds"),
                F.round("max_gap_seconds", 3).alias("max_gap_seconds"))
    )


def capture_status(snapshots: DataFrame) -> DataFrame:
    """Responses, errors, usable responses and last receipt per origin."""
    failed = F.coalesce("error_kind", F.lit("")) != ""
    return snapshots.groupBy("origin").agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if(failed).alias("errors"),
        F.count_if((F.col("http_status") == 200) & ~failed).alias("usable_responses"),
        F.max("received_at_utc").alias("last_received_at_utc"),
    )


def cycle_totals(snapshots: DataFrame) -> DataFrame:
    """Request, success, observation and error totals per polling cycle."""
    failed = F.coalesce("error_kind", F.lit("")) != ""
    totals = snapshots.groupBy("cycle_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if((F.col("http_status") == 200) & ~failed).alias("successful_responses"),
        F.sum("observation_count").alias("observations"), F.count_if(failed).alias("errors"),
    )
    return totals.withColumn(
        "status", F.when(F.col("errors") == 0, F.lit("complete")).otherwise(F.lit("completed_with_errors"))
    )


def orphan_observations(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    return observations.join(snapshots.select("snapshot_id"), "snapshot_id", "left_anti")


def identity_overlap(observations: DataFrame) -> DataFrame:
    """Trip-response identities and how many of them a dated stop response also names."""
    events = (
        observations.groupBy("trip_key", "scheduled_stop_key").agg(
            F.max(F.col("resource_type") == "trip").alias("in_trip"),
            F.max((F.col("resource_type") == "stop") & F.col("scheduled_departure_utc").isNotNull()).alias("dated"),
        )
    )
    both = F.col("in_trip") & F.col("dated")
    trips = events.groupBy("trip_key").agg(
        F.max("in_trip").alias("in_trip"), F.max(both).alias("both"), F.count_if(both).alias("_events")
    )
    return as_metrics(
        trips.agg(
            F.count_if("in_trip").alias("trip_endpoint_distinct_trips"),
            F.count_if("both").alias("trips_with_dated_event_match"),
            F.sum("_events").alias("exact_event_matches"),
        )
    )


COMPARED = [
    "scheduled_stop_key", "trip_key", "bus_key", "stop_key", "stop_number", "route_key", "route_number",
    "variant_key", "destination", "variant_name", "schedule_type", "cancelled", "scheduled_departure_raw",
    "estimated_departure_raw", "scheduled_departure_utc", "estimated_departure_utc",
    "estimated_delay_seconds", "scheduled_lead_seconds",
]


def reconcile_payloads(snapshots: DataFrame, observations: DataFrame, requested_route: str) -> DataFrame:
    """Mismatch counts between stored rows, stored digests and a fresh normalisation."""
    stored_counts = observations.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("_rows"))
    counted = snapshots.join(stored_counts, "snapshot_id", "left").agg(
        F.count_if(F.coalesce("_rows", F.lit(0)) != F.col("observation_count")).alias("snapshot_row_count"),
        F.count_if(~F.col("payload_sha256").eqNullSafe(F.sha2("payload_json", 256))).alias("payload_hash"),
    )
    usable = (F.col("http_status") == 200) & (F.coalesce("error_kind", F.lit("")) == "")
    # Stored once, so that each payload is parsed once for the three uses below.
    judged = staged(
        judged_payloads(snapshots.where(usable), requested_route).select(
            "snapshot_id", "resource_type", "resource_id", "received_at_utc", "error_kind", "trip_header",
            "shared_stop", "blocks",
        )
    )
    failures = judged.agg(F.count_if(F.col("error_kind") == "schema_error").alias("reparse_failure"))
    readable = judged.where(F.coalesce("error_kind", F.lit("")) == "").select("snapshot_id")
    content = F.sha2(F.to_json(F.struct(*COMPARED)), 256).alias("_content")
    keys = ["snapshot_id", "row_number"]
    fresh = numbered_observations(judged, requested_route).select(*keys, content)
    saved = observations.join(readable, "snapshot_id", "left_semi").select(*keys, content.alias("_saved"))
    differing = (
        fresh.join(saved, keys, "full_outer")
        .where(~F.col("_content").eqNullSafe(F.col("_saved")))
        .select("snapshot_id").distinct()
        .agg(F.count(F.lit(1)).alias("normalized_payload"))
    )
    return as_metrics(counted).unionByName(as_metrics(failures)).unionByName(as_metrics(differing))


def arrival_days(observations: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Arrival-estimate coverage per local day of the scheduled arrival."""
    arrival, departure = F.col("_arrival"), F.col("_departure")
    read = {
        "scheduled_arrival_utc": instant_of(F.col("scheduled_arrival_raw"), zone),
        "_arrival": instant_of(F.col("estimated_arrival_raw"), zone),
        "_departure": instant_of(F.col("estimated_departure_raw"), zone),
    }
    dated = (
        with_columns_once(observations, read)
        .where(F.col("scheduled_arrival_utc").isNotNull())
        .withColumn("day", F.to_date(local_of(F.col("scheduled_arrival_utc"), zone)))
        .withColumn("_dwell", epoch_seconds(departure) - epoch_seconds(arrival))
    )
    stats = dated.groupBy("day").agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.count_if(F.col("_arrival").isNull()).alias("unusable_arrival_estimates"),
        F.count("_dwell").alias("comparable_snapshots"),
        F.count_if(F.col("_dwell") != 0).alias("arrival_and_departure_differ"),
        F.count_if(F.col("_dwell") < 0).alias("negative_dwell_snapshots"),
        F.max("_dwell").alias("max_dwell_seconds"),
    )
    distinct = lambda name, *columns: (
        dated.select("day", *columns).distinct().groupBy("day").agg(F.count(F.lit(1)).alias(name))
    )
    return (
        stats.join(distinct("events", "trip_key", "scheduled_stop_key", "scheduled_arrival_raw"), "day")
        .join(distinct("trips", "trip_key"), "day").join(distinct("stops", "stop_number"), "day")
    )


def arrival_horizon_counts(observations: DataFrame, horizons: list[float] = SIGNAL_HORIZONS, zone: str = LOCAL_ZONE, max_age_seconds: float = 90) -> DataFrame:
    """Per local day, horizon and outcome: events with a usable arrival forecast, or why not."""
    chosen = select_arrivals(observations, horizons, max_age_seconds)
    return (
        chosen.withColumn("day", F.to_date(local_of(F.col("scheduled_arrival_utc"), zone)))
        .withColumn("outcome", F.coalesce("reason", F.lit("forecast_candidate")))
        .groupBy("day", "horizon_minutes", "outcome").agg(F.count(F.lit(1)).alias("events"))
    )
