"""Dated trip schedules from clock-only stop lists, and earlier-stop estimates.

Trip stops: one row per stop of one trip response, with the response's key columns,
`position`, `event_key`, `scheduled_clock`, `estimated_clock` and `cancelled`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lagline.functions.clock import (
    DAY, HALF_DAY, LOCAL_ZONE, clock_seconds, epoch_seconds, local_of, plus_seconds, plus_whole_seconds, seconds_of_day,
    utc_of_unambiguous, with_instant_near_schedule,
)
from lagline.operators.asof import age_at, asof_backward

TRIP_MAX_AGE_SECONDS = 240
PASSAGE_MAX_AGE_SECONDS = 600
UPSTREAM_METHODS = ["trend", "upstream", "blend", "combined"]
# Which rules each availability cohort compares.
COHORTS = {
    "revision": ["trend"],
    "upstream": ["upstream", "blend"],
    "both": ["trend", "upstream", "blend", "combined"],
}


def clock_offsets(stops: DataFrame, response: list[str]) -> DataFrame:
    """Seconds since the response's first midnight; the clock may fall back only by half
    a day or more. Adds `offset` and, per response, `_ordered` and `_span`."""
    in_order = W.partitionBy(*response).orderBy("position")
    whole = W.partitionBy(*response)
    clock = clock_seconds(F.col("scheduled_clock"))
    return (
        stops.withColumn("_clock", clock)
        .withColumn("_fall", F.lag("_clock").over(in_order) - F.col("_clock"))
        .withColumn("_day", F.sum(F.when(F.col("_fall") > 0, 1).otherwise(0)).over(in_order))
        .withColumn("offset", F.col("_clock") + F.col("_day") * DAY)
        .withColumn(
            "_ordered",
            F.count_if(F.col("_clock").isNull() | ((F.col("_fall") > 0) & (F.col("_fall") < HALF_DAY))).over(whole)
            == 0,
        )
        .withColumn("_span", F.max("offset").over(whole) - F.min("offset").over(whole))
        .drop("_clock", "_fall", "_day")
    )


def resolve_trip_schedule(stops: DataFrame, response: list[str], zone: str = LOCAL_ZONE) -> DataFrame:
    """Date every stop of a response from one dated target event.

    Needs `target_key` and `anchor_utc` on the rows. Adds `scheduled_utc`,
    `target_position` and `resolved`; a response resolves as a whole or not at all.
    A response is one captured payload, which bounds the windows used here.
    """
    whole = W.partitionBy(*response)
    is_target = F.col("event_key") == F.col("target_key")
    anchor = local_of(F.col("anchor_utc"), zone)
    placed = (
        clock_offsets(stops, response)
        .withColumn("_targets", F.count_if(is_target).over(whole))
        .withColumn("_target_offset", F.max(F.when(is_target, F.col("offset"))).over(whole))
        .withColumn("target_position", F.max(F.when(is_target, F.col("position"))).over(whole))
        .withColumn(
            "scheduled_utc",
            utc_of_unambiguous(plus_seconds(anchor, F.col("offset") - F.col("_target_offset")), zone),
        )
    )
    undated = F.count_if(F.col("scheduled_utc").isNull()).over(whole)
    resolved = (
        (F.col("_targets") == 1)
        & F.col("_ordered")
        & (F.col("_span") <= HALF_DAY)
        & (F.col("_target_offset") % DAY == seconds_of_day(anchor))
        & (undated == 0)
    )
    return (
        placed.withColumn("resolved", F.coalesce(resolved, F.lit(False)))
        .withColumn("scheduled_utc", F.when(F.col("resolved"), F.col("scheduled_utc")))
        .drop("_ordered", "_span", "_targets", "_target_offset")
    )


def upstream_from_stops(
    resolved: DataFrame,
    request: list[str],
    received: str = "received_at_utc",
    max_passage_age_seconds: float = PASSAGE_MAX_AGE_SECONDS,
    zone: str = LOCAL_ZONE,
) -> DataFrame:
    """Nearest earlier stop that the response itself estimates as just passed.

    One row per request key: `trip_reason`, or the stop's estimated delay as a proxy.
    """
    target_time = F.max(F.when(F.col("position") == F.col("target_position"), F.col("scheduled_utc"))).over(
        W.partitionBy(*request)
    )
    age = age_at(F.col(received), F.col("_estimated"))
    candidate = (
        (F.col("position") < F.col("target_position"))
        & ~F.coalesce(F.col("cancelled"), F.lit(False))
        & age.between(0, max_passage_age_seconds)
        & (F.col("scheduled_utc") < F.col("_target_time"))
    )
    fields = [
        "upstream_response_index", "upstream_event_key", "upstream_delay_seconds", "upstream_scheduled_utc",
        "upstream_estimated_utc", "upstream_passage_age_seconds",
    ]
    proxy = F.struct(
        F.col("position").alias("upstream_response_index"), F.col("event_key").alias("upstream_event_key"),
        (epoch_seconds(F.col("_estimated")) - epoch_seconds(F.col("scheduled_utc"))).alias("upstream_delay_seconds"),
        F.col("scheduled_utc").alias("upstream_scheduled_utc"), F.col("_estimated").alias("upstream_estimated_utc"),
        age.alias("upstream_passage_age_seconds"),
    )
    at_target = F.col("position") == F.col("target_position")
    summary = (
        with_instant_near_schedule(resolved, "_estimated", "estimated_clock", "scheduled_utc", zone)
        .withColumn("_target_time", target_time)
        .groupBy(*request)
        .agg(
            F.max("resolved").alias("_resolved"),
            F.max(F.when(at_target, F.coalesce(F.col("cancelled"), F.lit(False)))).alias("_target_cancelled"),
            F.max(F.when(candidate, proxy)).alias("_proxy"),
        )
    )
    reason = (
        F.when(~F.col("_resolved"), F.lit("trip_date_unresolved"))
        .when(F.col("_target_cancelled"), F.lit("trip_target_cancelled"))
        .when(F.col("_proxy").isNull(), F.lit("recent_earlier_stop_proxy_missing"))
    )
    usable = F.col("trip_reason").isNull()
    return summary.withColumn("trip_reason", reason).select(
        *request, "trip_reason", *[F.when(usable, F.col(f"_proxy.{f}")).alias(f) for f in fields]
    )


def trip_reason(max_age_seconds: float = TRIP_MAX_AGE_SECONDS) -> Column:
    """Checks of the trip response found at the cutoff, before its stops are looked at."""
    trip = F.col("trip")
    return (
        F.when(trip.isNull(), F.lit("trip_snapshot_missing"))
        .when(age_at(F.col("cutoff_utc"), trip["at"]) > max_age_seconds, F.lit("trip_snapshot_stale"))
        .when(
            ~trip["http_status"].eqNullSafe(F.lit(200)) | (F.coalesce(trip["error_kind"], F.lit("")) != ""),
            F.lit("trip_response_error"),
        )
        .when(~trip["payload_trip_key"].eqNullSafe(F.col("trip_key")), F.lit("trip_identity_mismatch"))
        .when(
            (F.coalesce(F.col("bus_key"), F.lit("")) == "") | ~trip["payload_bus_key"].eqNullSafe(F.col("bus_key")),
            F.lit("trip_bus_changed_or_missing"),
        )
    )


def latest_trip_snapshot(
    current: DataFrame, trips: DataFrame, max_age_seconds: float = TRIP_MAX_AGE_SECONDS, bucket_seconds: int = 3600
) -> DataFrame:
    """As-of across tables: last trip response of the same trip at the cutoff, with
    `trip` and `trip_reason`.

    `trips`: resource_id, snapshot_id, received_at_utc, http_status, error_kind,
    payload_trip_key, payload_bus_key. `current`: trip_key, cutoff_utc, bus_key.
    """
    named = trips.withColumnRenamed("resource_id", "trip_key")
    joined = asof_backward(
        current, named, ["trip_key"], "cutoff_utc", "received_at_utc", "snapshot_id",
        ["http_status", "error_kind", "payload_trip_key", "payload_bus_key"], bucket_seconds, name="trip",
    )
    return joined.withColumn("trip_reason", trip_reason(max_age_seconds))


UPSTREAM_FIELDS = [
    "upstream_response_index", "upstream_event_key", "upstream_stop_key", "upstream_delay_seconds",
    "upstream_scheduled_departure_utc", "upstream_estimated_departure_utc", "upstream_estimated_passage_age_seconds",
]
PROXY_KIND = "earlier_stop_api_estimate_proxy"  # fixed value


def last_passed(
    dated: DataFrame, response: list[str], max_passage_age_seconds: float = PASSAGE_MAX_AGE_SECONDS, zone: str = LOCAL_ZONE
) -> DataFrame:
    """Add `proxy` to every stop of a dated response: the last stop scheduled strictly before
    it that the response estimates as just passed when it was received.

    A running maximum along the schedule answers every stop of a response at once, so any
    number of requests for it only look their target up. Needs `offset` and `scheduled_utc`.
    """
    age = age_at(F.col("received_at_utc"), F.col("_estimated"))
    stop_key = F.col("stop_key").cast("string") if "stop_key" in dated.columns else F.lit(None).cast("string")
    values = [
        F.col("position"), F.col("event_key"), stop_key, epoch_seconds(F.col("_estimated")) - epoch_seconds(F.col("scheduled_utc")),
        F.col("scheduled_utc"), F.col("_estimated"), age,
    ]
    passed = F.when(
        ~F.coalesce(F.col("cancelled"), F.lit(False)) & age.between(0, max_passage_age_seconds),
        F.struct(*[v.alias(f) for v, f in zip(values, UPSTREAM_FIELDS)]),
    )
    before = W.partitionBy(*response).orderBy("offset").rangeBetween(W.unboundedPreceding, -1)
    estimated = with_instant_near_schedule(dated, "_estimated", "estimated_clock", "scheduled_utc", zone)
    return estimated.withColumn("_passed", passed).withColumn("proxy", F.max("_passed").over(before)).drop("_passed", "_estimated")


def with_upstream(
    current: DataFrame,
    trips: DataFrame,
    trip_stops: DataFrame,
    request: list[str],
    max_age_seconds: float = TRIP_MAX_AGE_SECONDS,
    max_passage_age_seconds: float = PASSAGE_MAX_AGE_SECONDS,
    zone: str = LOCAL_ZONE,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Full earlier-stop signal per as-of row: snapshot checks, dated stops, nearest proxy.

    `current` needs `request` (unique), trip_key, bus_key, cutoff_utc, target_key and
    anchor_utc, and may name its own `current_snapshot_id`; `trip_stops` has one row per stop
    with `snapshot_id`, and may have `stop_key`. A response is dated once per first midnight
    that its requests imply - one, unless schedules of different days share it - so the work
    follows the stops of the chosen responses, not stops times requests.
    """
    chosen = latest_trip_snapshot(current, trips, max_age_seconds, bucket_seconds)
    open_rows = chosen.where(F.col("trip_reason").isNull()).select(
        *request, "target_key", F.col("trip.tie").alias("snapshot_id"), F.col("trip.at").alias("received_at_utc"),
        local_of(F.col("anchor_utc"), zone).alias("_anchor"),
    )
    used = trip_stops.join(open_rows.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    placed = clock_offsets(used, ["snapshot_id"])
    targets = placed.groupBy("snapshot_id", F.col("event_key").alias("target_key")).agg(
        F.count(F.lit(1)).alias("_targets"), F.max("offset").alias("_target_offset"),
    )
    datable = (F.col("_targets") == 1) & (F.col("_target_offset") % DAY == seconds_of_day(F.col("_anchor")))
    asked = open_rows.join(targets, ["snapshot_id", "target_key"], "left").withColumn(
        "_midnight", F.when(datable, plus_whole_seconds(F.col("_anchor"), -F.col("_target_offset"))))
    response = ["snapshot_id", "_base"]
    bases = asked.where(F.col("_midnight").isNotNull()).select("snapshot_id", "received_at_utc", F.col("_midnight").alias("_base")).distinct()
    dated = bases.join(placed, "snapshot_id").withColumn(
        "scheduled_utc", utc_of_unambiguous(plus_whole_seconds(F.col("_base"), F.col("offset")), zone))
    undated = F.count_if(F.col("scheduled_utc").isNull()).over(W.partitionBy(*response))
    whole = F.col("_ordered") & (F.col("_span") <= HALF_DAY) & (undated == 0)
    facts = last_passed(dated.withColumn("_resolved", F.coalesce(whole, F.lit(False))), response, max_passage_age_seconds, zone).select(
        F.col("snapshot_id"), F.col("_base").alias("_midnight"), F.col("event_key").alias("target_key"), "_resolved",
        F.coalesce("cancelled", F.lit(False)).alias("_gone"), F.col("position").alias("_target_index"), "proxy",
    )
    told = asked.join(facts, ["snapshot_id", "_midnight", "target_key"], "left").select(*request, "_resolved", "_gone", "_target_index", "proxy")
    reason = (
        F.when(F.col("trip_reason").isNotNull(), F.col("trip_reason"))
        .when(~F.coalesce("_resolved", F.lit(False)), F.lit("trip_date_unresolved"))
        .when(F.col("_gone"), F.lit("trip_target_cancelled"))
        .when(F.col("proxy").isNull(), F.lit("recent_earlier_stop_proxy_missing"))
    )
    usable = lambda value: F.when(F.col("upstream_reason").isNull(), value)
    anchor = F.col("current_snapshot_id") if "current_snapshot_id" in current.columns else F.lit(None).cast("string")
    return (
        chosen.join(told, request, "left").withColumn("upstream_reason", reason)
        .withColumns({f: usable(F.col(f"proxy.{f}")) for f in UPSTREAM_FIELDS})
        .withColumns({
            "upstream_snapshot_id": usable(F.col("trip.tie")), "upstream_received_at_utc": usable(F.col("trip.at")),
            "upstream_bus_key": usable(F.col("bus_key")), "upstream_trip_key": usable(F.col("trip_key")),
            "target_response_index": usable(F.col("_target_index")), "date_anchor_snapshot_id": usable(anchor),
            "progress_measurement_kind": usable(F.lit(PROXY_KIND)),
        })
        .drop("trip_reason", "_resolved", "_gone", "_target_index", "proxy", "trip")
    )


def fixed_rules(features: DataFrame, max_adjustment: float = 120, max_horizon: float = 3) -> DataFrame:
    """The four fixed combinations of estimate, revision and earlier-stop proxy; a
    missing part leaves its rules null."""
    api, proxy = F.col("api_prediction_seconds"), F.col("upstream_delay_seconds")
    step = F.col("revision_seconds_per_minute") * F.least(F.col("horizon_minutes"), F.lit(max_horizon))
    clipped = F.when(step.isNotNull(), F.greatest(F.lit(-max_adjustment), F.least(F.lit(max_adjustment), step)))
    trend = api + clipped
    return features.withColumns(
        {
            "trend_prediction_seconds": trend,
            "upstream_prediction_seconds": proxy,
            "blend_prediction_seconds": (api + proxy) / 2,
            "combined_prediction_seconds": (trend + proxy) / 2,
        }
    )
