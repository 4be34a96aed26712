"""What was known at a fixed time before schedule: as-of selection without pair joins.

Observations: one row per captured estimate, carrying the key and schedule of its own
event, `received_at_utc`, `snapshot_id` and the estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lagline.functions.clock import epoch_seconds, instant_of
from lagline.functions.once import with_columns_once

EVENT = ["trip_key", "scheduled_stop_key", "scheduled_departure_raw"]
MAX_AGE_SECONDS = 90
REVISION_LAG_SECONDS = 180
EVALUATION_HORIZONS = [5, 10, 20]
SIGNAL_HORIZONS = [1, 2, 5, 10, 20]


def known_at_horizons(
    observations: DataFrame,
    horizons: list[float],
    scheduled: str = "scheduled_departure_utc",
    keys: list[str] = EVENT,
    payload: list[str] = (),
    lag_seconds: float | None = None,
) -> DataFrame:
    """One row per event and horizon with `current`, the last observation received by the
    cutoff, and with `lag_seconds` also `earlier`, the last one received that much before.

    All horizons are conditional maxima of one aggregate. An event's observations are
    combined map-side, never paired with cutoffs, and never held together.
    """
    row = F.struct("received_at_utc", "snapshot_id", *payload)
    age_limit = epoch_seconds(F.col(scheduled)) - epoch_seconds(F.col("received_at_utc"))
    picks = []
    for i, minutes in enumerate(horizons):
        picks.append(F.max(F.when(age_limit >= minutes * 60, row)).alias(f"_c{i}"))
        if lag_seconds is not None:
            picks.append(F.max(F.when(age_limit >= minutes * 60 + lag_seconds, row)).alias(f"_e{i}"))
    by_event = observations.groupBy(*keys).agg(F.min(scheduled).alias(scheduled), *picks)
    entries = []
    for i, minutes in enumerate(horizons):
        fields = [F.lit(minutes).alias("horizon_minutes"), F.col(f"_c{i}").alias("current")]
        if lag_seconds is not None:
            fields.append(F.col(f"_e{i}").alias("earlier"))
        entries.append(F.struct(*fields))
    spread = by_event.select(*keys, scheduled, F.explode(F.array(*entries)).alias("_h")).select(
        *keys, scheduled, "_h.*"
    )
    return spread.withColumn(
        "cutoff_utc", F.timestamp_seconds(epoch_seconds(F.col(scheduled)) - F.col("horizon_minutes") * 60)
    )


def age_at(cutoff: Column, received: Column) -> Column:
    return epoch_seconds(cutoff) - epoch_seconds(received)


def selection_reason(max_age_seconds: float = MAX_AGE_SECONDS) -> Column:
    """Why the last observation cannot be used; it is judged after being chosen, so an
    older valid one never replaces it."""
    current = F.col("current")
    return (
        F.when(current.isNull(), F.lit("no_snapshot_before_cutoff"))
        .when(age_at(F.col("cutoff_utc"), current["received_at_utc"]) > max_age_seconds, F.lit("snapshot_stale"))
        .when(current["cancelled"], F.lit("cancelled_at_cutoff"))
        .when(
            current["estimated_departure_utc"].isNull() | current["estimated_delay_seconds"].isNull(),
            F.lit("estimate_missing"),
        )
    )


DEPARTURE_PAYLOAD = ["cancelled", "estimated_departure_utc", "estimated_delay_seconds", "bus_key"]


def select_at_horizons(
    observations: DataFrame,
    horizons: list[float] = EVALUATION_HORIZONS,
    max_age_seconds: float = MAX_AGE_SECONDS,
    lag_seconds: float | None = None,
    keys: list[str] = EVENT,
) -> DataFrame:
    """As-of departure estimates with `reason` (null when usable)."""
    chosen = known_at_horizons(
        observations, horizons, keys=keys, payload=DEPARTURE_PAYLOAD, lag_seconds=lag_seconds
    )
    return chosen.withColumn("reason", selection_reason(max_age_seconds))


def with_revision(
    selected: DataFrame, lag_seconds: float = REVISION_LAG_SECONDS, max_age_seconds: float = MAX_AGE_SECONDS
) -> DataFrame:
    """Add the change of the estimate since the earlier as-of row, or why there is none."""
    current, earlier = F.col("current"), F.col("earlier")
    elapsed = age_at(current["received_at_utc"], earlier["received_at_utc"])
    change = current["estimated_delay_seconds"] - earlier["estimated_delay_seconds"]
    earlier_age = age_at(F.col("cutoff_utc"), earlier["received_at_utc"]) - lag_seconds
    reason = (
        F.when(earlier.isNull(), F.lit("revision_history_missing"))
        .when(earlier_age > max_age_seconds, F.lit("revision_history_stale"))
        .when(
            F.coalesce(earlier["cancelled"], F.lit(False)) | earlier["estimated_delay_seconds"].isNull(),
            F.lit("revision_history_unavailable"),
        )
        .when(
            (F.coalesce(current["bus_key"], F.lit("")) == "") | ~earlier["bus_key"].eqNullSafe(current["bus_key"]),
            F.lit("revision_bus_changed_or_missing"),
        )
        .when(elapsed <= 0, F.lit("revision_invalid_order"))
    )
    usable = F.col("revision_reason").isNull()
    return selected.withColumn("revision_reason", reason).withColumns(
        {
            "revision_seconds": F.when(usable, change),
            "revision_interval_seconds": F.when(usable, elapsed),
            "revision_seconds_per_minute": F.when(usable, change / elapsed * 60),
            "history_snapshot_id": F.when(usable, earlier["snapshot_id"]),
            "history_received_at_utc": F.when(usable, earlier["received_at_utc"]),
        }
    )


def select_arrivals(
    observations: DataFrame, horizons: list[float] = SIGNAL_HORIZONS, max_age_seconds: float = MAX_AGE_SECONDS
) -> DataFrame:
    """As-of arrival estimates keyed by the dated scheduled arrival."""
    due = {"scheduled_arrival_utc": instant_of(F.col("scheduled_arrival_raw"))}
    dated = with_columns_once(observations, due).where(F.col("scheduled_arrival_utc").isNotNull())
    chosen = known_at_horizons(
        dated, horizons, scheduled="scheduled_arrival_utc",
        keys=["trip_key", "scheduled_stop_key", "scheduled_arrival_raw"],
        payload=["cancelled", "estimated_arrival_raw", "bus_key", "stop_number", "variant_name"],
    )
    current = F.col("current")
    estimate = F.col("_estimate")
    reason = (
        F.when(current.isNull(), F.lit("no_snapshot_before_cutoff"))
        .when(age_at(F.col("cutoff_utc"), current["received_at_utc"]) > max_age_seconds, F.lit("snapshot_stale"))
        .when(current["cancelled"], F.lit("cancelled"))
        .when(F.col("_estimate").isNull(), F.lit("arrival_estimate_missing_or_ambiguous"))
    )
    usable = F.col("reason").isNull()
    read = with_columns_once(chosen, {"_estimate": instant_of(current["estimated_arrival_raw"])})
    return read.withColumn("reason", reason).withColumns(
        {
            "arrival_prediction_utc": F.when(usable, estimate),
            "arrival_predicted_delay_seconds": F.when(
                usable, epoch_seconds(estimate) - epoch_seconds(F.col("scheduled_arrival_utc"))
            ),
        }
    ).drop("_estimate")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    tie: str,
    payload: list[str],
    bucket_seconds: int = 3600,
    name: str = "found",
) -> DataFrame:
    """Attach to each left row the latest right row of the same key at or before its time.

    Both sides meet in one ordered union per (key, time bucket), so the cost is a sort
    and not key-wise pairs, and a key that owns much of the data still splits by time.
    The last right row of each bucket is carried to the key's next buckets through a
    table with one row per key and bucket. Null keys or times find nothing and stay out of
    the sort, where they would all meet.
    """
    usable = F.lit(True)
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    can_match = usable & F.col(left_time).isNotNull()
    unmatched, left = left.where(~can_match), left.where(can_match)
    right = right.where(usable)
    bucket = lambda moment: F.floor(epoch_seconds(F.col(moment)) / bucket_seconds)
    found = F.struct(F.col(right_time).alias("at"), F.col(tie).alias("tie"), *payload)
    keyed = lambda frame, moment: frame.withColumn("_bucket", bucket(moment))
    offered = (
        keyed(right.where(F.col(right_time).isNotNull()), right_time)
        .groupBy(*keys, "_bucket", F.col(right_time).alias("_at"))
        .agg(F.max(found).alias("_found"))
    )
    asked = keyed(left, left_time).select(
        *keys, "_bucket", F.col(left_time).alias("_at"), F.struct(*left.columns).alias("_left")
    )
    # One row per key and bucket on either side.
    latest = offered.groupBy(*keys, "_bucket").agg(F.max("_found").alias("_last"))
    in_use = asked.groupBy(*keys, "_bucket").agg(F.lit(True).alias("_asked"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        latest.join(in_use, [*keys, "_bucket"], "full_outer")
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier))
        .where(F.col("_asked") & F.col("_carry").isNotNull())
        .select(*keys, "_bucket", F.col("_carry").alias("_found"))
        .withColumn("_at", F.col("_found.at"))
    )
    empty_left = F.lit(None).cast(asked.schema["_left"].dataType)
    empty_found = F.lit(None).cast(offered.schema["_found"].dataType)
    columns = [*keys, "_bucket", "_at", "_side", "_left", "_found"]
    stacked = (
        carried.withColumn("_left", empty_left).withColumn("_side", F.lit(0)).select(*columns)
        .unionByName(offered.withColumn("_left", empty_left).withColumn("_side", F.lit(0)).select(*columns))
        .unionByName(asked.withColumn("_found", empty_found).withColumn("_side", F.lit(1)).select(*columns))
    )
    running = (
        W.partitionBy(*keys, "_bucket").orderBy("_at", "_side")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    answered = (
        stacked.withColumn(name, F.last("_found", ignorenulls=True).over(running)).where("_side = 1").select("_left.*", name)
    )
    return answered.unionByName(unmatched.withColumn(name, empty_found))
