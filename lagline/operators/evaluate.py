"""Scoring captured forecasts and fixed rules against later measured departures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lagline.functions.clock import epoch_seconds, instant_of
from lagline.functions.once import with_columns_once
from lagline.operators.asof import (
    EVALUATION_HORIZONS, EVENT, MAX_AGE_SECONDS, REVISION_LAG_SECONDS, SIGNAL_HORIZONS, age_at,
    select_at_horizons, with_revision,
)
from lagline.operators.metrics import METRIC_COLUMNS, error_metrics
from lagline.operators.signals import (
    COHORTS, PASSAGE_MAX_AGE_SECONDS, TRIP_MAX_AGE_SECONDS, fixed_rules, with_upstream,
)


def _dated(observations: DataFrame) -> DataFrame:
    """The schedule of an event is what its raw text says, not a stored reading of it."""
    return with_columns_once(observations, {"scheduled_departure_utc": instant_of(F.col("scheduled_departure_raw"))})


def departed_by_cutoff() -> Column:
    """The measured departure had already happened when the forecast was due."""
    actual = epoch_seconds(F.col("scheduled_departure_utc")) + F.col("actual_delay_seconds")
    return actual <= epoch_seconds(F.col("cutoff_utc"))


def forecast_ledger(
    observations: DataFrame,
    links: DataFrame,
    horizons: list[float] = EVALUATION_HORIZONS,
    max_age_seconds: float = MAX_AGE_SECONDS,
) -> DataFrame:
    """Every event and horizon with its exclusion reason, or with a scored estimate.

    Reasons apply in this order: linkage status, as-of selection, already departed.
    """
    dated = _dated(observations)
    chosen = select_at_horizons(dated, horizons, max_age_seconds)
    joined = chosen.join(links, EVENT)
    exclusion = (
        F.when(F.col("status") != "matched", F.col("status"))
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(departed_by_cutoff(), F.lit("already_departed_at_cutoff"))
    )
    estimate, actual = F.col("current.estimated_delay_seconds"), F.col("actual_delay_seconds")
    kept = F.col("exclusion").isNull()
    return (
        joined.withColumn("exclusion", exclusion)
        .withColumns(
            {
                "snapshot_id": F.when(kept, F.col("current.snapshot_id")),
                "received_at_utc": F.when(kept, F.col("current.received_at_utc")),
                "actual_departure_utc": F.when(
                    kept, F.timestamp_seconds(epoch_seconds(F.col("scheduled_departure_utc")) + actual)
                ),
                "api_predicted_delay_seconds": F.when(kept, estimate),
                "api_absolute_error_seconds": F.when(kept, F.abs(estimate - actual)),
                "on_time_absolute_error_seconds": F.when(kept, F.abs(actual)),
                "snapshot_age_at_cutoff_seconds": F.when(
                    kept, age_at(F.col("cutoff_utc"), F.col("current.received_at_utc"))
                ),
                "flag_extreme_actual_delay": F.when(kept, F.abs(actual) > 3600),
            }
        )
        .drop("current", "reason")
    )


def horizon_scores(ledger: DataFrame) -> DataFrame:
    """API and on-time metrics on identical rows per horizon, with distinct trips and
    whether every estimate merely repeated the schedule."""
    kept = ledger.where(F.col("exclusion").isNull())
    long = kept.select(
        "horizon_minutes", "actual_delay_seconds", F.col("api_predicted_delay_seconds").alias("api"),
        F.lit(0.0).alias("on_time"),
    ).unpivot(["horizon_minutes", "actual_delay_seconds"], ["api", "on_time"], "method", "prediction")
    scores = error_metrics(long, ["horizon_minutes", "method"], "actual_delay_seconds", "prediction", continuous=True)
    trips = kept.select("horizon_minutes", "trip_key").distinct().groupBy("horizon_minutes").agg(
        F.count(F.lit(1)).alias("distinct_trips")
    )
    flat = kept.groupBy("horizon_minutes").agg(
        F.bool_and(F.col("api_predicted_delay_seconds") == 0).alias("all_predictions_equal_schedule")
    )
    return scores.join(trips, "horizon_minutes").join(flat, "horizon_minutes")


def exclusion_counts(ledger: DataFrame) -> DataFrame:
    return (
        ledger.where(F.col("exclusion").isNotNull()).groupBy("horizon_minutes", "exclusion")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def signal_features(
    observations: DataFrame,
    trips: DataFrame,
    trip_stops: DataFrame,
    horizons: list[float] = SIGNAL_HORIZONS,
    max_age_seconds: float = MAX_AGE_SECONDS,
    lag_seconds: float = REVISION_LAG_SECONDS,
    trip_max_age_seconds: float = TRIP_MAX_AGE_SECONDS,
    passage_max_age_seconds: float = PASSAGE_MAX_AGE_SECONDS,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Features of the fixed rules; no outcome is read here."""
    dated = _dated(observations).where(F.col("scheduled_departure_utc").isNotNull())
    selected = select_at_horizons(dated, horizons, max_age_seconds, lag_seconds).where(F.col("reason").isNull())
    revised = with_revision(selected, lag_seconds, max_age_seconds).withColumns(
        {
            "api_prediction_seconds": F.col("current.estimated_delay_seconds"),
            "current_snapshot_id": F.col("current.snapshot_id"),
            "bus_key": F.col("current.bus_key"),
            "target_key": F.col("scheduled_stop_key"),
            "anchor_utc": F.col("scheduled_departure_utc"),
        }
    ).drop("current", "earlier", "reason")
    request = [*EVENT, "horizon_minutes"]
    signalled = with_upstream(
        revised, trips, trip_stops, request, trip_max_age_seconds, passage_max_age_seconds, bucket_seconds=bucket_seconds
    )
    return fixed_rules(signalled)


def label_features(features: DataFrame, links: DataFrame) -> DataFrame:
    """Join features to the ledger; `label_exclusion` is null for rows that can be scored."""
    joined = features.join(links.select(*EVENT, "status", "outcome_row_id", "actual_delay_seconds"), EVENT)
    reason = F.when(F.col("status") != "matched", F.col("status")).when(
        departed_by_cutoff(), F.lit("already_departed_at_cutoff")
    )
    return joined.withColumn("label_exclusion", reason)


def cohort_scores(labelled: DataFrame) -> DataFrame:
    """Metrics by availability cohort, horizon and rule, the plain estimate and the
    schedule scored on the same rows; `better_than_api` compares inside the cohort."""
    scored = labelled.where(F.col("label_exclusion").isNull())
    available = {
        "revision": F.col("revision_reason").isNull(),
        "upstream": F.col("upstream_reason").isNull(),
        "both": F.col("revision_reason").isNull() & F.col("upstream_reason").isNull(),
    }
    entries = []
    for cohort, rules in COHORTS.items():
        for rule in ["api", "on_time", *rules]:
            value = F.lit(0.0) if rule == "on_time" else F.col(f"{rule}_prediction_seconds").cast("double")
            entry = F.struct(F.lit(cohort).alias("cohort"), F.lit(rule).alias("method"), value.alias("prediction"))
            entries.append(F.when(available[cohort], entry))
    long = scored.select(
        "horizon_minutes", "actual_delay_seconds", F.explode(F.array_compact(F.array(*entries))).alias("_e")
    ).select("horizon_minutes", "actual_delay_seconds", "_e.*")
    keys = ["cohort", "horizon_minutes", "method"]
    scores = error_metrics(long, keys, "actual_delay_seconds", "prediction", continuous=True)
    api = scores.where("method = 'api'").select(
        "cohort", "horizon_minutes", F.col("mae_seconds").alias("_api")
    )
    return scores.join(api, ["cohort", "horizon_minutes"]).select(
        *keys, *METRIC_COLUMNS, (F.col("mae_seconds") < F.col("_api")).alias("better_than_api")
    )
