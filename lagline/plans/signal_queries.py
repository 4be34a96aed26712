"""The composed signal path: estimates, revisions and earlier stops against measured departures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline.operators import evaluate
from lagline.operators.asof import EVENT
from lagline.plans.adapter import (
    linked_observations, linked_response_stops, linked_responses, observations, oracle, rounded, trip_snapshots, view,
)
from lagline.plans.forecast_queries import MEASURES
from lagline.plans.live_queries import EVENT_SQL, HORIZONS, LAG, LINK_CTE, MAX_AGE, MEASURED, TRIP_CTE, _cohort_sql, _links, _ntz, _observations
from lagline.plans.registry import query
from lagline.staging import staged

TRIP_MAX_AGE = 43200
PASSAGE_MAX_AGE = 14400

LINKED_OBS = f"""SELECT o.* REPLACE (l.trip_key AS trip_key, l.scheduled_stop_key AS scheduled_stop_key)
FROM ({oracle(observations)}) o JOIN ({oracle(linked_observations)}) l USING (snapshot_id)"""
REQUEST_SQL = f"{EVENT_SQL}, horizon_minutes"
# All times lie in January, six hours behind UTC.
SIGNAL_CTE = f"""{TRIP_CTE.replace(oracle(trip_snapshots), oracle(linked_responses)).replace(oracle(observations), LINKED_OBS)},
stops AS ({oracle(linked_response_stops)}),
pairs AS (
  SELECT j.*, s.position, s.event_key, s.stop_key, s.cancelled AS gone, s.event_key = j.scheduled_stop_key AS hit,
         split_part(s.scheduled_clock, ':', 1)::bigint * 3600 + split_part(s.scheduled_clock, ':', 2)::bigint * 60
           + split_part(s.scheduled_clock, ':', 3)::bigint AS v,
         split_part(s.estimated_clock, ':', 1)::bigint * 3600 + split_part(s.estimated_clock, ':', 2)::bigint * 60
           + split_part(s.estimated_clock, ':', 3)::bigint AS ev
  FROM judged j JOIN stops s ON s.snapshot_id = j.trip_snapshot_id WHERE j.trip_reason IS NULL),
falls AS (SELECT *, lag(v) OVER (PARTITION BY {REQUEST_SQL} ORDER BY position) - v AS fall FROM pairs),
shifted AS (
  SELECT *, v + 86400 * sum((coalesce(fall, 0) > 0)::int) OVER (PARTITION BY {REQUEST_SQL} ORDER BY position) AS shift FROM falls),
facts AS (
  SELECT {REQUEST_SQL}, count(*) FILTER (WHERE hit) = 1 AND count(*) FILTER (WHERE fall > 0 AND fall < 43200) = 0
           AND max(shift) - min(shift) <= 43200
           AND max(shift) FILTER (WHERE hit) % 86400 = (epoch(any_value(scheduled_departure_utc))::bigint - 21600) % 86400 AS ok,
         max(shift) FILTER (WHERE hit) AS at_target, max(position) FILTER (WHERE hit) AS target_index, bool_or(gone) FILTER (WHERE hit) AS target_gone
  FROM shifted GROUP BY ALL),
dated AS (
  SELECT s.*, f.ok, f.at_target, f.target_index, f.target_gone, epoch(s.scheduled_departure_utc)::bigint + s.shift - f.at_target AS sched
  FROM shifted s JOIN facts f USING ({REQUEST_SQL})),
near AS (
  SELECT *, 21600 + list_filter([(sched - 21600) // 86400 * 86400 + d * 86400 + ev FOR d IN [-1, 0, 1]],
                                lambda x: abs(x + 21600 - sched) <= 3600)[1] AS est FROM dated),
proxies AS (
  SELECT {REQUEST_SQL}, max((position, event_key, stop_key, est - sched, sched, est, epoch(trip_at) - est)) AS p FROM near
  WHERE ok AND position < target_index AND shift < at_target AND NOT gone AND epoch(trip_at) - est BETWEEN 0 AND {PASSAGE_MAX_AGE} GROUP BY ALL),
found AS (
  SELECT j.* EXCLUDE (trip_reason), f.target_index, p.p, CASE WHEN j.trip_reason IS NOT NULL THEN j.trip_reason
           WHEN NOT coalesce(f.ok, false) THEN 'trip_date_unresolved' WHEN f.target_gone THEN 'trip_target_cancelled'
           WHEN p.p IS NULL THEN 'recent_earlier_stop_proxy_missing' END AS trip_reason
  FROM judged j LEFT JOIN facts f USING ({REQUEST_SQL}) LEFT JOIN proxies p USING ({REQUEST_SQL})),
parts AS (
  SELECT *, estimated_delay_seconds AS api, CASE WHEN trip_reason IS NULL THEN p[4]::double END AS proxy,
         CASE WHEN revision_reason IS NULL THEN (estimated_delay_seconds - old_delay) / (epoch(received_at_utc) - epoch(old_at)) * 60 END AS rate FROM found),
rules AS (
  SELECT *, CASE WHEN rate IS NOT NULL THEN api + greatest(-120, least(120, rate * least(horizon_minutes, 3))) END AS trend FROM parts),
combined AS (SELECT *, (api + proxy) / 2 AS blend, (trend + proxy) / 2 AS combined FROM rules)
"""
RULES = ("api", "trend", "upstream", "blend", "combined")


def _features(spark, sf_dir):
    keys = view(spark, sf_dir, linked_observations, parse_heavy=True).select("snapshot_id", "trip_key", "scheduled_stop_key")
    observed = _observations(spark, sf_dir).drop("trip_key", "scheduled_stop_key").join(keys, "snapshot_id")
    responses = view(spark, sf_dir, linked_responses).withColumnRenamed("trip_key", "resource_id")
    return evaluate.signal_features(
        observed, responses, view(spark, sf_dir, linked_response_stops), HORIZONS, MAX_AGE, LAG, TRIP_MAX_AGE, PASSAGE_MAX_AGE, bucket_seconds=86400)


@query(f"""{SIGNAL_CTE} SELECT {REQUEST_SQL}, revision_reason, trip_reason AS upstream_reason,
CASE WHEN trip_reason IS NULL THEN trip_snapshot_id END AS upstream_snapshot_id, CASE WHEN trip_reason IS NULL THEN p[2] END AS upstream_event_key,
CASE WHEN trip_reason IS NULL THEN p[3] END AS upstream_stop_key, CASE WHEN trip_reason IS NULL THEN p[1] END AS upstream_response_index,
CASE WHEN trip_reason IS NULL THEN target_index END AS target_response_index, CASE WHEN trip_reason IS NULL THEN bus_key END AS upstream_bus_key,
CASE WHEN trip_reason IS NULL THEN trip_key END AS upstream_trip_key, CASE WHEN trip_reason IS NULL THEN snapshot_id END AS date_anchor_snapshot_id,
CASE WHEN trip_reason IS NULL THEN 'earlier_stop_api_estimate_proxy' END AS progress_measurement_kind,
CASE WHEN trip_reason IS NULL THEN trip_at END AS upstream_received_at_utc,
CASE WHEN trip_reason IS NULL THEN make_timestamp((p[5] * 1000000)::bigint) END AS upstream_scheduled_departure_utc,
CASE WHEN trip_reason IS NULL THEN make_timestamp((p[6] * 1000000)::bigint) END AS upstream_estimated_departure_utc,
CASE WHEN trip_reason IS NULL THEN p[7]::double END AS upstream_estimated_passage_age_seconds,
api AS api_prediction_seconds, round(trend, 6) AS trend_prediction_seconds, proxy AS upstream_prediction_seconds,
round(blend, 6) AS blend_prediction_seconds, round(combined, 6) AS combined_prediction_seconds FROM combined""")
def signal_features(spark, sf_dir):
    """Features and fixed rules of every usable estimate; the proxy is a stop of the trip response."""
    rows = _features(spark, sf_dir).select(
        *EVENT, "horizon_minutes", "revision_reason", "upstream_reason", "upstream_snapshot_id", "upstream_event_key", "upstream_stop_key",
        "upstream_response_index", "target_response_index", "upstream_bus_key", "upstream_trip_key", "date_anchor_snapshot_id",
        "progress_measurement_kind", "upstream_received_at_utc", "upstream_scheduled_departure_utc", "upstream_estimated_departure_utc",
        "upstream_estimated_passage_age_seconds", *[f"{r}_prediction_seconds" for r in RULES])
    moments = [c for c in rows.columns if c.endswith("_utc")]
    return rounded(_ntz(rows, *moments), 6, *[f"{r}_prediction_seconds" for r in RULES])


@query(f"""{SIGNAL_CTE}, links AS ({LINK_CTE} SELECT {EVENT_SQL}, status, -deviation AS actual FROM ledger),
scored AS (
  SELECT c.*, l.actual FROM combined c JOIN links l USING ({EVENT_SQL})
  WHERE l.status = 'matched' AND epoch(scheduled_departure_utc) + l.actual > epoch(cutoff_utc)),
errors AS ({_cohort_sql()}),
scores AS (SELECT cohort, horizon_minutes, method, {MEASURES}, avg(abs(e)) AS exact FROM errors GROUP BY ALL)
SELECT s.* EXCLUDE (exact), s.exact < a.exact AS better_than_api FROM scores s
JOIN scores a ON a.cohort = s.cohort AND a.horizon_minutes = s.horizon_minutes AND a.method = 'api'""")
def signal_ablation(spark, sf_dir):
    """Every rule, the plain estimate and the schedule on the same measured departures, by cohort."""
    labelled = staged(evaluate.label_features(_features(spark, sf_dir), _links(spark, sf_dir)).select(
        "horizon_minutes", "actual_delay_seconds", "label_exclusion", "revision_reason", "upstream_reason", *[f"{r}_prediction_seconds" for r in RULES]))
    return rounded(evaluate.cohort_scores(labelled), 6, *MEASURED)


@query(f"""{SIGNAL_CTE}, links AS ({LINK_CTE} SELECT {EVENT_SQL}, status, -deviation AS actual FROM ledger)
SELECT horizon_minutes, coalesce(revision_reason, 'usable') AS revision, coalesce(trip_reason, 'usable') AS upstream,
  CASE WHEN status <> 'matched' THEN status WHEN epoch(scheduled_departure_utc) + actual <= epoch(cutoff_utc) THEN 'already_departed_at_cutoff'
       ELSE 'scored' END AS label, count(*) AS requests
FROM combined JOIN links USING ({EVENT_SQL}) GROUP BY ALL""")
def signal_reasons(spark, sf_dir):
    """How many requests each reason keeps out of each cohort."""
    labelled = evaluate.label_features(_features(spark, sf_dir), _links(spark, sf_dir))
    named = lambda column, other: F.coalesce(column, F.lit(other))
    return labelled.groupBy(
        "horizon_minutes", named("revision_reason", "usable").alias("revision"), named("upstream_reason", "usable").alias("upstream"),
        named("label_exclusion", "scored").alias("label"),
    ).agg(F.count(F.lit(1)).alias("requests"))
