"""Queries over captured estimates, trip responses and measured outcomes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lagline.functions.clock import instant_issue, instant_of
from lagline.functions.numbering import number_rows
from lagline.operators import asof, audit, evaluate, link, normalize, sets, signals, trips
from lagline.operators.metrics import METRIC_COLUMNS
from lagline.plans import adapter
from lagline.plans.adapter import (
    captures, envelopes, linked_observations, local_times, observations, oracle, outcomes, requests, rounded,
    trip_snapshots, trip_stops, view,
)
from lagline.plans.forecast_queries import MEASURES
from lagline.plans.registry import query
from lagline.session import ensure_checkpoint_dir
from lagline.sources.capture import read_capture
from lagline.staging import staged
from lagline.streaming import ingest

# The tables span days, so horizons and ages are scaled from minutes to hours.
HORIZONS = [60, 720, 1440, 2880]
MAX_AGE = 86400
LAG = 21600
EVENT = asof.EVENT
MEASURED = [m for m in METRIC_COLUMNS if m != "n"]


def _ntz(frame, *names):
    """Instants as times without zone, which both engines print alike."""
    return frame.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


ASOF_CTE = f"""
WITH obs AS ({oracle(observations)}),
asked AS (
  SELECT DISTINCT trip_key, scheduled_stop_key, scheduled_departure_raw, scheduled_departure_utc,
         unnest({HORIZONS}) AS horizon_minutes FROM obs),
cut AS (SELECT *, scheduled_departure_utc - to_minutes(horizon_minutes) AS cutoff_utc FROM asked),
cur AS (
  SELECT c.*, o.snapshot_id, o.received_at_utc, o.cancelled, o.bus_key, o.estimated_delay_seconds, o.estimated_departure_utc,
         row_number() OVER (PARTITION BY c.trip_key, c.scheduled_stop_key, c.scheduled_departure_raw, c.horizon_minutes
                            ORDER BY o.received_at_utc DESC NULLS LAST, o.snapshot_id DESC) AS place
  FROM cut c LEFT JOIN obs o ON o.trip_key = c.trip_key AND o.scheduled_stop_key = c.scheduled_stop_key
    AND o.scheduled_departure_raw = c.scheduled_departure_raw AND o.received_at_utc <= c.cutoff_utc),
current AS (
  SELECT * EXCLUDE (place), CASE WHEN snapshot_id IS NULL THEN 'no_snapshot_before_cutoff'
         WHEN epoch(cutoff_utc) - epoch(received_at_utc) > {MAX_AGE} THEN 'snapshot_stale'
         WHEN cancelled THEN 'cancelled_at_cutoff'
         WHEN estimated_delay_seconds IS NULL OR estimated_departure_utc IS NULL THEN 'estimate_missing' END AS reason
  FROM cur WHERE place = 1),
old AS (
  SELECT c.*, o.snapshot_id AS old_id, o.received_at_utc AS old_at, o.cancelled AS old_cancelled, o.bus_key AS old_bus,
         o.estimated_delay_seconds AS old_delay,
         row_number() OVER (PARTITION BY c.trip_key, c.scheduled_stop_key, c.scheduled_departure_raw, c.horizon_minutes
                            ORDER BY o.received_at_utc DESC NULLS LAST, o.snapshot_id DESC) AS place
  FROM (SELECT * FROM current WHERE reason IS NULL) c
  LEFT JOIN obs o ON o.trip_key = c.trip_key AND o.scheduled_stop_key = c.scheduled_stop_key
    AND o.scheduled_departure_raw = c.scheduled_departure_raw AND o.received_at_utc <= c.cutoff_utc - to_seconds({LAG})),
revised AS (
  SELECT * EXCLUDE (place), CASE WHEN old_id IS NULL THEN 'revision_history_missing'
         WHEN epoch(cutoff_utc) - {LAG} - epoch(old_at) > {MAX_AGE} THEN 'revision_history_stale'
         WHEN old_cancelled OR old_delay IS NULL THEN 'revision_history_unavailable'
         WHEN old_bus <> bus_key THEN 'revision_bus_changed_or_missing'
         WHEN epoch(received_at_utc) <= epoch(old_at) THEN 'revision_invalid_order' END AS revision_reason
  FROM old WHERE place = 1)
"""
EVENT_SQL = ", ".join(EVENT)


def _observations(spark, sf_dir):
    return view(spark, sf_dir, observations)


@query(f"""{ASOF_CTE} SELECT {EVENT_SQL}, horizon_minutes, reason,
CASE WHEN reason IS NULL THEN snapshot_id END AS snapshot_id, CASE WHEN reason IS NULL THEN received_at_utc END AS received_at_utc,
CASE WHEN reason IS NULL THEN estimated_delay_seconds END AS estimated_delay_seconds FROM current""")
def asof_horizon(spark, sf_dir):
    chosen = asof.select_at_horizons(_observations(spark, sf_dir), HORIZONS, MAX_AGE)
    usable = F.col("reason").isNull()
    fields = ["snapshot_id", "received_at_utc", "estimated_delay_seconds"]
    return _ntz(chosen.select(
        *EVENT, "horizon_minutes", "reason", *[F.when(usable, F.col(f"current.{f}")).alias(f) for f in fields]
    ), "received_at_utc")


@query(f"""{ASOF_CTE} SELECT horizon_minutes, coalesce(reason, 'usable') AS reason, count(*) AS events FROM current GROUP BY ALL""")
def asof_reasons(spark, sf_dir):
    chosen = asof.select_at_horizons(_observations(spark, sf_dir), HORIZONS, MAX_AGE)
    return chosen.groupBy("horizon_minutes", F.coalesce("reason", F.lit("usable")).alias("reason")).agg(
        F.count(F.lit(1)).alias("events")
    )


REVISION_FIELDS = """revision_reason, CASE WHEN revision_reason IS NULL THEN estimated_delay_seconds - old_delay END AS revision_seconds,
CASE WHEN revision_reason IS NULL THEN epoch(received_at_utc) - epoch(old_at) END AS revision_interval_seconds,
CASE WHEN revision_reason IS NULL THEN old_id END AS history_snapshot_id"""


def _revised(spark, sf_dir):
    chosen = asof.select_at_horizons(_observations(spark, sf_dir), HORIZONS, MAX_AGE, LAG)
    return asof.with_revision(chosen.where("reason is null"), LAG, MAX_AGE)


@query(f"""{ASOF_CTE} SELECT {EVENT_SQL}, horizon_minutes, {REVISION_FIELDS} FROM revised""")
def asof_revision(spark, sf_dir):
    return _revised(spark, sf_dir).select(
        *EVENT, "horizon_minutes", "revision_reason", "revision_seconds", "revision_interval_seconds",
        "history_snapshot_id",
    )


TRIP_CTE = f"""{ASOF_CTE}, snaps AS ({oracle(trip_snapshots)}),
tripped AS (
  SELECT r.*, s.snapshot_id AS trip_snapshot_id, s.received_at_utc AS trip_at, s.http_status, s.error_kind, s.payload_trip_key, s.payload_bus_key,
         row_number() OVER (PARTITION BY r.trip_key, r.scheduled_stop_key, r.scheduled_departure_raw, r.horizon_minutes
                            ORDER BY s.received_at_utc DESC NULLS LAST, s.snapshot_id DESC) AS place
  FROM revised r LEFT JOIN snaps s ON s.trip_key = r.trip_key AND s.received_at_utc <= r.cutoff_utc),
judged AS (
  SELECT * EXCLUDE (place), CASE WHEN trip_snapshot_id IS NULL THEN 'trip_snapshot_missing'
         WHEN epoch(cutoff_utc) - epoch(trip_at) > 43200 THEN 'trip_snapshot_stale'
         WHEN http_status <> 200 OR coalesce(error_kind, '') <> '' THEN 'trip_response_error'
         WHEN payload_trip_key <> trip_key THEN 'trip_identity_mismatch'
         WHEN payload_bus_key <> bus_key THEN 'trip_bus_changed_or_missing' END AS trip_reason
  FROM tripped WHERE place = 1)
"""


def _tripped(spark, sf_dir):
    revised = _revised(spark, sf_dir).withColumn("bus_key", F.col("current.bus_key"))
    snapshots = view(spark, sf_dir, trip_snapshots).withColumnRenamed("trip_key", "resource_id")
    return signals.latest_trip_snapshot(revised, snapshots, 43200, bucket_seconds=86400)


@query(f"""{TRIP_CTE} SELECT {EVENT_SQL}, horizon_minutes, trip_snapshot_id, trip_reason FROM judged""")
def asof_trip_snapshot(spark, sf_dir):
    return _tripped(spark, sf_dir).select(
        *EVENT, "horizon_minutes", F.col("trip.tie").alias("trip_snapshot_id"), "trip_reason"
    )


# The proxy of the rules below is a fixed function of the chosen trip response.
PROXY = "cast(trip_snapshot_id AS bigint) % 600 - 100"
ACTUAL = "(cast(substr(trip_key, 5) AS bigint) * 37 + cast(substr(scheduled_departure_raw, 9, 2) AS bigint) * 101) % 4801 - 900"
RULES_CTE = f"""{TRIP_CTE}, parts AS (
  SELECT *, estimated_delay_seconds AS api, CASE WHEN trip_reason IS NULL THEN ({PROXY})::double END AS proxy,
         CASE WHEN revision_reason IS NULL THEN (estimated_delay_seconds - old_delay) / (epoch(received_at_utc) - epoch(old_at)) * 60 END AS rate,
         ({ACTUAL})::double AS actual FROM judged),
rules AS (
  SELECT *, CASE WHEN rate IS NOT NULL THEN api + greatest(-120, least(120, rate * least(horizon_minutes, 3))) END AS trend FROM parts),
combined AS (SELECT *, (api + proxy) / 2 AS blend, (trend + proxy) / 2 AS combined FROM rules)
"""


def _ruled(spark, sf_dir):
    rows = _tripped(spark, sf_dir).withColumn("trip_snapshot_id", F.col("trip.tie"))
    proxied = rows.withColumns(
        {
            "api_prediction_seconds": F.col("current.estimated_delay_seconds"),
            "upstream_reason": F.col("trip_reason"),
            "upstream_delay_seconds": F.when(F.col("trip_reason").isNull(), F.expr(f"cast({PROXY} as double)")),
            "actual_delay_seconds": F.expr(f"cast({ACTUAL} as double)"),
        }
    )
    return signals.fixed_rules(proxied)


@query(f"""{RULES_CTE} SELECT {EVENT_SQL}, horizon_minutes, api AS api_prediction_seconds, round(trend, 6) AS trend_prediction_seconds,
proxy AS upstream_prediction_seconds, round(blend, 6) AS blend_prediction_seconds, round(combined, 6) AS combined_prediction_seconds FROM combined""")
def fixed_rules(spark, sf_dir):
    names = [f"{m}_prediction_seconds" for m in ("api", "trend", "upstream", "blend", "combined")]
    return rounded(_ruled(spark, sf_dir).select(*EVENT, "horizon_minutes", *names), 6, *names[1:])


def _cohort_sql() -> str:
    when = {
        "revision": "revision_reason IS NULL", "upstream": "trip_reason IS NULL",
        "both": "revision_reason IS NULL AND trip_reason IS NULL",
    }
    value = {"api": "api", "on_time": "0.0", "trend": "trend", "upstream": "proxy", "blend": "blend", "combined": "combined"}
    parts = [
        f"SELECT '{c}' AS cohort, horizon_minutes, '{m}' AS method, ({value[m]})::double - actual AS e FROM scored WHERE {when[c]}"
        for c, rules in signals.COHORTS.items() for m in ["api", "on_time", *rules]
    ]
    return " UNION ALL ".join(parts)


@query(f"""{RULES_CTE}, scored AS (SELECT * FROM combined WHERE epoch(scheduled_departure_utc) + actual > epoch(cutoff_utc)),
errors AS ({_cohort_sql()}),
scores AS (SELECT cohort, horizon_minutes, method, {MEASURES}, avg(abs(e)) AS exact FROM errors GROUP BY ALL)
SELECT s.* EXCLUDE (exact), s.exact < a.exact AS better_than_api FROM scores s
JOIN scores a ON a.cohort = s.cohort AND a.horizon_minutes = s.horizon_minutes AND a.method = 'api'""")
def rule_scores(spark, sf_dir):
    departed = F.when(evaluate.departed_by_cutoff(), F.lit("already_departed_at_cutoff"))
    labelled = staged(_ruled(spark, sf_dir).withColumn("label_exclusion", departed).select(
        "horizon_minutes", "actual_delay_seconds", "label_exclusion", "revision_reason", "upstream_reason",
        *[f"{m}_prediction_seconds" for m in ("api", "trend", "upstream", "blend", "combined")],
    ))
    return rounded(evaluate.cohort_scores(labelled), 6, *MEASURED)


LINK_CTE = f"""
WITH obs AS ({oracle(linked_observations)}), outs AS ({oracle(outcomes)}),
firsts AS (
  SELECT {EVENT_SQL}, count(*) AS snapshots, arg_min(stop_number, (received_at_utc, snapshot_id)) AS ignored,
         min((received_at_utc, snapshot_id)) AS first_row FROM obs GROUP BY ALL),
live AS (
  SELECT f.trip_key, f.scheduled_stop_key, f.scheduled_departure_raw, f.snapshots, o.stop_number, o.variant_name,
         CASE WHEN o.stop_number IS NOT NULL THEN
           (o.route_number, o.stop_number, regexp_replace(trim(lower(o.variant_name)), '\\s+', ' ', 'g'),
            epoch(cast(replace(f.scheduled_departure_raw, '+00:00', '') AS timestamp))) END AS k
  FROM firsts f JOIN obs o ON o.snapshot_id = first_row[2] AND o.trip_key = f.trip_key AND o.scheduled_stop_key = f.scheduled_stop_key
    AND o.scheduled_departure_raw = f.scheduled_departure_raw),
shared AS (SELECT k, count(*) AS n FROM live WHERE k IS NOT NULL GROUP BY k),
measured AS (
  SELECT (route_number, stop_number, regexp_replace(trim(lower(route_destination)), '\\s+', ' ', 'g'),
          epoch(cast(replace(scheduled_time, 'Z', '') AS timestamp))) AS k, count(*) AS n, min(row_id) AS row_id,
         min(deviation::double) AS deviation
  FROM outs WHERE stop_number IS NOT NULL GROUP BY 1),
ledger AS (
  SELECT e.*, CASE WHEN e.k IS NULL THEN 'invalid_live_identity' WHEN s.n > 1 THEN 'multiple_live_events_same_match_key'
         WHEN m.n IS NULL THEN 'no_exact_outcome' WHEN m.n > 1 THEN 'multiple_outcomes' ELSE 'matched' END AS status, m.row_id, m.deviation
  FROM live e LEFT JOIN shared s ON s.k = e.k LEFT JOIN measured m ON m.k = e.k)
"""


def _links(spark, sf_dir):
    return link.link_outcomes(view(spark, sf_dir, linked_observations, parse_heavy=True), view(spark, sf_dir, outcomes, parse_heavy=True))


@query(f"""{LINK_CTE} SELECT {EVENT_SQL}, snapshots, stop_number, variant_name, status,
CASE WHEN status = 'matched' THEN row_id END AS outcome_row_id, CASE WHEN status = 'matched' THEN -deviation END AS actual_delay_seconds FROM ledger""")
def unique_match(spark, sf_dir):
    return _links(spark, sf_dir).drop("measured_schedule_utc")


JUDGED_CTE = f"""{LINK_CTE}, obs2 AS (
  SELECT *, scheduled_departure_utc AS due FROM ({oracle(observations)}) x),
paired AS (
  SELECT o.* REPLACE (l.trip_key AS trip_key, l.scheduled_stop_key AS scheduled_stop_key), o.snapshot_id AS sid
  FROM obs2 o JOIN ({oracle(linked_observations)}) l USING (snapshot_id)),
asked AS (SELECT *, unnest({HORIZONS}) AS horizon_minutes FROM ledger),
cut AS (SELECT *, cast(replace(scheduled_departure_raw, '+00:00', '') AS timestamp) AS due,
        cast(replace(scheduled_departure_raw, '+00:00', '') AS timestamp) - to_minutes(horizon_minutes) AS cutoff FROM asked),
picked AS (
  SELECT c.trip_key, c.status, c.deviation, c.due, c.cutoff, c.horizon_minutes, p.sid, p.received_at_utc, p.cancelled,
         p.estimated_delay_seconds AS est,
         row_number() OVER (PARTITION BY c.trip_key, c.scheduled_stop_key, c.scheduled_departure_raw, c.horizon_minutes
                            ORDER BY p.received_at_utc DESC NULLS LAST, p.sid DESC) AS place
  FROM cut c LEFT JOIN paired p ON p.trip_key = c.trip_key AND p.scheduled_stop_key = c.scheduled_stop_key
    AND p.scheduled_departure_raw = c.scheduled_departure_raw AND p.received_at_utc <= c.cutoff),
judged AS (
  SELECT *, -deviation AS actual, CASE WHEN status <> 'matched' THEN status WHEN sid IS NULL THEN 'no_snapshot_before_cutoff'
         WHEN epoch(cutoff) - epoch(received_at_utc) > {MAX_AGE} THEN 'snapshot_stale' WHEN cancelled THEN 'cancelled_at_cutoff'
         WHEN est IS NULL THEN 'estimate_missing'
         WHEN epoch(due) - deviation <= epoch(cutoff) THEN 'already_departed_at_cutoff' END AS exclusion
  FROM picked WHERE place = 1)"""


@query(f"""{JUDGED_CTE},
errors AS (
  SELECT horizon_minutes, 'api' AS method, est - actual AS e, trip_key, est FROM judged WHERE exclusion IS NULL
  UNION ALL SELECT horizon_minutes, 'on_time', -actual, trip_key, est FROM judged WHERE exclusion IS NULL)
SELECT horizon_minutes, method, {MEASURES}, count(DISTINCT trip_key) AS distinct_trips, bool_and(est = 0) AS all_predictions_equal_schedule
FROM errors GROUP BY ALL""")
def live_evaluation(spark, sf_dir):
    return rounded(evaluate.horizon_scores(_ledger(spark, sf_dir)), 6, *MEASURED)


def _ledger(spark, sf_dir):
    links = _links(spark, sf_dir)
    keys = view(spark, sf_dir, linked_observations, parse_heavy=True).select("snapshot_id", "trip_key", "scheduled_stop_key")
    observed = _observations(spark, sf_dir).drop("trip_key", "scheduled_stop_key").join(keys, "snapshot_id")
    return staged(evaluate.forecast_ledger(observed, links, HORIZONS, MAX_AGE))


@query(f"""{JUDGED_CTE}
SELECT horizon_minutes, exclusion, count(*) AS events FROM judged WHERE exclusion IS NOT NULL GROUP BY ALL""")
def live_exclusions(spark, sf_dir):
    """Why events have no forecast at a horizon, counted by reason."""
    return evaluate.exclusion_counts(_ledger(spark, sf_dir))


STOPS_CTE = f"""
WITH stops AS ({oracle(trip_stops)}),
clocks AS (
  SELECT *, split_part(scheduled_clock, ':', 1)::bigint * 3600 + split_part(scheduled_clock, ':', 2)::bigint * 60
            + split_part(scheduled_clock, ':', 3)::bigint AS v,
         last_value(event_key) OVER w AS target_key, last_value(due_at) OVER w AS anchor
  FROM stops WINDOW w AS (PARTITION BY snapshot_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
falls AS (SELECT *, lag(v) OVER (PARTITION BY snapshot_id ORDER BY position) - v AS fall FROM clocks),
shifted AS (
  SELECT *, v + 86400 * sum((coalesce(fall, 0) > 0)::int) OVER (PARTITION BY snapshot_id ORDER BY position) AS shift FROM falls),
facts AS (
  SELECT snapshot_id, count(*) FILTER (WHERE fall > 0 AND fall < 43200) AS bad, max(shift) - min(shift) AS span,
         count(*) FILTER (WHERE event_key = target_key) AS targets, max(shift) FILTER (WHERE event_key = target_key) AS at_target,
         max(position) FILTER (WHERE event_key = target_key) AS target_position,
         any_value(epoch(anchor)::bigint % 86400) AS anchor_clock FROM shifted GROUP BY snapshot_id),
resolved AS (
  SELECT s.*, f.target_position, f.bad = 0 AND f.span <= 43200 AND f.targets = 1 AND f.at_target % 86400 = f.anchor_clock AS resolved,
         s.anchor + to_seconds((s.shift - f.at_target)::bigint) AS local_time FROM shifted s JOIN facts f USING (snapshot_id))
"""


def _resolved(spark, sf_dir):
    """January has no clock change: the wall time doubles as a dated anchor."""
    stops = view(spark, sf_dir, trip_stops)
    last = stops.groupBy("snapshot_id").agg(
        F.max_by("event_key", "position").alias("target_key"), F.max_by("due_at", "position").alias("_at")
    )
    anchored = stops.join(last, "snapshot_id").withColumn(
        "anchor_utc", F.convert_timezone(F.lit("America/Chicago"), F.lit("UTC"), F.col("_at")).cast("timestamp")
    )
    return signals.resolve_trip_schedule(anchored, ["snapshot_id"])


@query(f"""{STOPS_CTE} SELECT snapshot_id, position, resolved, target_position,
CASE WHEN resolved THEN local_time + interval 6 hour END AS scheduled_utc FROM resolved""")
def trip_resolve(spark, sf_dir):
    rows = _resolved(spark, sf_dir).select("snapshot_id", "position", "resolved", "target_position", "scheduled_utc")
    return _ntz(rows, "scheduled_utc")


@query(f"""{STOPS_CTE}, estimated AS (
  SELECT *, split_part(estimated_clock, ':', 1)::bigint * 3600 + split_part(estimated_clock, ':', 2)::bigint * 60
            + split_part(estimated_clock, ':', 3)::bigint AS ev, epoch(local_time)::bigint AS sched,
         epoch(anchor)::bigint - 300 AS received FROM resolved),
near AS (
  SELECT *, list_aggregate(list_transform([-1, 0, 1], lambda d: abs(sched // 86400 * 86400 + d * 86400 + ev - sched)), 'min') AS gap FROM estimated),
dated AS (
  SELECT *, CASE WHEN gap <= 3600 THEN CASE WHEN (ev - sched % 86400 + 43200) % 86400 - 43200 = gap
              OR (ev - sched % 86400 + 129600) % 86400 - 43200 = gap THEN sched + gap ELSE sched - gap END END AS est FROM near),
facts2 AS (
  SELECT snapshot_id, bool_or(resolved) AS ok, bool_or(cancelled) FILTER (WHERE position = target_position) AS gone,
         max(sched) FILTER (WHERE position = target_position) AS target_sched FROM dated GROUP BY snapshot_id),
candidates AS (
  SELECT d.*, row_number() OVER (PARTITION BY snapshot_id ORDER BY position DESC) AS place FROM dated d JOIN facts2 f USING (snapshot_id)
  WHERE resolved AND position < target_position AND NOT cancelled AND received - est BETWEEN 0 AND 14400 AND sched < target_sched)
SELECT f.snapshot_id, CASE WHEN NOT ok THEN 'trip_date_unresolved' WHEN gone THEN 'trip_target_cancelled'
         WHEN c.position IS NULL THEN 'recent_earlier_stop_proxy_missing' END AS trip_reason,
       CASE WHEN ok AND NOT gone THEN c.position END AS upstream_response_index,
       CASE WHEN ok AND NOT gone THEN (est - sched)::double END AS upstream_delay_seconds,
       CASE WHEN ok AND NOT gone THEN (received - est)::double END AS upstream_passage_age_seconds
FROM facts2 f LEFT JOIN (SELECT * FROM candidates WHERE place = 1) c USING (snapshot_id)""")
def upstream_signal(spark, sf_dir):
    rows = _resolved(spark, sf_dir).withColumn("received_at_utc", F.col("anchor_utc") - F.expr("interval 5 minutes"))
    found = signals.upstream_from_stops(rows, ["snapshot_id"], max_passage_age_seconds=14400)
    return found.select(
        "snapshot_id", "trip_reason", "upstream_response_index", "upstream_delay_seconds",
        "upstream_passage_age_seconds",
    )


LISTED_CTE = f"""WITH stops AS ({oracle(trip_stops)}), listed AS (
  SELECT split_part(snapshot_id, '-', 1) AS trip_key, min(due_at)::date AS trip_date, min(due_at) AS start_utc,
         count(*) FILTER (WHERE event_id % 5 <> 0) AS measured_stops, count(*) % 9 AS captures FROM stops GROUP BY 1)"""


def _listed(spark, sf_dir):
    trip = F.split_part("snapshot_id", F.lit("-"), F.lit(1)).alias("trip_key")
    return view(spark, sf_dir, trip_stops).groupBy(trip).agg(
        F.to_date(F.min("due_at")).alias("trip_date"), F.min("due_at").alias("start_utc"),
        F.count_if(F.expr("event_id % 5 <> 0")).alias("measured_stops"), (F.count(F.lit(1)) % 9).alias("captures"),
    ).withColumn("bus_key", F.lit("b"))


@query(f"""{LISTED_CTE} SELECT trip_key, trip_date, 'b' AS bus_key FROM listed
ORDER BY measured_stops > 0 DESC, captures >= 5 DESC, measured_stops DESC, captures DESC, trip_date DESC, start_utc DESC, trip_key DESC LIMIT 1""")
def default_trip(spark, sf_dir):
    return trips.default_trip(_listed(spark, sf_dir))


@query(f"""{LISTED_CTE} SELECT trip_key, row_number() OVER (ORDER BY trip_date DESC, start_utc DESC, trip_key DESC) AS place FROM listed""")
def trip_order(spark, sf_dir):
    """Places in the list, read back from its order."""
    ordered = trips.in_list_order(_listed(spark, sf_dir)).select("trip_key", "trip_date", "start_utc")
    return number_rows(ordered, [F.desc("trip_date"), F.desc("start_utc"), F.desc("trip_key")], "place", 1).select("trip_key", "place")


@query(f"""WITH stops AS ({oracle(trip_stops)}), v AS (
  SELECT *, split_part(snapshot_id, '-', 1) AS trip, CASE WHEN event_id % 5 <> 0 THEN (event_id * 31 % 4801 - 900)::double END AS d FROM stops),
o AS (SELECT trip, d, row_number() OVER (PARTITION BY trip ORDER BY d) AS place, count(*) OVER (PARTITION BY trip) AS n FROM v WHERE d IS NOT NULL),
m AS (SELECT trip, d AS median FROM o WHERE place = n // 2 + 1)
SELECT trip, count(*) AS stops, count(d) AS measured_stops, round(avg((abs(d) <= 120)::int), 6) AS within_120_share,
       any_value(m.median) AS median_delay_seconds, min(due_at) AS start_utc, max(due_at) AS end_utc,
       arg_min(event_key, (due_at, event_id)) AS from_stop, arg_max(event_key, (due_at, event_id)) AS to_stop
FROM v LEFT JOIN m USING (trip) GROUP BY trip""")
def trip_summary(spark, sf_dir):
    stops = view(spark, sf_dir, trip_stops)
    measured = stops.select(
        F.split_part("snapshot_id", F.lit("-"), F.lit(1)).alias("trip"), F.col("due_at").alias("scheduled_utc"),
        F.struct("due_at", "event_id").alias("position"), F.col("event_key").alias("stop_name"),
        F.expr("CASE WHEN event_id % 5 <> 0 THEN cast(event_id * 31 % 4801 - 900 AS double) END").alias("actual_delay_seconds"),
    )
    return rounded(trips.trip_summary(measured, trip=["trip"]), 6, "within_120_share")


@query(f"""WITH r AS ({oracle(requests)}), g AS (
  SELECT stop, requested_at, epoch(requested_at) - epoch(lag(requested_at) OVER (PARTITION BY stop ORDER BY requested_at)) AS gap FROM r)
SELECT stop, count(*) AS polls, round(median(gap), 3) AS median_gap_seconds, round(max(gap), 3) AS max_gap_seconds FROM g GROUP BY stop""")
def poll_gaps(spark, sf_dir):
    return audit.poll_gaps(view(spark, sf_dir, requests))


REVISED_CTE = f"""WITH obs AS (SELECT *, CASE WHEN snapshot_id::bigint % 4 = 0 THEN 'trip' ELSE 'stop' END AS resource_type,
  strftime(estimated_departure_utc, '%H:%M:%S') AS estimated_departure_raw FROM ({oracle(observations)}) o),
g AS (SELECT resource_type, {EVENT_SQL}, count(*) AS snapshots, count(DISTINCT estimated_departure_raw) > 1 AS changed,
        arg_min_null(estimated_departure_raw, (received_at_utc, snapshot_id)) AS first_estimated_departure_raw,
        arg_max_null(estimated_departure_raw, (received_at_utc, snapshot_id)) AS last_estimated_departure_raw
      FROM obs GROUP BY ALL HAVING count(*) > 1)"""


def _estimate_groups(spark, sf_dir):
    rows = _observations(spark, sf_dir).withColumns(
        {
            "resource_type": F.expr("CASE WHEN cast(snapshot_id AS bigint) % 4 = 0 THEN 'trip' ELSE 'stop' END"),
            "estimated_departure_raw": F.date_format("estimated_departure_utc", "HH:mm:ss"),
        }
    )
    return audit.estimate_groups(rows)


@query(f"""{REVISED_CTE} SELECT resource_type, count(*) AS repeated_groups, count(*) FILTER (WHERE changed) AS changed_groups FROM g GROUP BY resource_type""")
def revised_estimates(spark, sf_dir):
    return audit.revised_estimate_counts(_estimate_groups(spark, sf_dir))


@query(f"""{REVISED_CTE} SELECT {EVENT_SQL}, first_estimated_departure_raw, last_estimated_departure_raw, snapshots FROM g
WHERE resource_type = 'stop' AND changed ORDER BY {EVENT_SQL} LIMIT 5""")
def revised_examples(spark, sf_dir):
    return audit.revised_examples(_estimate_groups(spark, sf_dir))


@query(f"""WITH c AS ({oracle(captures)}) SELECT origin, count(*) AS responses, count(error_kind) AS errors,
count(*) FILTER (WHERE http_status = 200 AND error_kind IS NULL) AS usable_responses, max(received_at_utc) AS last_received_at_utc
FROM c GROUP BY origin""")
def capture_status(spark, sf_dir):
    return _ntz(audit.capture_status(view(spark, sf_dir, captures)), "last_received_at_utc")


@query(f"""WITH c AS ({oracle(captures)}) SELECT cycle_id, count(*) AS requests,
count(*) FILTER (WHERE http_status = 200 AND error_kind IS NULL) AS successful_responses, sum(observation_count)::bigint AS observations,
count(error_kind) AS errors, CASE WHEN count(error_kind) = 0 THEN 'complete' ELSE 'completed_with_errors' END AS status FROM c GROUP BY cycle_id""")
def cycle_totals(spark, sf_dir):
    return audit.cycle_totals(view(spark, sf_dir, captures))


NORMAL_CTE = f"""WITH env AS ({oracle(envelopes)}),
ok AS (SELECT * FROM env WHERE http_status = 200),
blocks AS (
  SELECT snapshot_id, resource_type, resource_id, received_at_utc, NULL::varchar AS trip, json_extract(payload_json, '$."stop-schedule".stop') AS shared,
         unnest(from_json(json_extract(payload_json, '$."stop-schedule"."route-schedules"'), '["JSON"]')) AS block
  FROM ok WHERE resource_type = 'stop' AND json_exists(payload_json, '$."stop-schedule"')),
events AS (
  SELECT snapshot_id, resource_type, resource_id, received_at_utc, NULL::varchar AS trip_key0, NULL::varchar AS schedule_type,
         json_extract_string(shared, '$.key') AS stop_key0, json_extract_string(shared, '$.number') AS stop_number0,
         json_extract_string(block, '$.route.number') AS route_number, 0 AS row_number,
         unnest(from_json(json_extract(block, '$."scheduled-stops"'), '["JSON"]')) AS e
  FROM blocks WHERE coalesce(json_extract_string(block, '$.route.number'), json_extract_string(block, '$.route.key')) = 'BLUE'
  UNION ALL
  SELECT snapshot_id, resource_type, resource_id, received_at_utc, json_extract_string(payload_json, '$.trip.key'),
         json_extract_string(payload_json, '$.trip."schedule-type"'), NULL, NULL, 'BLUE',
         unnest([0, 1]), unnest(from_json(json_extract(payload_json, '$.trip."scheduled-stops"'), '["JSON"]'))
  FROM ok WHERE resource_type = 'trip' AND json_exists(payload_json, '$.trip')),
flat AS (
  SELECT snapshot_id, resource_type, received_at_utc, row_number, schedule_type, route_number,
         json_extract_string(e, '$.key') AS scheduled_stop_key, coalesce(json_extract_string(e, '$."trip-key"'), trip_key0) AS trip_key,
         json_extract_string(e, '$.bus.key') AS bus_key, coalesce(json_extract_string(e, '$.stop.key'), stop_key0) AS stop_key,
         coalesce(json_extract_string(e, '$.stop.number'), stop_number0) AS stop_number,
         json_extract_string(e, '$.variant.name') AS variant_name, json_extract_string(e, '$.cancelled') = 'true' AS cancelled,
         json_extract_string(e, '$.times.departure.scheduled') AS sched, json_extract_string(e, '$.times.departure.estimated') AS est FROM events)
"""
OBSERVED = (
    "snapshot_id, resource_type, row_number, schedule_type, route_number, scheduled_stop_key, trip_key, bus_key, stop_key, "
    "stop_number, variant_name, cancelled"
)


@query(f"""{NORMAL_CTE} SELECT {OBSERVED}, sched AS scheduled_departure_raw,
try_cast(CASE WHEN contains(sched, 'T') THEN sched END AS timestamp) + interval 6 hour AS scheduled_departure_utc,
epoch(try_cast(CASE WHEN contains(sched, 'T') THEN est END AS timestamp)) - epoch(try_cast(CASE WHEN contains(sched, 'T') THEN sched END AS timestamp)) AS estimated_delay_seconds,
epoch(try_cast(CASE WHEN contains(sched, 'T') THEN sched END AS timestamp)) + 21600 - epoch(received_at_utc) AS scheduled_lead_seconds,
CASE WHEN contains(sched, 'T') THEN NULL ELSE 'date_missing' END AS scheduled_issue, CASE WHEN est IS NULL THEN 'missing' END AS estimated_issue FROM flat""")
def normalize_payload(spark, sf_dir):
    _, rows = normalize.normalize_envelopes(view(spark, sf_dir, envelopes, parse_heavy=True), "BLUE")
    fields = [c.strip() for c in OBSERVED.split(",")]
    issue = lambda k: F.try_element_at("time_issues", F.lit(k)).alias(f"{k}_issue")
    return _ntz(rows.select(
        *fields, "scheduled_departure_raw", "scheduled_departure_utc", "estimated_delay_seconds",
        "scheduled_lead_seconds", issue("scheduled"), issue("estimated"),
    ), "scheduled_departure_utc")


@query(f"""{NORMAL_CTE}, n AS (SELECT snapshot_id, count(*) AS rows FROM flat GROUP BY snapshot_id)
SELECT snapshot_id, http_status, CASE WHEN http_status = 200 AND contains(payload_json, 'unexpected') THEN 'schema_error' END AS error_kind,
sha256(payload_json) AS payload_sha256, coalesce(rows, 0)::integer AS observation_count FROM env LEFT JOIN n USING (snapshot_id)""")
def snapshot_ledger(spark, sf_dir):
    snapshots, _ = normalize.normalize_envelopes(view(spark, sf_dir, envelopes, parse_heavy=True), "BLUE")
    return snapshots.select("snapshot_id", "http_status", "error_kind", "payload_sha256", "observation_count")


@query(f"""{NORMAL_CTE}, n AS (SELECT snapshot_id, count(*) AS rows FROM flat GROUP BY snapshot_id),
s AS (SELECT *, snapshot_id::bigint AS i, coalesce(rows, 0) > 0 AS has FROM env LEFT JOIN n USING (snapshot_id))
SELECT 'snapshot_row_count' AS metric, count(*) FILTER (WHERE has AND i % 13 = 0) AS value FROM s
UNION ALL SELECT 'payload_hash', count(*) FILTER (WHERE i % 37 = 0) FROM s
UNION ALL SELECT 'reparse_failure', 0
UNION ALL SELECT 'normalized_payload', count(*) FILTER (WHERE has AND (i % 13 = 0 OR i % 17 = 0)) FROM s""")
def reconcile_payload(spark, sf_dir):
    """Stored rows and digests are damaged in known places, and the audit must find them."""
    snapshots, rows = map(staged, normalize.normalize_envelopes(view(spark, sf_dir, envelopes, parse_heavy=True), "BLUE"))
    number = F.col("snapshot_id").cast("bigint")
    damaged = snapshots.withColumn(
        "payload_sha256", F.when(number % 37 == 0, F.lit("0")).otherwise(F.col("payload_sha256"))
    )
    lost = rows.where((number % 13 != 0) | (F.col("row_number") > 0)).withColumn(
        "trip_key", F.when(number % 17 == 0, F.lit("changed")).otherwise(F.col("trip_key"))
    )
    return audit.reconcile_payloads(damaged, lost, "BLUE")


def _capture(spark, sf_dir):
    extra = view(spark, sf_dir, captures).select("snapshot_id", "origin", "cycle_id", "attempt_number")
    snapshots, rows = normalize.normalize_envelopes(view(spark, sf_dir, envelopes, parse_heavy=True).join(extra, "snapshot_id"), "BLUE")
    return snapshots, rows


CAPTURE_COUNTS = {
    "observations": "true", "missing_bus_observations": "bus_key IS NULL", "cancelled_observations": "cancelled",
    "dated_stop_estimates": "resource_type = 'stop'",
    "dated_stop_estimates_before_departure": "resource_type = 'stop' AND epoch(try_cast(sched AS timestamp)) + 21600 > epoch(received_at_utc)",
    "clock_only_scheduled_times": "resource_type = 'trip'",
}


CAPTURE_COUNTS_SQL = (NORMAL_CTE + "SELECT 'responses' AS metric, count(*) AS value FROM env"
       " UNION ALL SELECT 'retry_attempts', count(*) FILTER (WHERE snapshot_id::bigint % 3 > 1) FROM env"
       + "".join(f" UNION ALL SELECT '{n}', count(*) FILTER (WHERE {c}) FROM flat" for n, c in CAPTURE_COUNTS.items())
       + " UNION ALL SELECT 'distinct_trips', count(DISTINCT trip_key) FROM flat"
         " UNION ALL SELECT 'distinct_buses', count(DISTINCT bus_key) FROM flat"
         " UNION ALL SELECT 'distinct_stops', count(DISTINCT stop_key) FROM flat")


@query(CAPTURE_COUNTS_SQL)
def capture_counts(spark, sf_dir):
    return audit.capture_counts(*_capture(spark, sf_dir))


CAPTURE_HISTOGRAMS_SQL = f"""{NORMAL_CTE}, s AS (SELECT *, snapshot_id::bigint AS i FROM env)
SELECT 'http_status' AS part, http_status::varchar AS member, count(*) AS records FROM s GROUP BY 2
UNION ALL SELECT 'error', 'schema_error', count(*) FROM s WHERE http_status = 200 AND contains(payload_json, 'unexpected')
UNION ALL SELECT 'origin', CASE WHEN i % 19 = 0 THEN 'synthetic_fixture' ELSE 'live' END, count(*) FROM s GROUP BY 2
UNION ALL SELECT 'resource', resource_type, count(*) FROM flat GROUP BY 2
UNION ALL SELECT 'time_issue', 'scheduled:date_missing', count(*) FROM flat WHERE resource_type = 'trip'
UNION ALL SELECT 'time_issue', 'estimated:missing', count(*) FROM flat WHERE est IS NULL"""


@query(CAPTURE_HISTOGRAMS_SQL)
def capture_histograms(spark, sf_dir):
    return audit.capture_histograms(*_capture(spark, sf_dir))


def _stored_capture(spark, sf_dir):
    """Envelopes as the ingest stores them, read back from their tables."""
    extra = view(spark, sf_dir, captures).select("snapshot_id", "origin", "cycle_id", "attempt_number")
    landed = view(spark, sf_dir, envelopes, parse_heavy=True).join(extra, "snapshot_id").withColumn(
        "request_started_at_utc", F.col("received_at_utc")).withColumns(
        {c: F.lit(None).cast("string") for c in ("parameters_json", "endpoint")})
    root = f"{ensure_checkpoint_dir(spark)}/capture-{uuid.uuid4().hex}"
    ingest.append_batch(landed, 0, root, "BLUE")
    parts = [read_capture(spark, root, "1900-01-01", "2200-01-01", origin=o) for o in ("live", "synthetic_fixture")]
    return tuple(a.unionByName(b) for a, b in zip(*parts))


@query(CAPTURE_COUNTS_SQL)
def stored_capture_counts(spark, sf_dir):
    return audit.capture_counts(*_stored_capture(spark, sf_dir))


@query(CAPTURE_HISTOGRAMS_SQL)
def stored_capture_histograms(spark, sf_dir):
    return audit.capture_histograms(*_stored_capture(spark, sf_dir))


@query(f"""WITH obs AS ({oracle(observations)}), c AS ({oracle(captures)})
SELECT o.snapshot_id FROM obs o ANTI JOIN (SELECT * FROM c WHERE origin = 'live') l USING (snapshot_id)""")
def orphan_observations(spark, sf_dir):
    live = view(spark, sf_dir, captures).where("origin = 'live'")
    return audit.orphan_observations(_observations(spark, sf_dir), live).select("snapshot_id")


@query(f"""WITH o AS (SELECT *, CASE WHEN snapshot_id::bigint % 4 = 0 THEN 'trip' ELSE 'stop' END AS r FROM ({oracle(observations)}) x),
t AS (SELECT DISTINCT trip_key, scheduled_stop_key FROM o WHERE r = 'trip'), s AS (SELECT DISTINCT trip_key, scheduled_stop_key FROM o WHERE r = 'stop'),
b AS (SELECT * FROM t INTERSECT SELECT * FROM s)
SELECT 'trip_endpoint_distinct_trips' AS metric, count(DISTINCT trip_key) AS value FROM t
UNION ALL SELECT 'trips_with_dated_event_match', count(DISTINCT trip_key) FROM b UNION ALL SELECT 'exact_event_matches', count(*) FROM b""")
def identity_overlap(spark, sf_dir):
    rows = _observations(spark, sf_dir).withColumn(
        "resource_type", F.expr("CASE WHEN cast(snapshot_id AS bigint) % 4 = 0 THEN 'trip' ELSE 'stop' END")
    )
    return audit.identity_overlap(rows)


ARRIVAL_CTE = f"""WITH obs AS (
  SELECT *, scheduled_departure_utc - interval 1 minute AS arr, CASE WHEN snapshot_id::bigint % 5 <> 0 THEN estimated_departure_utc - to_seconds(snapshot_id::bigint % 90 - 20) END AS earr
  FROM ({oracle(observations)}) o)"""


def _arrivals(spark, sf_dir):
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    number = F.col("snapshot_id").cast("bigint")
    early = F.timestamp_seconds(F.unix_seconds("estimated_departure_utc") - (number % 90 - 20))
    return _observations(spark, sf_dir).withColumns(
        {
            "scheduled_arrival_raw": iso(F.col("scheduled_departure_utc") - F.expr("interval 1 minute")),
            "estimated_arrival_raw": F.when(number % 5 != 0, iso(early)),
            "estimated_departure_raw": iso(F.col("estimated_departure_utc")),
        }
    )


@query(f"""{ARRIVAL_CTE} SELECT cast(arr - interval 6 hour AS date) AS day, count(*) AS snapshots, count(*) - count(earr) AS unusable_arrival_estimates,
count(earr) AS comparable_snapshots, count(*) FILTER (WHERE estimated_departure_utc <> earr) AS arrival_and_departure_differ,
count(*) FILTER (WHERE estimated_departure_utc < earr) AS negative_dwell_snapshots, max(epoch(estimated_departure_utc) - epoch(earr)) AS max_dwell_seconds,
count(DISTINCT (trip_key, scheduled_stop_key, arr)) AS events, count(DISTINCT trip_key) AS trips, count(DISTINCT stop_number) AS stops FROM obs GROUP BY day""")
def arrival_days(spark, sf_dir):
    return audit.arrival_days(_arrivals(spark, sf_dir))


@query(f"""{ARRIVAL_CTE}, asked AS (SELECT DISTINCT trip_key, scheduled_stop_key, arr, unnest({HORIZONS}) AS horizon_minutes FROM obs),
cur AS (SELECT a.*, o.snapshot_id, o.received_at_utc, o.cancelled, o.earr,
  row_number() OVER (PARTITION BY a.trip_key, a.scheduled_stop_key, a.arr, a.horizon_minutes ORDER BY o.received_at_utc DESC NULLS LAST, o.snapshot_id DESC) AS place
  FROM asked a LEFT JOIN obs o ON o.trip_key = a.trip_key AND o.scheduled_stop_key = a.scheduled_stop_key AND o.arr = a.arr
   AND o.received_at_utc <= a.arr - to_minutes(a.horizon_minutes))
SELECT cast(arr - interval 6 hour AS date) AS day, horizon_minutes, CASE WHEN snapshot_id IS NULL THEN 'no_snapshot_before_cutoff'
 WHEN epoch(arr) - horizon_minutes * 60 - epoch(received_at_utc) > {MAX_AGE} THEN 'snapshot_stale' WHEN cancelled THEN 'cancelled'
 WHEN earr IS NULL THEN 'arrival_estimate_missing_or_ambiguous' ELSE 'forecast_candidate' END AS outcome, count(*) AS events
FROM cur WHERE place = 1 GROUP BY ALL""")
def arrival_readiness(spark, sf_dir):
    return audit.arrival_horizon_counts(_arrivals(spark, sf_dir), HORIZONS, max_age_seconds=MAX_AGE)


@query(f"""WITH t AS ({oracle(local_times)}),
kinds AS (SELECT *, raw LIKE '____-__-__T%' AS dated, regexp_matches(raw, '(Z|-05:00)$') AS zoned, try_cast(left(raw, 19) AS timestamp) AS l FROM t),
utc AS (SELECT *, (l AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC' AS u FROM kinds),
back AS (SELECT *, (u AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS b,
  ((u + interval 1 hour) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS b1, ((u - interval 1 hour) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS b0 FROM utc),
judged AS (SELECT *, b <> l OR b1 = l OR b0 = l AS odd FROM back)
SELECT event_id, CASE WHEN NOT dated THEN NULL WHEN raw LIKE '%Z' THEN l WHEN zoned THEN l + interval 5 hour WHEN NOT odd THEN u END AS utc,
CASE WHEN raw = '' THEN 'missing' WHEN raw LIKE '__:__:__' THEN 'date_missing' WHEN NOT dated THEN 'invalid_time'
     WHEN NOT zoned AND odd THEN 'ambiguous_or_nonexistent_local_time' END AS issue FROM judged""")
def local_to_utc(spark, sf_dir):
    raw = F.col("raw")
    rows = view(spark, sf_dir, local_times, parse_heavy=True)
    return rows.select("event_id", instant_of(raw).cast("timestamp_ntz").alias("utc"), instant_issue(raw).alias("issue"))


@query(f"""{ASOF_CTE}, a AS (SELECT {EVENT_SQL}, snapshot_id AS v FROM current WHERE horizon_minutes = 60 AND snapshot_id IS NOT NULL),
b AS (SELECT {EVENT_SQL}, snapshot_id AS v FROM current WHERE horizon_minutes = 1440 AND snapshot_id IS NOT NULL)
SELECT CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'changed' END AS change,
count(*) AS groups FROM a FULL JOIN b USING ({EVENT_SQL}) GROUP BY 1""")
def build_comparison(spark, sf_dir):
    chosen = asof.select_at_horizons(_observations(spark, sf_dir), HORIZONS, MAX_AGE).select(
        *EVENT, "horizon_minutes", F.col("current.snapshot_id").alias("v")
    ).where("v is not null")
    return sets.compare_builds(chosen.where("horizon_minutes = 60"), chosen.where("horizon_minutes = 1440"), EVENT, ["v"])
