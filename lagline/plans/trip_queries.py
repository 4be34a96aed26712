"""Captured trip responses: dated by anchors, compared with the trip's first, linked to outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline.operators import trips
from lagline.plans.adapter import linked_observations, linked_response_stops, linked_responses, observations, oracle, outcomes, view
from lagline.plans.live_queries import _ntz
from lagline.plans.registry import query
from lagline.plans.signal_queries import LINKED_OBS
from lagline.staging import staged

LOOK_BACK = 3
ANCHOR_MAX_AGE = 259200
# All times lie in January, six hours behind UTC. A trip's second target stop stands for the
# stop of its user, which outcomes name.
DATED_CTE = f"""WITH linked AS ({oracle(linked_observations)}), anchors AS (
  SELECT o.trip_key, o.scheduled_stop_key AS ev, o.bus_key AS bus, o.received_at_utc AS seen, epoch(o.scheduled_departure_utc)::bigint AS due,
         l.variant_name AS destination, row_number() OVER (PARTITION BY o.trip_key ORDER BY o.received_at_utc, o.snapshot_id) AS place
  FROM ({LINKED_OBS}) o JOIN linked l USING (snapshot_id)),
responses AS (SELECT * FROM ({oracle(linked_responses)}) r WHERE http_status = 200 AND error_kind IS NULL),
stops AS (
  SELECT s.snapshot_id, position, event_key, received_at_utc, payload_trip_key AS trip, payload_bus_key AS bus,
         split_part(scheduled_clock, ':', 1)::bigint * 3600 + split_part(scheduled_clock, ':', 2)::bigint * 60
           + split_part(scheduled_clock, ':', 3)::bigint AS v
  FROM ({oracle(linked_response_stops)}) s JOIN responses r USING (snapshot_id)),
falls AS (SELECT *, lag(v) OVER (PARTITION BY snapshot_id ORDER BY position) - v AS fall FROM stops),
shifted AS (SELECT *, v + 86400 * sum((coalesce(fall, 0) > 0)::int) OVER (PARTITION BY snapshot_id ORDER BY position) AS shift FROM falls),
whole AS (
  SELECT snapshot_id FROM shifted GROUP BY 1
  HAVING count(*) FILTER (WHERE fall > 0 AND fall < 43200) = 0 AND max(shift) - min(shift) <= 43200),
targets AS (SELECT snapshot_id, event_key AS ev, max(shift) AS at_target FROM shifted GROUP BY ALL HAVING count(*) = 1),
behind AS (
  SELECT r.snapshot_id, r.received_at_utc, r.payload_bus_key, a.*, row_number() OVER (PARTITION BY r.snapshot_id ORDER BY a.place DESC) AS back
  FROM responses r JOIN anchors a ON a.trip_key = r.payload_trip_key AND a.seen <= r.received_at_utc),
fitting AS (
  SELECT b.snapshot_id, b.place, b.destination, due - at_target AS base FROM behind b JOIN targets t USING (snapshot_id, ev) JOIN whole USING (snapshot_id)
  WHERE back <= {LOOK_BACK} AND b.bus = b.payload_bus_key AND epoch(received_at_utc) - epoch(seen) <= {ANCHOR_MAX_AGE}
    AND at_target % 86400 = (due - 21600) % 86400),
best AS (SELECT snapshot_id, max(place) AS place, arg_max(destination, place) AS destination, arg_max(base, place) AS base FROM fitting GROUP BY 1),
dated AS (SELECT s.*, b.place, b.destination, (base + shift)::bigint AS sched FROM shifted s JOIN best b USING (snapshot_id))
"""
TRIP_SQL = "trip_date, trip_key, bus_key"
CAPTURES_CTE = f"""{DATED_CTE}, named AS (
  SELECT *, make_timestamp((min(sched) OVER (PARTITION BY snapshot_id) - 21600) * 1000000)::date AS trip_date, trip AS trip_key, bus AS bus_key FROM dated),
listed AS (
  SELECT {TRIP_SQL}, snapshot_id, received_at_utc, list((position, event_key, sched) ORDER BY position) AS schedule FROM named GROUP BY ALL),
captures AS (
  SELECT * EXCLUDE (schedule), schedule <> first_value(schedule) OVER (PARTITION BY {TRIP_SQL} ORDER BY received_at_utc, snapshot_id) AS schedule_changed FROM listed)
"""


DATING = ["snapshot_id", "position", "event_key", "scheduled_clock"]  # what dating reads of a stop


def _heads(spark, sf_dir):
    return view(spark, sf_dir, linked_responses).where("http_status = 200 and error_kind is null").select("snapshot_id", *trips.HEADS)


def _stop_rows(spark, sf_dir):
    return view(spark, sf_dir, linked_response_stops, parse_heavy=True)


def _responses(spark, sf_dir):
    return trips.response_rows(_stop_rows(spark, sf_dir).select(*DATING), _heads(spark, sf_dir))


def _dated(spark, sf_dir, responses):
    keys = view(spark, sf_dir, linked_observations, parse_heavy=True).select("snapshot_id", "trip_key", "scheduled_stop_key", "variant_name")
    observed = view(spark, sf_dir, observations).drop("trip_key", "scheduled_stop_key", "variant_name").join(keys, "snapshot_id")
    anchors = trips.dated_anchors(observed.withColumn("destination", F.lit(None).cast("string")))
    return trips.dated_responses(responses, anchors, LOOK_BACK, ANCHOR_MAX_AGE)


@query(f"""{DATED_CTE} SELECT snapshot_id, position, event_key, make_timestamp(sched * 1000000) AS scheduled_utc, place, destination FROM dated""")
def anchored_trip_stops(spark, sf_dir):
    """Stops of every trip response, dated by the newest of the trip's last anchors that fits."""
    rows = trips.dated_stops(_dated(spark, sf_dir, _responses(spark, sf_dir))).select(
        "snapshot_id", "position", "event_key", "scheduled_utc", "anchor.place", F.col("anchor.anchor_destination").alias("destination"))
    return _ntz(rows, "scheduled_utc")


@query(f"""{DATED_CTE} SELECT snapshot_id, 'no_unambiguous_dated_anchor' AS reason FROM responses ANTI JOIN best USING (snapshot_id)""")
def undated_trip_responses(spark, sf_dir):
    """Responses that no anchor dates."""
    responses = _responses(spark, sf_dir)
    return trips.undated_responses(responses, _dated(spark, sf_dir, responses))


@query(f"{CAPTURES_CTE} SELECT * FROM captures")
def trip_captures(spark, sf_dir):
    """Dated responses by trip, marked where the schedule is not the one first captured."""
    named = trips.trip_identity(trips.dated_stops(_dated(spark, sf_dir, _responses(spark, sf_dir))))
    return _ntz(trips.consistent_captures(named), "received_at_utc")


@query(f"""{CAPTURES_CTE}, documents AS (
  SELECT n.{TRIP_SQL.replace(", ", ", n.")}, position, event_key, sched, arg_min(destination, (n.received_at_utc, n.snapshot_id)) AS destination,
         CASE WHEN position = 6 THEN regexp_extract(trip, '[0-9]+') ELSE 's' || position END AS stop_number
  FROM named n JOIN captures c USING (snapshot_id) WHERE NOT schedule_changed
  GROUP BY n.{TRIP_SQL.replace(", ", ", n.")}, position, event_key, sched, trip),
keyed AS (SELECT *, (stop_number, regexp_replace(trim(lower(destination)), '\\s+', ' ', 'g'), sched) AS k FROM documents),
sides AS (SELECT k, count(DISTINCT (trip_date, trip_key, event_key)) = 1 AS single FROM keyed GROUP BY 1),
measured AS (
  SELECT (stop_number, regexp_replace(trim(lower(route_destination)), '\\s+', ' ', 'g'), epoch(cast(replace(scheduled_time, 'Z', '') AS timestamp))::bigint) AS k,
         count(*) AS n, min(row_id) AS row_id, min(deviation::double) AS deviation
  FROM ({oracle(outcomes)}) o WHERE stop_number IS NOT NULL GROUP BY 1)
SELECT {TRIP_SQL}, position, event_key, make_timestamp(sched * 1000000) AS scheduled_utc, stop_number, destination,
  CASE WHEN n = 1 AND single THEN 'matched' WHEN n > 1 OR NOT single THEN 'ambiguous' ELSE 'unavailable' END AS match_status,
  CASE WHEN n = 1 AND single THEN row_id END AS outcome_row_id, CASE WHEN n = 1 AND single THEN -deviation END AS actual_delay_seconds
FROM keyed JOIN sides USING (k) LEFT JOIN measured USING (k)""")
def measured_trip_stops(spark, sf_dir):
    """Stops of every trip with an unchanged schedule and the one outcome of stop, destination and time."""
    text = lambda name: F.lit(None).cast("string").alias(name)
    place = F.col("position").cast("string")
    user = F.regexp_extract("payload_trip_key", "[0-9]+", 0)
    stops = _stop_rows(spark, sf_dir).join(_heads(spark, sf_dir), "snapshot_id").select(
        "*", F.when(F.col("position") == 6, user).otherwise(F.concat(F.lit("s"), place)).alias("stop_number"), text("stop_name"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), text("scheduled_arrival_clock"),
        text("estimated_arrival_clock"), text("schedule_type"), text("payload_variant_key"))
    named = staged(trips.trip_identity(trips.dated_stops(_dated(spark, sf_dir, trips.response_rows(stops)))))
    documents, _ = trips.trip_documents(named, trips.consistent_captures(named))
    measured = trips.measured_stops(documents, view(spark, sf_dir, outcomes, parse_heavy=True))
    return _ntz(measured, "scheduled_utc").select(
        *trips.TRIP, "position", "event_key", "scheduled_utc", "stop_number", "destination", "match_status", "outcome_row_id", "actual_delay_seconds")
