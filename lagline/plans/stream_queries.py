"""Recorded captures and outcomes replayed through the streaming jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lagline.operators import link
from lagline.operators.asof import EVENT
from lagline.plans.adapter import linked_observations, outcomes, view
from lagline.plans.live_queries import ASOF_CTE, EVENT_SQL, HORIZONS, LAG, LINK_CTE, MAX_AGE, _observations
from lagline.plans.registry import query
from lagline.streaming.forecasts import horizon_forecasts
from lagline.streaming.outcomes import late_outcomes
from lagline.streaming.replay import replayed, row_of

END = "~end"  # key of the rows that close a replay


@query(f"""{ASOF_CTE} SELECT {EVENT_SQL}, horizon_minutes, c.reason, CASE WHEN c.reason IS NULL THEN c.snapshot_id END AS snapshot_id,
CASE WHEN c.reason IS NULL THEN c.estimated_delay_seconds END AS estimated_delay_seconds, r.revision_reason,
CASE WHEN c.reason IS NULL AND r.revision_reason IS NULL THEN r.estimated_delay_seconds - r.old_delay END AS revision_seconds
FROM current c LEFT JOIN revised r USING ({EVENT_SQL}, horizon_minutes)""")
def replayed_forecasts(spark, sf_dir):
    """Forecasts that the stateful stream emits over the recorded captures, over two restarts."""
    rows = _observations(spark, sf_dir).select(
        *EVENT, "scheduled_departure_utc", "received_at_utc", "snapshot_id", "cancelled", "estimated_delay_seconds", "bus_key")
    end = lambda n: row_of(
        rows, **dict.fromkeys(EVENT, END), scheduled_departure_utc=datetime(2124, 1, n), received_at_utc=datetime(2123, 1, n))
    found = replayed(
        spark, {"captures": (rows, "received_at_utc")}, lambda s: horizon_forecasts(s["captures"], HORIZONS, MAX_AGE, LAG),
        closing=[{"captures": end(1)}, {"captures": end(2)}])
    return found.where(F.col("trip_key") != END).withColumn("horizon_minutes", F.col("horizon_minutes").cast("int"))


@query(f"""{LINK_CTE}, keyed AS (
  SELECT row_id, deviation::double AS deviation, (route_number, stop_number, regexp_replace(trim(lower(route_destination)), '\\s+', ' ', 'g'),
          epoch(cast(replace(scheduled_time, 'Z', '') AS timestamp))) AS k FROM outs WHERE stop_number IS NOT NULL)
SELECT {EVENT_SQL}, CASE WHEN l.k IS NULL THEN 'invalid_live_identity' WHEN row_id IS NULL THEN 'no_exact_outcome' ELSE 'matched' END AS status,
  row_id, deviation FROM live l LEFT JOIN keyed USING (k)""")
def replayed_outcomes(spark, sf_dir):
    """Live events meeting the outcomes published a day after their schedule; unmatched ones leave with a status."""
    events = link.live_events(view(spark, sf_dir, linked_observations, parse_heavy=True)).select(
        *EVENT, *link.MATCH, F.coalesce(F.col("match_instant"), F.col("scheduled_departure_raw").try_cast("timestamp")).alias("landed_at"))
    measured = link.identified_outcomes(view(spark, sf_dir, outcomes, parse_heavy=True)).where(F.col("match_instant").isNotNull()).select(
        *link.MATCH, "row_id", F.col("deviation").cast("double").alias("deviation"), (F.col("match_instant") + F.expr("interval 1 day")).alias("landed_at"))
    end = lambda frame, name, n: row_of(
        frame, **dict.fromkeys(EVENT, END), **dict.fromkeys(link.MATCH[:3], name), match_instant=datetime(2124, 1, n))
    closing = [{"events": end(events, "event", n), "outcomes": end(measured, "outcome", n)} for n in (1, 8)]
    found = replayed(
        spark, {"events": (events, "landed_at"), "outcomes": (measured, "landed_at")},
        lambda s: late_outcomes(s["events"].drop("landed_at"), s["outcomes"].drop("landed_at"), "5 days"), closing=closing)
    return found.where(F.col("trip_key") != END).select(*EVENT, "status", "row_id", "deviation")
