"""Incident reports: scope rules, nearest same-day stop, and counts per timing group.

Typed reports: rid, type, route, dest, reported (wall time), lon, lat, record_no.
Visits: the output of `clean.clean_visits`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lagline.functions.geo import cell_of, explode_neighbour_cells, in_range, metres_between
from lagline.functions.skew import HOT_ROWS, attach_by_key
from lagline.operators.clean import GROUP, as_metrics, with_group
from lagline.staging import staged

FULL_BUS = "Full Bus Pass-Up"
STOP_MAX_METRES = 150
PROFILES = {"60m": 60, "100m": 100, "150m": 150}
PLACE = ["route", "dest", "day"]


def screen_reports(
    reports: DataFrame, covered_days: DataFrame, wanted_type: str = FULL_BUS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every report with the first rule it fails in `reject_reason`, null when kept.

    Order of rules: type, readable time, covered date, first occurrence of the id among those, then
    coordinates - so a bad first copy still blocks a good later one.
    """
    day = F.to_date("reported")
    # One row per calendar day: bounded by the length of the history.
    covered = covered_days.select(F.col("day").alias("day")).distinct().withColumn("_covered", F.lit(True))
    scoped = (
        reports.withColumn("day", day)
        .join(F.broadcast(covered), "day", "left")
        .withColumn("_in_scope", (F.col("type") == wanted_type) & F.coalesce("_covered", F.lit(False)))
    )
    repeats = (
        scoped.groupBy("rid")
        .agg(F.count(F.lit(1)).alias("_copies"), F.min(F.when(F.col("_in_scope"), F.col("record_no"))).alias("_first"))
        .where("_copies > 1")
    )
    reason = (
        F.when(~F.coalesce(F.col("type") == wanted_type, F.lit(False)), F.lit("other_type"))
        .when(F.col("reported").isNull(), F.lit("unreadable_time"))
        .when(F.col("_covered").isNull(), F.lit("outside_covered_dates"))
        .when(F.coalesce(F.col("record_no") > F.col("_first"), F.lit(False)), F.lit("duplicate_report"))
        .when(~in_range(F.col("lon"), F.col("lat")), F.lit("invalid_coordinates"))
    )
    return (
        attach_by_key(scoped, repeats, ["rid"], "_copies", hot_rows)
        .withColumn("reject_reason", reason)
        .drop("_covered", "_in_scope", "_first")
    )


def day_stops(visits: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Mean valid coordinate of each stop per route, destination and day.

    With `reports`, only on the days and directions that have one.
    """
    placed = visits.where(in_range(F.col("lon"), F.col("lat"))).groupBy(*PLACE, "stop").agg(
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat")
    )
    if reports is None:
        return placed
    # Semi join after the aggregate: same rows, and the smaller side moves.
    return placed.join(reports.select(*PLACE).distinct(), PLACE, "left_semi")


def nearest_stop(
    reports: DataFrame, stops: DataFrame, max_metres: float = STOP_MAX_METRES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Nearest stop of the report's own route, destination and day; the stop id breaks ties.

    Every stop within reach lies in one of at most nine cells around a report, so an
    equi-join on the cell finds the candidates. Both sides first collapse to distinct
    points, and the minimum combines before its shuffle, so neither a popular report
    place nor a popular stop place multiplies rows.
    """
    point = [*PLACE, "r_lon", "r_lat"]
    places = (
        reports.select(*PLACE, F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
        .groupBy(*point).agg(F.count(F.lit(1)).alias("here"))
    )
    sites = (
        stops.groupBy(*PLACE, "lon", "lat").agg(F.min("stop").alias("stop"))
        .withColumn("cell", cell_of(F.col("lon"), F.col("lat"), max_metres))
    )
    near = (
        explode_neighbour_cells(places, "r_lon", "r_lat", max_metres)
        .join(sites, [*PLACE, "cell"])
        .withColumn("metres", metres_between(F.col("r_lon"), F.col("r_lat"), F.col("lon"), F.col("lat")))
        .where(F.col("metres") <= max_metres)
        .groupBy(*point)
        .agg(F.min(F.struct("metres", "stop")).alias("_near"))
    )
    # Every place keeps its row count, also those out of reach: a popular one is hot either way.
    facts = places.join(near, point, "left").select(
        *PLACE, F.col("r_lon").alias("lon"), F.col("r_lat").alias("lat"), "here",
        F.col("_near.stop").alias("stop"), F.col("_near.metres").alias("metres"),
    )
    return attach_by_key(reports, facts, [*PLACE, "lon", "lat"], "here", hot_rows)


def matched_reports(
    reports: DataFrame, visits: DataFrame, max_metres: float = STOP_MAX_METRES
) -> DataFrame:
    """Kept reports with their nearest stop (null beyond reach) and report-time group.

    The kept reports are stored once: three steps read them, and screening them three
    times costs more than writing the few columns left.
    """
    kept = staged(reports.select("rid", "route", "dest", "reported", "day", "lon", "lat"))
    return with_group(nearest_stop(kept, day_stops(visits, kept), max_metres), "reported")


def report_profiles(matched: DataFrame, keys: list[str] = GROUP, profiles: dict[str, int] = PROFILES) -> DataFrame:
    """Reports and report dates per group under each distance limit."""
    daily = (
        matched.where(F.col("stop").isNotNull()).groupBy(*keys, "day")
        .agg(*[F.count_if(F.col("metres") <= limit).alias(name) for name, limit in profiles.items()])
    )
    columns = []
    for name in profiles:
        columns.append(F.sum(name).alias(f"reports_{name}"))
        columns.append(F.count_if(F.col(name) > 0).alias(f"dates_{name}"))
    widest = max(profiles, key=profiles.get)
    seen = F.when(F.col(widest) > 0, F.col("day"))
    return daily.groupBy(*keys).agg(
        *columns, F.min(seen).alias("coverage_start"), F.max(seen).alias("coverage_end")
    )


def match_audit(screened: DataFrame, matched: DataFrame, profiles: dict[str, int] = PROFILES) -> DataFrame:
    """Counts of every rule and of every distance profile as (metric, value) rows."""
    reason = F.col("reject_reason")
    counted = screened.agg(
        F.count(F.lit(1)).alias("sourceReports"),
        F.count_if(reason == "other_type").alias("nonFullBusReports"),
        F.count_if(reason == "outside_covered_dates").alias("outsideCoveredDates"),
        F.count_if(reason.isNull() | reason.isin("duplicate_report", "invalid_coordinates")).alias(
            "reportsOnCoveredDates"
        ),
        F.count_if(reason == "duplicate_report").alias("duplicateReports"),
        F.count_if(reason == "invalid_coordinates").alias("invalidCoordinates"),
    )
    placed = matched.agg(
        F.count_if(F.col("stop").isNull()).alias("noNearbyStop"),
        F.count("stop").alias("matchedReports"),
        *[F.count_if(F.col("metres") <= m).alias(f"{name}Reports") for name, m in profiles.items()],
    )
    return as_metrics(counted).unionByName(as_metrics(placed))
