"""Report scope, nearest stops, profiles and categories."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lagline.functions.geo import cell_of, explode_neighbour_cells, metres_between
from lagline.operators import clean, policy, spatial
from tests.conftest import rows

VISITS = "route string, dest string, day date, stop string, lon double, lat double"
REPORTS = "rid string, type string, route string, dest string, reported timestamp_ntz, lon double, lat double, record_no bigint"
DAY = datetime(2026, 9, 25)


def visits(spark, *stops):
    return spark.createDataFrame([("F8", "downtown", DAY.date(), s, x, y) for s, x, y in stops], VISITS)


def report(rid, number=1, at=DAY.replace(hour=13), lon=-97.0, lat=49.0, kind=spatial.FULL_BUS):
    return (rid, kind, "F8", "downtown", at, lon, lat, number)


def reports(spark, *entries):
    return spark.createDataFrame(list(entries), REPORTS)


def kept(spark, data, stops, **options):
    screened = spatial.screen_reports(data, stops.select("day"), **options)
    return spatial.matched_reports(screened.where("reject_reason is null"), stops)


@pytest.mark.parametrize("hot_rows", [2, 5_000_000])
def test_repeated_ids_count_once(spark, hot_rows):
    stops = visits(spark, ("A", -97.0, 49.0))
    data = reports(spark, report("r1", 1), report("r2", 2), report("r1", 3))
    out = spatial.report_profiles(kept(spark, data, stops, hot_rows=hot_rows)).first()
    assert (out["stop"], out["daytype"], out["hour"]) == ("A", "weekday", 12)
    assert all(out[f"reports_{p}"] == 2 and out[f"dates_{p}"] == 1 for p in spatial.PROFILES)
    screened = spatial.screen_reports(data, stops.select("day"), hot_rows=hot_rows)
    assert rows(screened.where("reject_reason is not null"), "record_no", "reject_reason") == [(3, "duplicate_report")]


def test_bad_first_copy_blocks_a_later_one(spark):
    stops = visits(spark, ("A", -97.0, 49.0))
    data = reports(spark, report("r", 1, lon=500.0), report("r", 2))
    screened = spatial.screen_reports(data, stops.select("day"))
    assert rows(screened, "record_no", "reject_reason") == [(1, "invalid_coordinates"), (2, "duplicate_report")]


def test_scope_reasons(spark):
    stops = visits(spark, ("A", -97.0, 49.0))
    data = reports(
        spark, report("a", 1, kind="Wheelchair User Pass-Up"), report("b", 2, at=datetime(2020, 1, 1)),
        report("c", 3, lon=None),
    )
    assert rows(spatial.screen_reports(data, stops.select("day")), "reject_reason") == [
        ("invalid_coordinates",), ("other_type",), ("outside_covered_dates",)
    ]


def test_report_time_groups(spark):
    stops = visits(spark, ("A", -97.0, 49.0)).unionAll(
        visits(spark, ("A", -97.0, 49.0)).withColumn("day", F.date_add("day", 1))
    )
    at = [DAY.replace(hour=13, minute=59, second=59), DAY.replace(hour=14), DAY.replace(hour=23, minute=59, second=59),
          datetime(2026, 9, 26)]
    data = reports(spark, *[report(f"r{i}", i, at=t) for i, t in enumerate(at)])
    assert rows(kept(spark, data, stops), "rid", "daytype", "hour") == [
        ("r0", "weekday", 12), ("r1", "weekday", 14), ("r2", "weekday", 22), ("r3", "weekend", 0)
    ]


def test_distance_profiles(spark):
    stops = visits(spark, ("A", -97.0, 49.0))
    data = reports(spark, report("near", 1, lat=49.00063), report("far", 2, lat=49.002))
    matched = kept(spark, data, stops)
    assert rows(matched.where("stop is null"), "rid") == [("far",)]
    out = spatial.report_profiles(matched).first()
    assert (out["reports_60m"], out["reports_100m"], out["reports_150m"]) == (0, 1, 1)


def test_stop_id_breaks_ties(spark):
    stops = visits(spark, ("B", -97.0, 49.0), ("A", -97.0, 49.0))
    assert kept(spark, reports(spark, report("r")), stops).first()["stop"] == "A"


@pytest.mark.parametrize("lat,lon", [(49.8, -97.1), (0.0, 180.0), (89.9995, 10.0), (-89.999, 0.0), (60.0, -179.9999)])
def test_grid_finds_what_brute_force_finds(spark, lat, lon):
    """Cells must never hide a stop within reach, near poles and the date line too."""
    draw = random.Random(7)
    metre = 1 / 111194.9
    wide = metre / max(1e-3, math.cos(math.radians(lat)))
    around = lambda reach: (
        (lon + draw.uniform(-reach, reach) * wide + 180) % 360 - 180, max(-90.0, min(90.0, lat + draw.uniform(-reach, reach) * metre))
    )
    stops = visits(spark, *[(f"s{i}", *around(400)) for i in range(60)])
    data = reports(spark, *[report(f"r{i}", i, lon=x, lat=y) for i, (x, y) in enumerate(around(400) for _ in range(60))])
    found = {r["rid"]: (r["stop"], r["metres"]) for r in kept(spark, data, stops).collect()}
    pairs = data.alias("r").join(stops.alias("s"), "route").select(
        "rid", "stop", metres_between(F.col("r.lon"), F.col("r.lat"), F.col("s.lon"), F.col("s.lat")).alias("m")
    ).collect()
    for i in range(60):
        best = min((p["m"], p["stop"]) for p in pairs if p["rid"] == f"r{i}")
        assert found[f"r{i}"][0] == (best[1] if best[0] <= 150 else None)


def test_hot_places_take_the_other_join(spark):
    stops = visits(spark, ("A", -97.0, 49.0)).withColumn("day", F.lit(DAY.date()))
    data = reports(spark, *[report(f"r{i}", i) for i in range(6)], report("x", 9, lat=49.01)).withColumn(
        "day", F.to_date("reported")
    )
    for hot in (1, 3, 100):
        out = spatial.nearest_stop(data, spatial.day_stops(stops), hot_rows=hot)
        assert rows(out.where("stop = 'A'"), "rid") == [(f"r{i}",) for i in range(6)]
        assert out.count() == 7


def test_metres_per_degree(spark):
    d = spark.range(1).select(metres_between(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("m")).first()["m"]
    assert abs(d - 111194.93) < 0.01


@pytest.mark.parametrize("reports_n,dates,departures,label,reason", [
    (1, 1, 200, "low", "report_to_recorded_visit_ratio"), (2, 2, 200, "medium", "report_to_recorded_visit_ratio"),
    (4, 2, 200, "medium", "report_to_recorded_visit_ratio"), (5, 3, 200, "high", "report_to_recorded_visit_ratio"),
    (6, 3, 200, "high", "report_to_recorded_visit_ratio"), (6, 1, 200, "unknown", "insufficient_reporting_dates"),
    (2, 1, 200, "unknown", "insufficient_reporting_dates"), (5, 2, 200, "unknown", "insufficient_reporting_dates"),
    (0, 0, 119, "unknown", "insufficient_zero_report_history"), (0, 0, 120, "low", "report_to_recorded_visit_ratio"),
    (201, 9, 200, "unknown", "reports_exceed_recorded_visits"), (1, 1, 59, "unknown", "insufficient_reference_history"),
])
def test_policy_table(spark, reports_n, dates, departures, label, reason):
    df = spark.createDataFrame(
        [(reports_n, dates, departures, 20)],
        "report_count bigint, report_dates bigint, recorded_departures bigint, departure_dates bigint",
    )
    row = policy.classify(df).first()
    assert (row["label"], row["reason"]) == (label, reason)


def test_evidence_keeps_report_groups_of_known_routes(spark):
    key = "route string, stop string, dest string, daytype string, hour int"
    refs = spark.createDataFrame(
        [("F8", "A", "d", "weekday", 12, 10, 2, DAY.date(), DAY.date())],
        key + ", recorded_departures bigint, departure_dates bigint, reference_start date, reference_end date",
    )
    found = spark.createDataFrame(
        [("F8", "B", "d", "weekday", 12, 1, 1, 1, 1, 1, 1, DAY.date(), DAY.date()),
         ("X", "B", "d", "weekday", 12, 1, 1, 1, 1, 1, 1, DAY.date(), DAY.date())],
        key + ", " + ", ".join(f"{k}_{p} bigint" for p in spatial.PROFILES for k in ("reports", "dates"))
        + ", coverage_start date, coverage_end date",
    )
    out = policy.report_evidence(refs, found)
    assert rows(out, "route", "stop", "recorded_departures", "report_count") == [("F8", "A", 10, 0), ("F8", "B", 0, 1)]
    summary = dict(rows(policy.summarize_policy(policy.classify(out))))
    assert summary["groups"] == 2 and summary["groupsWithReportsWithoutReferenceDepartures"] == 1
