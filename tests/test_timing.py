"""Bins, timing groups and intervals."""

import math
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from lagline.functions.clock import window_start_hour
from lagline.operators import timing


def test_two_hour_bins(spark):
    clocks = ["16:00", "16:40", "17:59", "18:00", "00:30", "23:59"]
    df = spark.createDataFrame([(i, f"2026-01-05 {c}:00") for i, c in enumerate(clocks)], "i int, t string")
    out = df.select("i", window_start_hour(F.col("t").cast("timestamp_ntz")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in out] == [16, 16, 16, 18, 0, 22]


def visits(spark, days, per_day, group="all"):
    data = [(group, date(2026, 1, 5) + timedelta(days=d), x) for d in range(days) for x in per_day]
    return spark.createDataFrame(data, "g string, day date, delay bigint")


DELAYS = [-3601, -3600, -61, -60, -1, 0, 300, 301, 3600, 3601]


def test_thresholds_and_intervals(spark):
    row = timing.timing_groups(visits(spark, 6, DELAYS), ["g"]).first()
    assert (row["observations"], row["distinct_dates"], row["median_seconds"]) == (48, 6, -0.5)
    assert (row["early_share"], row["within_share"], row["late_share"]) == (0.25, 0.5, 0.25)
    assert row["before_schedule_share"] == 0.5
    assert [row[f"{c}_{e}"] for c in timing.CATEGORIES for e in ("low", "high")] == [.25, .25, .5, .5, .25, .25]


def test_gates(spark):
    keep = visits(spark, 5, [0] * 6, "minimum")
    few_dates = visits(spark, 4, [0] * 10, "dates")
    few_visits = visits(spark, 5, [0] * 6, "visits").limit(29)
    out = timing.timing_groups(keep.union(few_dates).union(few_visits), ["g"])
    assert [r["g"] for r in out.collect()] == ["minimum"]


def test_interval_formula_against_residuals(spark):
    totals = [4, 8, 3, 6, 9]
    parts = {"early": [1, 0, 2, 1, 6], "within": [2, 8, 0, 4, 2], "late": [1, 0, 1, 1, 1]}
    delay = {"early": -100, "within": 0, "late": 400}
    data = []
    for d in range(5):
        for name, counts in parts.items():
            data += [("g", date(2026, 1, 5) + timedelta(days=d), delay[name])] * counts[d]
    df = spark.createDataFrame(data, "g string, day date, delay bigint")
    row = timing.timing_groups(df, ["g"], min_observations=1, min_dates=1).first()
    for name, counts in parts.items():
        share = sum(counts) / sum(totals)
        variance = 5 / 4 * sum((c - share * n) ** 2 for c, n in zip(counts, totals)) / sum(totals) ** 2
        margin = 1.96 * math.sqrt(variance)
        assert row[f"{name}_low"] == round(max(0, share - margin), 4)
        assert row[f"{name}_high"] == round(min(1, share + margin), 4)


def test_report_counts_join_on(spark):
    reports = spark.createDataFrame([("all", 3)], "g string, reports_100m bigint")
    assert timing.timing_groups(visits(spark, 6, DELAYS), ["g"], reports=reports).first()["nearby_reports"] == 3
    none = reports.where("g = 'x'")
    assert timing.timing_groups(visits(spark, 6, DELAYS), ["g"], reports=none).first()["nearby_reports"] == 0


def test_exposure_keeps_late_visits(spark):
    row = timing.reference_exposure(visits(spark, 2, DELAYS), ["g"]).first()
    assert (row["recorded_departures"], row["departure_dates"]) == (20, 2)
