"""Committed builds: digests, halfway builds, changed files."""

from datetime import date, datetime
import os

import pytest
from pyspark.sql import functions as F

from lagline.plans.lookup_build import build_lookup
from lagline.sinks import builds
from lagline.sinks.tables import verify_metric
from tests.conftest import rows

SCHEMA = "a string, b string, x double, d date, t timestamp, m map<string,int>, l array<double>"
DATA = [("p", None, 0.1, date(2026, 1, 1), datetime(2026, 1, 1, 5, 6, 7, 891234), {"k": 1, "j": 2}, [1.0, None]),
        (None, "p", None, None, None, None, None), ("p", "q", float("nan"), date(1999, 1, 1), None, {}, []),
        ("p", "q", float("nan"), date(1999, 1, 1), None, {}, [])]


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_a_build_is_read_as_written(spark, folder, format):
    frame = spark.createDataFrame(DATA, SCHEMA)
    if format == "json":
        frame = frame.drop("t")  # texts of times end at milliseconds
    build = builds.Build(spark, f"{folder}/out")
    stored = build.write("all", frame, format, partition_by=["d"], facts={"first": F.min("d"), "named": F.count("a")})
    build.write("none", frame.where("false"))
    assert stored.columns == frame.columns
    with pytest.raises(ValueError, match="no committed build"):
        builds.read_table(spark, f"{folder}/out", "all")
    with pytest.raises(ValueError, match="already part"):
        build.write("all", frame)
    build.commit(coverage=["1999-01-01", "2026-01-01"])
    with pytest.raises(ValueError, match="holds a committed build"):
        build.commit()
    stated = builds.committed(spark, f"{folder}/out")
    assert stated["coverage"][0] == "1999-01-01" and stated["tables"]["all"]["facts"] == {"first": "1999-01-01", "named": 3}
    assert rows(builds.verify_build(spark, f"{folder}/out")) == [("all", 4, 4, True), ("none", 0, 0, True)]
    builds.require_as_written(spark, f"{folder}/out")
    assert rows(builds.read_table(spark, f"{folder}/out", "all"), "a", "b", "d") == rows(frame, "a", "b", "d")


def test_changed_rows_show(spark, folder):
    build = builds.Build(spark, f"{folder}/out")
    build.write("t", spark.range(100).withColumn("v", F.col("id") % 7))
    build.commit()
    spark.range(1).withColumn("v", F.lit(3).cast("bigint")).write.mode("append").parquet(f"{folder}/out/t")
    assert rows(builds.verify_build(spark, f"{folder}/out")) == [("t", 100, 101, False)]
    with pytest.raises(ValueError, match="differ"):
        builds.require_as_written(spark, f"{folder}/out")


def test_digest_tells_tables_apart(spark):
    take = lambda frame: tuple(frame.agg(*[v.alias(k) for k, v in builds.digest(frame).items()]).first())
    make = lambda *data: spark.createDataFrame(data, "a string, b string")
    base = take(make(("x", None), ("y", "z")))
    assert base == take(make(("y", "z"), ("x", None)).select("b", "a"))
    assert len({base, take(make((None, "x"), ("y", "z"))), take(make(("x", None), ("y", "z"), ("y", "z"))), take(make(("x", None)))}) == 4
    assert take(make(("x", "y")).where("false")) == (0, 0)


def test_lookup_job_needs_training_before_evaluation(spark, folder):
    columns = ("row_id string, stop_number string, destination string, day_type string, hour int, delay_seconds bigint, "
               "scheduled_time_local timestamp_ntz, baseline_eligible boolean, valid_required_fields boolean, flag_invalid_location boolean, split string")
    row = lambda i, split, day, delay=60: (f"r{i}", "1", "d", "Weekday", 8, delay, datetime(2026, 1, day, 8), True, True, i == 0, split)
    data = [row(i, "train", 1 + i) for i in range(4)] + [row(8, "validation", 10, 90), row(9, "test", 12, 180)]
    out = build_lookup(spark.createDataFrame(data, columns), f"{folder}/good", minimum_count=2)
    assert builds.committed(spark, f"{folder}/good")["testMae"] == 120.0
    assert rows(out["predictions"], "row_id", "prediction_seconds") == [("r8", 60.0), ("r9", 60.0)] and out["review"].count() == 1
    with pytest.raises(ValueError, match="training and evaluation"):
        build_lookup(spark.createDataFrame([*data, row(7, "train", 11)], columns), f"{folder}/bad", minimum_count=2)
    assert builds.committed(spark, f"{folder}/bad") is None


def test_a_reported_error_is_checked_by_one_aggregate(spark):
    frame = spark.createDataFrame([(1.0, 61.0), (2.0, 2.0), (-5.0, 25.0)], "y double, p double")
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    verify_metric(frame, "y", "p", 30.0)
    # The quantiles that came with it took a round of jobs for every narrowing.
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before <= 2
    for bad in (30.1, None):
        with pytest.raises(ValueError, match="reported"):
            verify_metric(frame, "y", "p", bad)
    with pytest.raises(Exception, match="finite"):
        verify_metric(spark.createDataFrame([(1.0, float("nan"))], "y double, p double"), "y", "p", 0.0)
