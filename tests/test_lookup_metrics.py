"""Median lookups, error metrics, exact quantiles, features, ranking, boosted trees."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from lagline.functions import quantiles
from lagline.functions.quantiles import exact_quantiles
from lagline.models import boosted, features, tuning
from lagline.operators import lookup, metrics, profile, sets
from tests.conftest import rows

KEYS = "stop_number string, destination string, day_type string, hour int"


def test_fallback_order(spark):
    train = spark.createDataFrame(
        [("A", "North", "Weekday", 8, 10), ("A", "North", "Weekday", 9, 30), ("B", "North", "Weekday", 8, 80),
         ("B", "North", "Weekday", 8, 120)], KEYS + ", delay_seconds bigint",
    )
    model = lookup.fit_lookup(train, 2)
    asked = spark.createDataFrame(
        [("A", "North", "Weekday", 8), ("B", "North", "Weekday", 8), ("C", "North", "Weekday", 9),
         ("C", "South", "Weekday", 9), ("A", "North", None, 8), (None, None, None, None)], KEYS,
    )
    for hot in (1, 5_000_000):
        out = {tuple(r[c] for c in lookup.FINEST): (r["prediction_seconds"], r["fallback_level"])
               for r in lookup.predict_lookup(asked, model, hot_rows=hot).collect()}
        assert out[("A", "North", "Weekday", 8)] == (20, "stop_number+destination+day_type")
        assert out[("B", "North", "Weekday", 8)] == (100, "stop_number+destination+day_type+hour")
        assert out[("C", "North", "Weekday", 9)] == (55, "destination+day_type")
        assert out[("C", "South", "Weekday", 9)] == (55, "global_median")
        assert out[("A", "North", None, 8)] == (20, "stop_number+destination")
        assert out[(None, None, None, None)] == (55, "global_median")


def test_null_keys_do_not_form_groups(spark):
    train = spark.createDataFrame([("A", None, "Weekday", 8, 10)] * 3, KEYS + ", delay_seconds bigint")
    assert rows(lookup.fit_lookup(train, 1), "level") == [("global_median",)]


def test_minimum_count_is_positive(spark):
    with pytest.raises(ValueError):
        lookup.fit_lookup(spark.createDataFrame([], KEYS + ", delay_seconds bigint"), 0)


@pytest.mark.parametrize("continuous", [True, False])
def test_metric_values(spark, continuous):
    df = spark.createDataFrame([(0.0, 0.0), (60.0, 0.0), (180.0, 0.0)], "a double, p double")
    row = metrics.error_metrics(df, [], "a", "p", continuous).first()
    assert (row["n"], row["mae_seconds"], row["median_absolute_error_seconds"]) == (3, 80, 60)
    assert abs(row["p90_absolute_error_seconds"] - 156) < 1e-9
    assert abs(row["within_60_seconds"] - 2 / 3) < 1e-12 and row["mean_signed_error_seconds"] == -80


def test_nonfinite_values_fail(spark):
    df = spark.createDataFrame([(0.0, float("nan"))], "a double, p double")
    with pytest.raises(Exception, match="finite"):
        metrics.error_metrics(df, [], "a", "p").collect()


def test_quantiles_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    data = [("a", float(v)) for v in draw.normal(0, 500, 501)] + [("b", float(v)) for v in draw.normal(0, 1, 40)]
    data += [("c", 7.0)] * 100 + [(None, 1.5), (None, 2.5)]
    df = spark.createDataFrame(data, "g string, v double")
    out = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"m": 0.5, "h": 0.9, "z": 0.0, "o": 1.0}).collect()}
    for g in ("a", "b", "c", None):
        values = [v for k, v in data if k == g]
        for name, q in (("m", 0.5), ("h", 0.9), ("z", 0), ("o", 1)):
            assert abs(out[g][name] - np.quantile(values, q)) < 1e-9


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_of_hot_groups_narrow_down(spark, monkeypatch, keys):
    """Equal values, spreads of hundreds of digits and one group with most rows: every interval shrinks until few values are left."""
    monkeypatch.setattr(quantiles, "ENOUGH", 5)
    monkeypatch.setattr(quantiles, "SPLITS", 8)
    draw = np.random.default_rng(5)
    data = [("a", float(v)) for v in draw.standard_normal(700)] + [("a", 0.25)] * 400 + [("b", v) for v in (-1e308, 1e308, 0.0, -0.0, 1e-300, 3.0)]
    data += [(None, 5.0)] * 40 + [("c", None), ("d", 2.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    out = {r["g"] if keys else "all": r for r in quantiles.exact_quantiles(df, keys, "v", {"m": 0.5, "h": 0.9, "z": 0.0, "o": 1.0}).collect()}
    groups = {k: [v for g, v in data if v is not None and (g == k or not keys)] for k in (("a", "b", None, "d") if keys else ("all",))}
    assert set(out) == set(groups)
    for g, values in groups.items():
        for name, q in (("m", 0.5), ("h", 0.9), ("z", 0), ("o", 1)):
            assert out[g][name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12), (g, name)
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_populations(spark):
    df = spark.createDataFrame(
        [("test", True, 10, 0.0), ("test", False, 100, 0.0)], "split string, baseline_eligible boolean, delay_seconds bigint, p double"
    )
    out = metrics.method_scores(df, {"m": "p"}, ["test"])
    assert rows(out, "population", "n", "mae_seconds") == [("all_valid", 2, 55.0), ("unflagged", 1, 10.0)]


def test_breakdown_keeps_null_members(spark):
    df = spark.createDataFrame([(None, 10, 0.0), ("N", 20, 0.0)], "destination string, delay_seconds bigint, p double")
    for continuous in (True, False):
        out = metrics.scores_by(df, {"destination": F.col("destination")}, {"m": "p"}, continuous=continuous)
        assert rows(out, "member", "mae_seconds") == [(None, 10.0), ("N", 20.0)]


def test_instants_become_local_features(spark):
    df = spark.createDataFrame([("A", None, "Weekday", datetime(2026, 8, 4, 1, 30, 30))],
                               "stop_number string, destination string, day_type string, t timestamp_ntz")
    instant = df.withColumn("scheduled_time_local", F.col("t").cast("timestamp"))
    row = features.with_features(instant).first()
    assert (row["f_day_of_week"], row["f_minute_of_day"], row["f_destination"]) == ("0", 1230.5, "__MISSING__")


def test_null_times_fail(spark):
    df = spark.createDataFrame([("A", "N", "W", None)], "stop_number string, destination string, day_type string, scheduled_time_local timestamp_ntz")
    with pytest.raises(Exception, match="valid scheduled time"):
        features.with_features(df).collect()


def test_ranking(spark):
    records = spark.createDataFrame(
        [("a", 1, 100, 10.0), ("a", 2, 200, 12.0), ("a", 3, 900, 11.0), ("b", 1, 1, 99.0)],
        "candidate string, fold int, tree_count int, mae_seconds double",
    )
    first = tuning.rank_candidates(records).first()
    assert (first["candidate"], first["mean_validation_mae_seconds"], first["final_tree_count"]) == ("a", 11.0, 200)


def plan(**changes):
    base = dict(
        train_start="2026-08-01", final_training_end_exclusive="2026-08-09", holdout_start="2026-08-09",
        holdout_end_exclusive="2026-08-11", folds=[tuning.Fold("2026-08-05", "2026-08-07"), tuning.Fold("2026-08-07", "2026-08-09")],
        candidates=[{"name": "reference"}, {"name": "other"}],
    )
    return tuning.Plan(**{**base, **changes})


def test_plan_validation():
    plan()
    with pytest.raises(ValueError):
        plan(holdout_start="2026-08-08")
    with pytest.raises(ValueError):
        plan(folds=[tuning.Fold("2026-08-05", "2026-08-08"), tuning.Fold("2026-08-07", "2026-08-09")])
    with pytest.raises(ValueError):
        plan(candidates=[{"name": "other"}])


def departures(spark, n=600):
    data = []
    for i in range(n):
        t = datetime(2026, 8, 1) + timedelta(minutes=24 * i)
        data.append((str(i), f"s{i % 3}", "North" if i % 2 else "South", "Weekday", t, t.hour, 60 * (i % 3) + t.hour, True, True))
    return spark.createDataFrame(
        data, "row_id string, stop_number string, destination string, day_type string, "
        "scheduled_time_local timestamp_ntz, hour int, delay_seconds bigint, baseline_eligible boolean, valid_required_fields boolean",
    ).repartition(2)


def test_folds_exclude_the_future(spark):
    train, validation = tuning.fold_rows(departures(spark), plan(), plan().folds[0])
    edge = datetime(2026, 8, 5)
    assert train.agg(F.max("scheduled_time_local")).first()[0] < edge
    assert validation.agg(F.min("scheduled_time_local")).first()[0] >= edge


def test_boosted_trees_learn_and_tune(spark):
    recipes = [boosted.Recipe("reference", 3, 3, learning_rate=0.5), boosted.Recipe("other", 2, 2, "native", 0.5)]
    ranking, holdout = boosted.tuned_holdout(departures(spark), plan(), recipes, minimum_count=5, allow_cap=True)
    assert {r["candidate"] for r in ranking.collect()} == {"reference", "other"}
    names = {"grouped": "prediction_grouped_median", "selected": "prediction_selected", "reference": "prediction_reference"}
    scored = metrics.long_predictions(holdout, ["delay_seconds"], names)
    out = {r["method"]: r for r in metrics.error_metrics(scored, ["method"], "delay_seconds", "prediction", True).collect()}
    assert all(r["n"] == 120 for r in out.values()) and out["selected"]["mae_seconds"] < 40


def test_boosting_goes_on_while_validation_improves(spark):
    rows_ = departures(spark, 300).withColumn("delay_seconds", F.expr("600 * int(substr(stop_number, 2)) + 40 * hour"))
    recipe = boosted.Recipe(depth=2, iterations=40, learning_rate=0.2, patience=5)
    model, records = boosted.select_depth(rows_, rows_, [recipe], allow_cap=True)
    alone = boosted.fit_trees(rows_, boosted.Recipe(depth=2, iterations=1))
    record = records.first()
    assert record["tree_count"] > 5 and record["mae_seconds"] < 0.8 * boosted._mae(boosted.score(alone, rows_))
    assert abs(record["mae_seconds"] - boosted._mae(boosted.score(model, rows_))) < 1e-6
    assert record["stopped_by"] == ("cap" if record["tree_count"] > 35 else "validation")
    assert boosted.best_size([5.0, 4.0, 4.5, 4.2, 3.9, 4.0, 4.0, 1.0], 2) == 2
    assert boosted.best_size([5.0, 4.0, 4.5, 4.2, 3.9, 4.0, 4.0, 1.0], 3) == 8


@pytest.mark.parametrize("stride, opening", [(1, 6), (4, 1), (16, 3)])
def test_boosting_from_stored_sums_grows_the_trees_of_one_fit(spark, monkeypatch, stride, opening):
    monkeypatch.setattr(boosted, "STRIDE", stride)
    rows_ = departures(spark, 300).withColumn("delay_seconds", F.expr("600 * int(substr(stop_number, 2)) + 40 * hour"))
    recipe = boosted.Recipe(depth=3, iterations=9, learning_rate=0.2)
    train = features.with_features(rows_)
    encoded = boosted.encoder(recipe).fit(train).transform(train).select(
        "features", (F.col("delay_seconds") / 1000.0).alias("label"), F.lit(False).alias("_holdout"))
    trees, errors = boosted.grow(encoded, recipe, recipe.max_bins, opening)
    whole = GBTRegressor(
        lossType="absolute", maxDepth=3, maxIter=9, stepSize=0.2, maxBins=recipe.max_bins, seed=recipe.seed).fit(encoded)
    assert len(trees) == 9 and errors == []
    assert [t.toDebugString.split("\n", 1)[1] for t in trees] == [t.toDebugString.split("\n", 1)[1] for t in whole.trees]
    alone = boosted._ensemble(trees, 0.2, 1.0).transform(encoded).select("prediction_boosted")
    assert [round(r[0], 9) for r in alone.collect()] == [round(r[0], 9) for r in whole.transform(encoded).select("prediction").collect()]


def test_scoring_reports_unseen_and_importance(spark):
    train = departures(spark, 200)
    model = boosted.fit_trees(train, boosted.Recipe(depth=3, iterations=2))
    asked = departures(spark, 3).withColumn("stop_number", F.lit("new"))
    out = boosted.score(model, asked)
    assert out.where("predicted_departure_local is null or prediction_boosted is null").count() == 0
    known = features.vocabulary(features.with_features(train))
    assert dict(rows(features.unseen_categories(features.with_features(asked), known)))["stop_number"] == 3
    weights = {r["feature"]: r["importance"] for r in boosted.feature_importance(model, train).collect()}
    assert set(weights) == set(features.FEATURES) and abs(sum(weights.values()) - 1) < 1e-9


def test_set_checks(spark):
    a = spark.createDataFrame([("1", 1), ("2", 2)], "row_id string, v int")
    b = spark.createDataFrame([("2", 2), ("3", 4)], "row_id string, v int")
    with pytest.raises(ValueError):
        sets.append_disjoint(a, b)
    assert sets.append_disjoint(a, b.where("v = 4")).count() == 3
    assert dict(rows(sets.compare_builds(a, b, ["row_id"], ["v"]))) == {"added": 1, "removed": 1, "unchanged": 1}
    assert sets.same_rows(a, a.select("v", "row_id")) and not sets.same_rows(a, b)


def test_order_breaks_across_blocks(spark):
    data = [(i, datetime(2026, 1, 1) + timedelta(minutes=i)) for i in range(1, 21)]
    df = spark.createDataFrame(data, "n bigint, t timestamp_ntz")
    assert profile.order_breaks(df, "t", "n", block=4).first()["is_sorted"]
    swapped = df.withColumn("t", F.when(F.col("n") == 8, F.lit("2025-12-31").cast("timestamp_ntz")).otherwise(F.col("t")))
    out = profile.order_breaks(swapped, "t", "n", block=4).first()
    assert out["backward_steps"] == 1 and not out["is_sorted"]


def test_order_breaks_over_gaps(spark):
    rows_ = [(0, datetime(2026, 1, 2)), (5_000_000, datetime(2026, 1, 1)), (9_000_000, datetime(2026, 1, 3))]
    out = profile.order_breaks(spark.createDataFrame(rows_, "n bigint, t timestamp_ntz"), "t", "n").first()
    assert out["backward_steps"] == 1 and not out["is_sorted"]


def test_report_summary_view(spark):
    data = [("a", "BLUE", "x", datetime(2026, 1, 31, 23, 59, 59), -97.0, 49.0, "South"),
            ("b", "", "y", datetime(2026, 2, 1), None, None, ""), ("c", "BLUE", "x", datetime(2026, 2, 1, 23, 59, 59), None, None, "South")]
    df = spark.createDataFrame(data, "rid string, route string, type string, reported timestamp_ntz, lon double, lat double, dest string")
    out = {(r["part"], r["member"]): r["records"] for r in profile.report_summary(df, "2026-01-01", "2026-03-31").collect()}
    assert [out[("month", m)] for m in ("2026-01", "2026-02", "2026-03")] == [1, 2, 0]
    assert (out[("hour", "23")], out[("hour", "00")], out[("weekday", "5")], out[("weekday", "6")]) == (2, 1, 1, 2)
    assert out[("missing_location", "all")] == 2 and out[("records", "all")] == 3
    assert profile.filter_reports(df, "2026-02-01", "2026-02-01").count() == 2
    assert rows(profile.filter_reports(df, "2026-01-01", "2026-02-28", route="", kind="y"), "rid") == [("b",)]
    assert rows(profile.filter_reports(df, "2026-01-01", "2026-02-28", query="SOUTH"), "rid") == [("a",), ("c",)]
    empty = {(r["part"], r["member"]): r["records"] for r in profile.report_summary(df.where("false"), "2025-12-31", "2026-01-01").collect()}
    assert (empty[("month", "2025-12")], empty[("month", "2026-01")], empty[("records", "all")]) == (0, 0, 0)


def test_boosting_rows_are_dealt_out_however_few_tasks_write_them(spark, monkeypatch):
    from lagline import staging

    monkeypatch.setattr(boosted, "FILE_ROWS", 10)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    seen, held = [], boosted.staged
    monkeypatch.setattr(boosted, "staged", lambda *a: seen.append(held(*a)) or seen[-1])
    monkeypatch.setattr(boosted, "release", lambda *a: 0)
    from pyspark.ml.linalg import Vectors

    rows_ = spark.createDataFrame([(Vectors.dense([float(i)]), float(i % 7), False) for i in range(200)], ["features", "label", "_holdout"]).coalesce(1)
    boosted.grow(rows_, boosted.Recipe(depth=1, iterations=1), 16)
    most = seen[0].groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    staging.release(spark)
    assert most <= 40  # a split takes four files at most
