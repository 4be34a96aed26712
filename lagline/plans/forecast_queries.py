"""Queries over median lookups, error metrics, features and boosted trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline.models import boosted, features, tuning
from lagline.operators import lookup, metrics, sets
from lagline.plans.adapter import deliveries, oracle, rounded, view
from lagline.plans.history_queries import PREPARED_CTE, prepared
from lagline.plans.registry import query
from lagline.staging import staged

METRICS = [m for m in metrics.METRIC_COLUMNS if m != "n"]


def _lookup_cte(minimum: int) -> str:
    """Fit and fallback over a `prepared` relation, level by level."""
    keys = lookup.FINEST
    levels = []
    for level in lookup.LEVELS:
        columns = ", ".join(k if k in level else f"NULL AS {k}" for k in keys)
        filled = " AND ".join(f"{k} IS NOT NULL" for k in level)
        levels.append(
            f"SELECT '{lookup.level_name(level)}' AS level, {columns}, median(delay_seconds)::double AS median, "
            f"count(*) AS count FROM training WHERE {filled} GROUP BY {', '.join(level)} HAVING count(*) >= {minimum}"
        )
    levels.append(
        "SELECT 'global_median', NULL, NULL, NULL, NULL, median(delay_seconds)::double, count(*) FROM training"
    )
    joins, names, values = "", "", []
    for i, level in enumerate(lookup.LEVELS):
        on = " AND ".join(f"e.{k} = m{i}.{k}" for k in level)
        joins += f" LEFT JOIN model m{i} ON m{i}.level = '{lookup.level_name(level)}' AND {on}"
        names += f" WHEN m{i}.median IS NOT NULL THEN '{lookup.level_name(level)}'"
        values.append(f"m{i}.median")
    return f""", training AS (SELECT * FROM prepared WHERE split = 'train' AND baseline_eligible),
model AS ({" UNION ALL ".join(levels)}),
predicted AS (
  SELECT e.*, g.median AS prediction_global, 0.0::double AS prediction_on_time,
         coalesce({", ".join(values)}, g.median) AS prediction_seconds, CASE{names} ELSE 'global_median' END AS fallback_level
  FROM (SELECT * FROM prepared WHERE split IN ('validation', 'test') AND valid_required_fields) e
  JOIN model g ON g.level = 'global_median'{joins})
"""


MEASURES = """count(*) AS n, round(avg(abs(e)), 6) AS mae_seconds, round(sqrt(avg(e * e)), 6) AS rmse_seconds,
round(quantile_cont(abs(e), 0.5), 6) AS median_absolute_error_seconds,
round(quantile_cont(abs(e), 0.9), 6) AS p90_absolute_error_seconds, round(avg(e), 6) AS mean_signed_error_seconds,
round(avg((abs(e) <= 60)::int), 6) AS within_60_seconds, round(avg((abs(e) <= 120)::int), 6) AS within_120_seconds,
round(avg((abs(e) <= 180)::int), 6) AS within_180_seconds"""

SCORED = """, errors AS (
  SELECT split, destination, cast(scheduled_time_local AS date) AS date, population, method, prediction - delay_seconds::double AS e
  FROM (SELECT *, unnest(['scheduled_on_time', 'training_global_median', 'grouped_median']) AS method,
               unnest([prediction_on_time, prediction_global, prediction_seconds]) AS prediction FROM (
          SELECT *, 'all_valid' AS population FROM predicted
          UNION ALL SELECT *, 'unflagged' FROM predicted WHERE baseline_eligible) p) m)
"""
DELIVERY_CTE = f"WITH prepared AS ({oracle(deliveries)})"


def stored(spark, sf_dir):
    """Prepared departures as a stored table, which fitting and scoring both read."""
    return staged(prepared(spark, sf_dir))


def _scores(predicted):
    return rounded(lookup.baseline_scores(predicted), 6, *METRICS)


@query(f"{PREPARED_CTE}{_lookup_cte(20)} SELECT level, stop_number, destination, day_type, hour, median, count FROM model")
def lookup_fit(spark, sf_dir):
    return lookup.fit_lookup(lookup.training_rows(prepared(spark, sf_dir)))


@query(f"{PREPARED_CTE}{_lookup_cte(20)} SELECT row_id, split, prediction_seconds, prediction_global, fallback_level FROM predicted")
def lookup_predict(spark, sf_dir):
    return lookup.baseline_predictions(stored(spark, sf_dir)).select(
        "row_id", "split", "prediction_seconds", "prediction_global", "fallback_level"
    )


@query(f"{PREPARED_CTE}{_lookup_cte(20)}{SCORED} SELECT split, population, method, {MEASURES} FROM errors GROUP BY ALL")
def lookup_metrics(spark, sf_dir):
    return _scores(lookup.baseline_predictions(stored(spark, sf_dir)))


@query(f"""{PREPARED_CTE}{_lookup_cte(20)}{SCORED}
SELECT 'destination' AS dimension, destination AS member, method, {MEASURES} FROM errors
WHERE split = 'test' AND population = 'all_valid' AND method = 'grouped_median' GROUP BY destination, method
UNION ALL SELECT 'date', date::varchar, method, {MEASURES} FROM errors
WHERE split = 'test' AND population = 'all_valid' AND method = 'grouped_median' GROUP BY date, method""")
def lookup_breakdown(spark, sf_dir):
    scores = lookup.breakdown_scores(lookup.baseline_predictions(stored(spark, sf_dir)))
    return rounded(scores, 6, *METRICS)


@query(f"""{PREPARED_CTE}{_lookup_cte(20)}
SELECT split, 'all_valid' AS population, fallback_level, count(*) AS rows FROM predicted GROUP BY ALL
UNION ALL SELECT split, 'unflagged', fallback_level, count(*) FROM predicted WHERE baseline_eligible GROUP BY ALL""")
def fallback_usage(spark, sf_dir):
    return lookup.fallback_usage(lookup.baseline_predictions(stored(spark, sf_dir)))


@query(f"{DELIVERY_CTE}{_lookup_cte(20)} SELECT level, stop_number, destination, day_type, hour, median, count FROM model")
def delivery_lookup_fit(spark, sf_dir):
    return lookup.fit_lookup(lookup.training_rows(view(spark, sf_dir, deliveries)))


@query(f"{DELIVERY_CTE}{_lookup_cte(20)}{SCORED} SELECT split, population, method, {MEASURES} FROM errors GROUP BY ALL")
def delivery_lookup_metrics(spark, sf_dir):
    return _scores(lookup.baseline_predictions(view(spark, sf_dir, deliveries)))


@query(f"""{PREPARED_CTE} SELECT row_id, coalesce(stop_number, '__MISSING__') AS f_stop_number,
       coalesce(destination, '__MISSING__') AS f_destination, coalesce(day_type, '__MISSING__') AS f_day_type,
       (isodow(scheduled_time_local) - 1)::varchar AS f_day_of_week,
       round(hour(scheduled_time_local) * 60 + minute(scheduled_time_local) + second(scheduled_time_local) / 60.0::double, 6) AS f_minute_of_day
FROM prepared WHERE valid_required_fields""")
def feature_table(spark, sf_dir):
    rows = features.with_features(prepared(spark, sf_dir).where("valid_required_fields"))
    return rounded(rows.select("row_id", *[f"f_{c}" for c in features.FEATURES]), 6, "f_minute_of_day")


@query(f"""{PREPARED_CTE}, f AS (SELECT split, baseline_eligible, valid_required_fields, unnest(['stop_number', 'destination', 'day_type', 'day_of_week']) AS feature,
  unnest([coalesce(stop_number, '__MISSING__'), coalesce(destination, '__MISSING__'), coalesce(day_type, '__MISSING__'),
          (isodow(scheduled_time_local) - 1)::varchar]) AS category FROM prepared WHERE scheduled_time_local IS NOT NULL),
known AS (SELECT DISTINCT feature, category FROM f WHERE split = 'train' AND baseline_eligible)
SELECT feature, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.feature = f.feature AND k.category = f.category)) AS unseen_rows
FROM f WHERE split = 'test' AND valid_required_fields GROUP BY feature""")
def unseen_categories(spark, sf_dir):
    rows = stored(spark, sf_dir)
    train = features.with_features(lookup.training_rows(rows))
    test = features.with_features(rows.where("split = 'test' and valid_required_fields"))
    return features.unseen_categories(test, features.vocabulary(train))


@query(f"""{PREPARED_CTE} SELECT row_id FROM prepared WHERE split IN ('train', 'validation', 'test')
GROUP BY row_id HAVING count(DISTINCT split) > 1""")
def split_overlap(spark, sf_dir):
    return sets.split_overlap(prepared(spark, sf_dir))


FOLDS = [("2024-01-10", "2024-01-13"), ("2024-01-13", "2024-01-16"), ("2024-01-16", "2024-01-20")]
PLAN = tuning.Plan(
    "2024-01-03", "2024-01-20", "2024-01-20", "2024-01-29", [tuning.Fold(a, b) for a, b in FOLDS]
)


def _fold_record_sql(number: int, start: str, end: str) -> str:
    train = f"prepared WHERE baseline_eligible AND scheduled_time_local >= timestamp '2024-01-03' AND scheduled_time_local < timestamp '{start}'"
    rows = f"prepared WHERE valid_required_fields AND scheduled_time_local >= timestamp '{start}' AND scheduled_time_local < timestamp '{end}'"
    median = f"(SELECT median(delay_seconds)::double FROM {train})"
    by_stop = f"(SELECT stop_number, median(delay_seconds)::double AS m FROM {train} GROUP BY stop_number)"
    return f"""
SELECT 'on_time' AS candidate, {number} AS fold, 1 AS tree_count, avg(abs(delay_seconds))::double AS mae_seconds FROM {rows}
UNION ALL SELECT 'reference', {number}, 2, avg(abs(delay_seconds - {median})) FROM {rows}
UNION ALL SELECT 'by_stop', {number}, 3 + {number}, avg(abs(p.delay_seconds - coalesce(m, {median}))) FROM (SELECT * FROM {rows}) p LEFT JOIN {by_stop} s USING (stop_number)"""


RECORDS_CTE = f"""{PREPARED_CTE}, records AS ({" UNION ALL ".join(_fold_record_sql(i, *f) for i, f in enumerate(FOLDS, 1))})"""


@query(f"""{RECORDS_CTE}
SELECT candidate, round(avg(mae_seconds), 6) AS mean_validation_mae_seconds, floor(median(tree_count))::bigint AS final_tree_count,
       count(*) AS folds FROM records GROUP BY candidate""")
def candidate_rank(spark, sf_dir):
    """Rolling-origin folds scored with three lookup candidates, then ranked."""
    return rounded(tuning.rank_candidates(_fold_records(spark, sf_dir)), 6, "mean_validation_mae_seconds")


def _fold_records(spark, sf_dir):
    rows = stored(spark, sf_dir)
    records = None
    for number, fold in enumerate(PLAN.folds, 1):
        train, validation = tuning.fold_rows(rows, PLAN, fold)
        model = staged(lookup.fit_lookup(train, 1, levels=[["stop_number"]]))
        scored = lookup.predict_lookup(validation, model, levels=[["stop_number"]])
        error = lambda c: F.avg(F.abs(F.col(c) - F.col("delay_seconds")))
        wide = scored.agg(
            error("prediction_on_time").alias("on_time"), error("prediction_global").alias("reference"),
            error("prediction_seconds").alias("by_stop"),
        )
        sizes = F.create_map(
            F.lit("on_time"), F.lit(1), F.lit("reference"), F.lit(2), F.lit("by_stop"), F.lit(3 + number)
        )
        part = wide.unpivot([], wide.columns, "candidate", "mae_seconds").select(
            "candidate", F.lit(number).alias("fold"), sizes[F.col("candidate")].alias("tree_count"), "mae_seconds"
        )
        records = part if records is None else records.unionByName(part)
    return records


@query(f"""{RECORDS_CTE}
SELECT fold, arg_min(candidate, (mae_seconds, candidate)) AS candidate, round(min(mae_seconds), 6) AS mae_seconds FROM records GROUP BY fold""")
def best_candidates(spark, sf_dir):
    """The candidate with the lowest error of every fold; of equal ones the first by name."""
    return rounded(tuning.best_candidate(_fold_records(spark, sf_dir), by=["fold"]), 6, "mae_seconds")


@query()
def boosted_scores(spark, sf_dir):
    """Boosted trees against the schedule and the lookups on the test split."""
    rows = stored(spark, sf_dir)
    train = lookup.training_rows(rows)
    recipes = [boosted.Recipe("depth4", 4), boosted.Recipe("depth6", 6)]
    model, _ = boosted.select_depth(train, rows.where("split = 'validation' and valid_required_fields"), recipes)
    scored = boosted.score(model, lookup.baseline_predictions(rows))
    methods = {**lookup.METHODS, "boosted_trees": "prediction_boosted"}
    return metrics.method_scores(scored, methods, ["validation", "test"], continuous=True)
