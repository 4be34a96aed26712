"""Error metrics of predictions against observed delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lagline.functions.quantiles import exact_quantiles
from lagline.staging import staged

METRIC_COLUMNS = [
    "n", "mae_seconds", "rmse_seconds", "median_absolute_error_seconds", "p90_absolute_error_seconds",
    "mean_signed_error_seconds", "within_60_seconds", "within_120_seconds", "within_180_seconds",
]


def finite(value: Column, message: str = "Metrics require finite observations and predictions.") -> Column:
    """The value itself; a null, NaN or infinity fails the query."""
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(number)


def error_metrics(
    rows: DataFrame, keys: list[str], actual: str, predicted: str, continuous: bool = False
) -> DataFrame:
    """One metric row per key tuple.

    Median-type predictions give half-second errors, so equal errors are counted
    before any group comes together. With `continuous` predictions nothing repeats;
    their quantiles come from a search by repeated splitting instead.
    """
    error = (finite(F.col(predicted)) - finite(F.col(actual))).alias("_e")
    if continuous:
        return _continuous_metrics(rows.select(*keys, error), keys)
    counted = rows.select(*keys, error).groupBy(*keys, "_e").agg(F.count(F.lit(1)).alias("_w"))
    return weighted_metrics(counted, keys)


def weighted_metrics(counted: DataFrame, keys: list[str], error: str = "_e", weight: str = "_w") -> DataFrame:
    """Metrics of (keys, error, weight) rows, each standing for `weight` equal errors."""
    e, w = F.col(error), F.col(weight)
    n = F.sum(w)
    spread = F.percentile(F.abs(e), F.array(F.lit(0.5), F.lit(0.9)), w)
    return (
        counted.groupBy(*keys)
        .agg(*_moments(e, w, n), spread.alias("_q"))
        .withColumns(
            {"median_absolute_error_seconds": F.col("_q")[0], "p90_absolute_error_seconds": F.col("_q")[1]}
        )
        .select(*keys, *METRIC_COLUMNS)
    )


def _moments(e: Column, w: Column, n: Column) -> list[Column]:
    return [
        n.alias("n"),
        (F.sum(w * F.abs(e)) / n).alias("mae_seconds"),
        F.sqrt(F.sum(w * e * e) / n).alias("rmse_seconds"),
        (F.sum(w * e) / n).alias("mean_signed_error_seconds"),
        *[
            (F.sum(F.when(F.abs(e) <= limit, w).otherwise(0)) / n).alias(f"within_{limit}_seconds")
            for limit in (60, 120, 180)
        ],
    ]


def _continuous_metrics(errors: DataFrame, keys: list[str]) -> DataFrame:
    one, errors = F.lit(1), staged(errors, "errors")  # read once, however often the rows are costly to make
    moments = errors.groupBy(*keys).agg(*_moments(F.col("_e"), one, F.count(one)))
    quantiles = exact_quantiles(
        errors.withColumn("_a", F.abs("_e")), keys, "_a",
        {"median_absolute_error_seconds": 0.5, "p90_absolute_error_seconds": 0.9},
    )
    named = quantiles.withColumnsRenamed({k: f"_q_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_q_{k}"))
    return moments.join(named, condition).select(*keys, *METRIC_COLUMNS)


def with_population(rows: DataFrame, eligible: str = "baseline_eligible") -> DataFrame:
    """Tag rows for both evaluation populations: all valid rows, and the unflagged ones."""
    tags = F.array(F.lit("all_valid"), F.when(F.col(eligible), F.lit("unflagged")))
    return rows.withColumn("population", F.explode(F.array_compact(tags)))


def long_predictions(rows: DataFrame, keep: list[str], methods: dict[str, str]) -> DataFrame:
    """(keep..., method, prediction) rows from one column per method."""
    wide = rows.select(*keep, *[F.col(c).cast("double").alias(name) for name, c in methods.items()])
    return wide.unpivot(keep, list(methods), "method", "prediction")


def method_scores(
    predicted: DataFrame, methods: dict[str, str], splits: list[str], actual: str = "delay_seconds",
    continuous: bool = False,
) -> DataFrame:
    """Metrics by split, population and method on identical rows."""
    rows = predicted.where(F.col("split").isin(splits))
    keep = ["split", "baseline_eligible", actual]
    keys = ["split", "population", "method"]
    if continuous:
        long = long_predictions(rows, keep, methods)
        return error_metrics(with_population(long), keys, actual, "prediction", continuous=True)
    # Equal outcomes and predictions collapse first; methods and populations then copy
    # counts, not rows.
    counted = rows.groupBy(*keep, *methods.values()).agg(F.count(F.lit(1)).alias("_w"))
    long = long_predictions(counted, [*keep, "_w"], methods)
    error = finite(F.col("prediction")) - finite(F.col(actual))
    return weighted_metrics(with_population(long.withColumn("_e", error)), keys)


def scores_by(
    predicted: DataFrame, by: dict[str, Column], methods: dict[str, str], actual: str = "delay_seconds",
    continuous: bool = False,
) -> DataFrame:
    """Metrics per method along each listed dimension (for example destination, date).

    Output: dimension, member, method and the metrics; a null member stays a member.
    """
    named = predicted.select(actual, *methods.values(), *[c.alias(f"_by_{n}") for n, c in by.items()])
    dims = [f"_by_{n}" for n in by]
    keys = ["dimension", "member", "method"]
    if continuous:
        tagged = _tag_members(long_predictions(named, [actual, *dims], methods), by)
        return error_metrics(tagged, keys, actual, "prediction", continuous=True)
    counted = named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("_w"))
    long = long_predictions(counted, [actual, *dims, "_w"], methods)
    error = finite(F.col("prediction")) - finite(F.col(actual))
    return weighted_metrics(_tag_members(long.withColumn("_e", error), by), keys)


def _tag_members(rows: DataFrame, by: dict[str, Column]) -> DataFrame:
    members = F.array(
        *[F.struct(F.lit(n).alias("dimension"), F.col(f"_by_{n}").cast("string").alias("member")) for n in by]
    )
    return rows.withColumn("_m", F.explode(members)).select("*", "_m.*").drop("_m", *[f"_by_{n}" for n in by])
