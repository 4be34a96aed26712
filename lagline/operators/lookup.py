"""Training-only median lookups with explicit fallback, and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lagline.functions.skew import HOT_ROWS, attach_by_key
from lagline.operators.metrics import method_scores, scores_by, with_population
from lagline.staging import staged

FINEST = ["stop_number", "destination", "day_type", "hour"]
# The fallback order, finest first.
LEVELS = [
    ["stop_number", "destination", "day_type", "hour"],
    ["stop_number", "destination", "day_type"],
    ["stop_number", "destination"],
    ["destination", "day_type", "hour"],
    ["destination", "day_type"],
    ["destination"],
]
GLOBAL_LEVEL = "global_median"
METHODS = {
    "scheduled_on_time": "prediction_on_time",
    "training_global_median": "prediction_global",
    "grouped_median": "prediction_seconds",
}


def level_name(keys: list[str]) -> str:
    return "+".join(keys) if keys else GLOBAL_LEVEL


def fit_lookup(
    training: DataFrame, minimum_count: int = 20, value: str = "delay_seconds", levels: list[list[str]] = LEVELS
) -> DataFrame:
    """Long lookup table (level, keys..., median, count); level 'global_median' has no keys.

    Rows first collapse to counts per finest key and value. Only those counts pass
    through the grouping sets, whose expansion would otherwise copy every row.
    """
    if minimum_count < 1:
        raise ValueError("minimum_count has to be 1 or more")
    keys = levels[0]
    counted = (
        training.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    sets = [*[[F.col(k) for k in level] for level in levels], []]
    grouped = counted.groupingSets(sets, *keys).agg(
        F.percentile("_value", F.lit(0.5), F.col("_n")).alias("median"),
        F.sum("_n").alias("count"),
        F.grouping_id().alias("_set"),
    )
    # grouping_id sets one bit per rolled-up key, first key highest.
    codes = {
        sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in level): level
        for level in [*levels, []]
    }
    name = F.lit(None).cast("string")
    usable = F.lit(False)
    for code, level in codes.items():
        here = F.col("_set") == code
        name = F.when(here, F.lit(level_name(level))).otherwise(name)
        complete = F.lit(True)
        for k in level:
            complete = complete & F.col(k).isNotNull()
        enough = (F.col("count") >= minimum_count) if level else F.lit(True)
        usable = F.when(here, complete & enough).otherwise(usable)
    return grouped.where(usable).select(name.alias("level"), *keys, "median", "count")


def predict_lookup(
    rows: DataFrame, model: DataFrame, levels: list[list[str]] = LEVELS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add `prediction_seconds`, `fallback_level`, `prediction_global`, `prediction_on_time`.

    The cascade runs over the distinct key tuples of the rows, not over the rows, and
    one join carries the answer back. Null keys match no level that contains them.
    """
    keys = levels[0]
    tuples = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    asked = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"), F.lit(level_name(level)).alias("level"),
                *[(F.col(k) if k in level else F.lit(None).cast(tuples.schema[k].dataType)).alias(k) for k in keys],
            )
            for i, level in enumerate(levels)
        ]
    )
    tables = model.where(F.col("level") != GLOBAL_LEVEL).select(
        F.col("level").alias("_level"), *[F.col(k).alias(f"_m_{k}") for k in keys], "median"
    )
    fits = F.col("_ask.level") == F.col("_level")
    for k in keys:
        fits = fits & F.col(f"_ask.{k}").eqNullSafe(F.col(f"_m_{k}"))
    # Keys a level leaves out are null on both sides; a null it needs is absent from
    # the table, so it finds nothing.
    found = (
        tuples.withColumn("_ask", F.explode(asked)).join(tables, fits, "left")
        .groupBy(*keys)
        .agg(
            F.first("_n").alias("_n"),
            F.min(F.when(F.col("median").isNotNull(), F.struct("_ask.rank", "median", "_ask.level"))).alias("_best"),
        )
        .select(
            *keys, "_n", F.col("_best.median").alias("_found"),
            F.coalesce("_best.level", F.lit(GLOBAL_LEVEL)).alias("fallback_level"),
        )
    )
    global_median = model.where(F.col("level") == GLOBAL_LEVEL).select("median").scalar()
    return (
        attach_by_key(rows, found, keys, "_n", hot_rows)
        .withColumn("prediction_global", global_median)
        .withColumn("prediction_seconds", F.coalesce("_found", "prediction_global"))
        .withColumn("prediction_on_time", F.lit(0.0))
        .drop("_found")
    )


def training_rows(prepared: DataFrame) -> DataFrame:
    return prepared.where((F.col("split") == "train") & F.col("baseline_eligible"))


def evaluation_rows(prepared: DataFrame) -> DataFrame:
    return prepared.where(F.col("split").isin("validation", "test") & F.col("valid_required_fields"))


def check_chronology(prepared: DataFrame) -> None:
    """Both evaluation splits must exist and start after all training rows."""
    facts = prepared.agg(
        F.max(F.when((F.col("split") == "train") & F.col("baseline_eligible"), F.col("scheduled_time_local"))).alias("t"),
        *[
            F.min(F.when((F.col("split") == s) & F.col("valid_required_fields"), F.col("scheduled_time_local"))).alias(s)
            for s in ("validation", "test")
        ],
    ).first()
    if facts["t"] is None:
        raise ValueError("there is nothing to train on")
    if facts["validation"] is None or facts["test"] is None:
        raise ValueError("validation or test rows are missing")
    if not facts["t"] < min(facts["validation"], facts["test"]):
        raise ValueError("some dates are in training and evaluation")


def baseline_predictions(prepared: DataFrame, minimum_count: int = 20) -> DataFrame:
    """Fit on eligible training rows, score validation and test rows.

    The fitted table is stored: every level of the fallback reads it.
    """
    model = staged(fit_lookup(training_rows(prepared), minimum_count))
    return predict_lookup(evaluation_rows(prepared), model).withColumn(
        "absolute_error_seconds", F.abs(F.col("prediction_seconds") - F.col("delay_seconds"))
    )


def baseline_scores(predicted: DataFrame) -> DataFrame:
    return method_scores(predicted, METHODS, ["validation", "test"])


def fallback_usage(predicted: DataFrame) -> DataFrame:
    counted = predicted.groupBy("split", "baseline_eligible", "fallback_level").agg(F.count(F.lit(1)).alias("_n"))
    return with_population(counted).groupBy("split", "population", "fallback_level").agg(
        F.sum("_n").alias("rows")
    )


def breakdown_scores(predicted: DataFrame) -> DataFrame:
    """Grouped-median metrics of the test split by destination and by date."""
    return scores_by(
        predicted.where(F.col("split") == "test"),
        {"destination": F.col("destination"), "date": F.to_date("scheduled_time_local")},
        {"grouped_median": "prediction_seconds"},
    )
