"""Prediction-time features: nothing observed after scheduling enters them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lagline.functions.clock import LOCAL_ZONE, local_of

CATEGORICAL = ["stop_number", "destination", "day_type", "day_of_week"]
NUMERIC = ["minute_of_day"]
FEATURES = CATEGORICAL + NUMERIC
MISSING = "__MISSING__"


def with_features(rows: DataFrame, time: str = "scheduled_time_local", zone: str = LOCAL_ZONE) -> DataFrame:
    """Add the feature columns, prefixed `f_`; instants count as local time of `zone`."""
    wanted = {"stop_number", "destination", "day_type", time}
    absent = wanted - set(rows.columns)
    if absent:
        raise ValueError(f"features lack the columns {sorted(absent)}")
    moment = F.col(time)
    if dict(rows.dtypes)[time] == "timestamp":
        moment = local_of(moment, zone)
    known = F.when(
        moment.isNull(), F.raise_error(F.lit("Every prediction needs a valid scheduled time.")).cast("timestamp_ntz")
    ).otherwise(moment)
    names = {f"f_{c}": F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in CATEGORICAL[:3]}
    return rows.withColumn("_at", known).withColumns(
        {
            **names,
            "f_day_of_week": F.weekday("_at").cast("string"),
            "f_minute_of_day": F.hour("_at") * 60 + F.minute("_at") + F.floor(F.second("_at")) / F.lit(60.0),
        }
    ).drop("_at")


def vocabulary(training: DataFrame) -> DataFrame:
    """(feature, category) pairs seen in training."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"f_{c}").alias("category")) for c in CATEGORICAL]
    )
    # Distinct tuples first: the explode then copies those, not the rows.
    tuples = training.select(*[f"f_{c}" for c in CATEGORICAL]).distinct()
    return tuples.select(F.explode(pairs).alias("_p")).select("_p.*").distinct()


def category_counts(rows: DataFrame) -> DataFrame:
    """(feature, category, rows) of feature rows."""
    joint = rows.groupBy(*[f"f_{c}" for c in CATEGORICAL]).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"f_{c}").alias("category")) for c in CATEGORICAL]
    )
    return (
        joint.select("_n", F.explode(pairs).alias("_p")).groupBy("_p.feature", "_p.category")
        .agg(F.sum("_n").alias("rows"))
    )


def unseen_categories(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Per feature: scored rows whose category training never held, zero included."""
    counted = category_counts(rows).join(known.withColumn("_known", F.lit(True)), ["feature", "category"], "left")
    return counted.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("rows"))), F.lit(0)).alias("unseen_rows")
    )
