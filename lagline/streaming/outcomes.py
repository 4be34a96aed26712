"""Linking forecasts to outcomes that are published later."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEYS = ["match_route", "match_stop", "match_destination", "match_instant"]


def late_outcomes(events: DataFrame, outcomes: DataFrame, wait: str = "2 days") -> DataFrame:
    """Stream-stream join of live events and measured departures on the exact match key.

    Both sides carry the key columns of `operators.link`. Every event leaves with a status: at
    once with each outcome it finds (`matched`) or if it has no valid key
    (`invalid_live_identity`), and without one (`no_exact_outcome`) when the slower side's
    newest instant is `wait` past its own, which also bounds what the state holds. Keys that
    several events or outcomes share are left to the batch ledger, which sees them whole.
    """
    dated = events.where(F.col("match_instant").isNotNull()).withWatermark("match_instant", wait)
    found = outcomes.withWatermark("match_instant", wait).select(*[F.col(k).alias(f"_{k}") for k in KEYS], "row_id", "deviation")
    condition = F.lit(True)
    for k in KEYS:
        condition = condition & (dated[k] == found[f"_{k}"])
    joined = dated.join(found, condition, "left_outer").withColumn(
        "status", F.when(F.col("row_id").isNull(), F.lit("no_exact_outcome")).otherwise(F.lit("matched")))
    names = [*events.columns, "status", "row_id", "deviation"]
    kinds = {f.name: f.dataType for f in outcomes.schema.fields}
    refused = events.where(F.col("match_instant").isNull()).select(
        *events.columns, F.lit("invalid_live_identity").alias("status"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("row_id", "deviation")])
    return joined.select(*names).unionByName(refused)
