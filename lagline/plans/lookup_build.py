"""The lookup job: prepared departures to a fitted lookup, predictions and scores, as one build."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lagline.operators import lookup
from lagline.operators.prepare import review_subset
from lagline.sinks.builds import Build, require_as_written
from lagline.sinks.tables import verify_metric


def build_lookup(prepared: DataFrame, output: str, minimum_count: int = 20) -> dict[str, DataFrame]:
    """Store prepared rows, those to review, the lookup, its predictions and their scores.

    Everything after the prepared rows is derived from what was stored. Training must end
    before evaluation starts, or nothing but the prepared rows is written. The error on test
    rows, observed while they were written, must be that of the stored ones; then the build
    is committed and its rows are checked.
    """
    build = Build(prepared.sparkSession, output)
    stored = {"prepared": build.write("prepared", prepared)}
    lookup.check_chronology(stored["prepared"])
    stored["review"] = build.write("review", review_subset(stored["prepared"]))
    stored["lookup"] = build.write("lookup", lookup.fit_lookup(lookup.training_rows(stored["prepared"]), minimum_count))
    error = F.abs(F.col("prediction_seconds") - F.col("delay_seconds"))
    predicted = lookup.predict_lookup(lookup.evaluation_rows(stored["prepared"]), stored["lookup"])
    stored["predictions"] = build.write(
        "predictions", predicted.withColumn("absolute_error_seconds", error),
        facts={"test_mae": F.avg(F.when(F.col("split") == "test", F.col("absolute_error_seconds")))},
    )
    mae = build.tables["predictions"]["facts"]["test_mae"]
    verify_metric(stored["predictions"].where("split = 'test'"), "delay_seconds", "prediction_seconds", mae)
    stored["scores"] = build.write("scores", lookup.baseline_scores(stored["predictions"]))
    build.commit(minimumCount=minimum_count, testMae=mae)
    require_as_written(prepared.sparkSession, output)
    return stored
