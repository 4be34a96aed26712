"""Append ingest of landed response envelopes, and running capture status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lagline.functions.clock import LOCAL_ZONE
from lagline.operators.audit import capture_status
from lagline.operators.normalize import judged_payloads, numbered_observations, redact, snapshot_rows
from lagline.schemas import ENVELOPE


def landed_envelopes(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of envelope files (one JSON object per line); each file is read once."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch).json(landing)


def without_secrets(envelopes: DataFrame, secret: str = "") -> DataFrame:
    return envelopes.withColumns(
        {c: redact(F.col(c), secret) for c in ("payload_json", "parameters_json", "endpoint")}
    )


def append_batch(batch: DataFrame, batch_id: int, root: str, requested_route: str, zone: str = LOCAL_ZONE, secret: str = "") -> None:
    """Store one micro-batch as snapshots and observations.

    Each batch owns a folder that a replay overwrites, so a restart appends nothing twice.
    """
    judged = judged_payloads(without_secrets(batch, secret), requested_route).persist()
    try:
        parts = {
            "snapshots": snapshot_rows(judged),
            "observations": numbered_observations(judged, requested_route, zone),
        }
        for name, frame in parts.items():
            frame.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
    finally:
        judged.unpersist()


def start_ingest(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    requested_route: str,
    zone: str = LOCAL_ZONE,
    secret: str = "",
    available_now: bool = True,
) -> StreamingQuery:
    writer = (
        landed_envelopes(spark, landing).writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, i: append_batch(batch, i, root, requested_route, zone, secret))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_status(envelopes: DataFrame) -> DataFrame:
    """Responses, errors and last receipt per origin, for update-mode sinks."""
    return capture_status(envelopes)


def receipts_per_minute(envelopes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Receipts and errors per origin and minute, final once the watermark passes."""
    failed = F.coalesce("error_kind", F.lit("")) != ""
    return (
        envelopes.withWatermark("received_at_utc", late)
        .groupBy(F.window("received_at_utc", "1 minute"), "origin")
        .agg(F.count(F.lit(1)).alias("responses"), F.count_if(failed).alias("errors"))
        .select(F.col("window.start").alias("minute_utc"), "origin", "responses", "errors")
    )
