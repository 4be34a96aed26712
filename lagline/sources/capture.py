"""Readers of landed outcomes, capture tables and input fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagline.schemas import OUTCOME, OUTCOME_FILE


def read_outcomes_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Measured outcomes from files that each hold one JSON array."""
    return spark.read.schema(OUTCOME).option("multiLine", True).json(path)


def read_outcome_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Outcomes from daily wrapper objects, with retrieval time, address and the file's day."""
    files = spark.read.schema(OUTCOME_FILE).option("multiLine", True).json(path)
    day = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1)
    rows = files.select("retrievedAt", "url", day.alias("file_day"), F.explode("rows").alias("_row"))
    return rows.select("retrievedAt", "url", "file_day", "_row.*")


def outcomes_as_departures(outcomes: DataFrame) -> DataFrame:
    """Outcome rows in the text columns of the departure file, ready for preparation."""
    spot = F.col("location.coordinates")
    place = F.when(F.size(spot) == 2, F.format_string("POINT (%s %s)", spot[0].cast("string"), spot[1].cast("string")))
    time = F.date_format(F.col("scheduled_time").try_cast("timestamp_ntz"), "yyyy MMM dd hh:mm:ss a")
    return outcomes.select(
        F.col("row_id").alias("Row ID"), F.col("stop_number").alias("Stop Number"),
        F.col("route_number").alias("Route Number"), F.col("route_name").alias("Route Name"),
        F.col("route_destination").alias("Route Destination"), F.col("day_type").alias("Day Type"),
        time.alias("Scheduled Time"), F.col("deviation").alias("Deviation"), place.alias("Location"),
    )


def read_capture(
    spark: SparkSession, root: str, start: str, end: str, resource_type: str | None = None, origin: str = "live"
) -> tuple[DataFrame, DataFrame]:
    """(snapshots, observations) of one origin requested inside a closed time window.

    Observations take resource type, origin and request time from their snapshot.
    """
    snapshots = spark.read.parquet(f"{root}/snapshots").where(
        (F.col("origin") == origin)
        & F.col("request_started_at_utc").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    )
    if resource_type:
        snapshots = snapshots.where(F.col("resource_type") == resource_type)
    told = ["resource_type", "origin", "request_started_at_utc"]
    observations = spark.read.parquet(f"{root}/observations").drop(*told).join(
        snapshots.select("snapshot_id", *told), "snapshot_id"
    )
    return snapshots, observations


def source_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Name, size and SHA-256 of every input file."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"),
    )


def bundle_fingerprint(manifest: DataFrame, cutoff: str) -> DataFrame:
    """One digest for the whole input bundle and its cutoff (one entry per input file)."""
    files = F.array_sort(F.collect_list(F.struct("file", "sha256", "bytes")))
    entry = F.transform(files, lambda f: F.struct(f["bytes"].alias("bytes"), f["file"].alias("file"), f["sha256"].alias("sha256")))
    text = F.to_json(F.struct(F.lit(cutoff).alias("cutoff"), entry.alias("files")))
    return manifest.agg(F.sha2(text, 256).alias("sha256"), F.count(F.lit(1)).alias("files"))
