"""Readers of departure files: plain CSV, archives holding one CSV, prepared Parquet."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lagline.functions.clock import departure_time
from lagline.functions.geo import LOOSE_POINT, point_part
from lagline.functions.once import with_columns_once
from lagline.functions.text import blank_to_null, destination_name, lenient_integer
from lagline.operators.clean import RAW_COLUMNS
from lagline.schemas import DEPARTURE_COLUMNS, text_schema
from lagline.staging import staged

ARCHIVE_BATCH = 50_000


BYTE_ORDER_MARK = "\ufeff"


def header_of(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Column names of the first file, as they stand there."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def text_csv(spark: SparkSession, path: str | list[str], required: list[str], exact: bool, multi_line: bool = False) -> DataFrame:
    """All-text CSV whose header is checked by name; columns may come in any order.

    Every file must have the first file's header: each task compares the header of the file
    that it reads, so a file with another order fails instead of filling wrong columns.
    """
    there = header_of(spark, path)
    header = [n.lstrip(BYTE_ORDER_MARK) for n in there]
    if (set(header) != set(required)) if exact else not set(required) <= set(header):
        raise ValueError(f"columns {header} where {list(required)} are needed")
    return (
        spark.read.schema(text_schema(there)).option("header", True).option("multiLine", multi_line)
        .option("enforceSchema", False).option("escape", '"').csv(path).withColumnsRenamed(
            {a: b for a, b in zip(there, header) if a != b})
    )


def number_records(rows: DataFrame, name: str = "source_record_number") -> DataFrame:
    """One-based record number inside each file, in file order.

    Splits are read in parallel and in any order, so a row's number is its place in its
    split plus the rows of the file's earlier splits. The scan is stored first: split
    borders must not move between counting and numbering.
    """
    placed = staged(
        rows.select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")
        ).withColumn("_id", F.monotonically_increasing_id())
    )
    before = W.partitionBy("_file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    # One row per input split; their number grows with the input, so the join is left to the planner.
    splits = (
        placed.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
        .select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(splits, ["_file", "_start"])
        .withColumn(name, F.col("_offset") + F.col("_id") - F.col("_first") + 1)
        .drop("_file", "_start", "_id", "_first", "_offset")
    )


def read_departures_csv(spark: SparkSession, path: str, route: str | None = None, multi_line: bool = False) -> DataFrame:
    """Nine text columns, blanks as null, and the one-based source record number."""
    rows = text_csv(spark, path, DEPARTURE_COLUMNS, exact=True, multi_line=multi_line)
    numbered = number_records(rows)
    clean = numbered.withColumns({c: blank_to_null(F.col(c)) for c in DEPARTURE_COLUMNS})
    return clean if route is None else clean.where(F.col("Route Number") == route)


def typed_history(rows: DataFrame) -> DataFrame:
    """Raw departure rows of the history build from the text columns."""
    text = lambda name: F.col(name)
    named = rows.select(
        text("Row ID").alias("id"), F.trim(text("Route Number")).alias("route"),
        F.trim(text("Stop Number")).alias("stop"), text("Day Type").alias("service"),
        "Route Destination", "Scheduled Time", "Deviation", "Location",
    )
    # Cleaning filters on these columns; parsed once, they are not parsed again for it.
    return with_columns_once(
        named,
        {
            "dest": destination_name(text("Route Destination")),
            "scheduled": departure_time(text("Scheduled Time")),
            "delay": -lenient_integer(text("Deviation")),
            "lon": point_part(text("Location"), LOOSE_POINT, 1),
            "lat": point_part(text("Location"), LOOSE_POINT, 2),
        },
    ).select(*RAW_COLUMNS)


HISTORY_TEXT = [c for c in DEPARTURE_COLUMNS if c != "Route Name"]


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = [n for n in archive.namelist() if n.lower().endswith(".csv")]
                if len(names) != 1:
                    raise ValueError(f"{path} does not hold exactly one CSV member")
                with archive.open(names[0]) as member:
                    rows = csv.DictReader(io.TextIOWrapper(member, encoding="utf-8-sig", newline=""))
                    yield from _batches(rows)


def _batches(rows) -> Iterator[pd.DataFrame]:
    kept = []
    for row in rows:
        kept.append([row.get(c) or None for c in HISTORY_TEXT])
        if len(kept) == ARCHIVE_BATCH:
            yield pd.DataFrame(kept, columns=HISTORY_TEXT, dtype=object)
            kept = []
    if kept:
        yield pd.DataFrame(kept, columns=HISTORY_TEXT, dtype=object)


def read_zip_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text rows of archives that hold exactly one CSV each.

    Archives cannot be split: each is one task that unpacks it in batches.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.repartition(max(1, len(paths)), "path").mapInPandas(_members, text_schema(HISTORY_TEXT))


def read_departures_history(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Typed raw departures of all files, archives and plain CSV alike, in one frame."""
    archives = [p for p in paths if p.lower().endswith(".zip")]
    plain = [p for p in paths if p not in archives]
    parts = []
    if archives:
        parts.append(read_zip_csv(spark, archives))
    # Files are grouped by header, as each group is one scan with one column order.
    by_header: dict[tuple, list[str]] = {}
    for path in plain:
        by_header.setdefault(tuple(n.lstrip(BYTE_ORDER_MARK) for n in header_of(spark, path)), []).append(path)
    for group in by_header.values():
        parts.append(text_csv(spark, group, HISTORY_TEXT, exact=False).select(*HISTORY_TEXT))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return typed_history(rows)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
