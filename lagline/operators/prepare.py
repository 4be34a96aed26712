"""Typed, quality-flagged departures: every row kept, nothing repaired silently."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from lagline.functions.clock import RECENT_FORMAT, wall_time
from lagline.functions.geo import STRICT_POINT, in_range, point_part
from lagline.functions.once import with_columns_once
from lagline.functions.skew import HOT_ROWS, attach_by_key
from lagline.functions.text import strict_integer

# Source header and the names used from here on.
SOURCE_COLUMNS = {
    "Row ID": "row_id",
    "Stop Number": "stop_number",
    "Route Number": "route_number",
    "Route Name": "route_name",
    "Route Destination": "destination",
    "Day Type": "day_type",
    "Scheduled Time": "scheduled_time_raw",
    "Deviation": "deviation_raw",
    "Location": "location_wkt",
}
SIGNATURE = [c for c in SOURCE_COLUMNS.values() if c != "row_id"]
REQUIRED = ["row_id", "route_number", "stop_number", "scheduled_time_local", "delay_seconds"]


@dataclass(frozen=True)
class Boundaries:
    """Half-open chronological splits."""

    train_start: str
    validation_start: str
    test_start: str
    test_end_exclusive: str

    def __post_init__(self):
        moments = [datetime.fromisoformat(v) for v in self.values()]
        if not all(a < b for a, b in zip(moments, moments[1:])):
            raise ValueError("each split has to start after the one before")

    def values(self) -> list[str]:
        return [self.train_start, self.validation_start, self.test_start, self.test_end_exclusive]


def split_label(moment: Column, boundaries: Boundaries) -> Column:
    train, validation, test, end = [F.lit(v).cast("timestamp_ntz") for v in boundaries.values()]
    return (
        F.when(moment.isNull(), F.lit("invalid"))
        .when(moment < train, F.lit("outside"))
        .when(moment < validation, F.lit("train"))
        .when(moment < test, F.lit("validation"))
        .when(moment < end, F.lit("test"))
        .otherwise(F.lit("later"))
    )


def typed_departures(raw: DataFrame) -> DataFrame:
    """Parsed time, delay, calendar parts and coordinates next to the source text."""
    time = F.col("scheduled_time_local")
    parsed = with_columns_once(
        raw.withColumnsRenamed(SOURCE_COLUMNS),
        {
            "scheduled_time_local": wall_time(F.col("scheduled_time_raw"), RECENT_FORMAT),
            "deviation_seconds": strict_integer(F.col("deviation_raw")),
            "longitude": point_part(F.col("location_wkt"), STRICT_POINT, 1),
            "latitude": point_part(F.col("location_wkt"), STRICT_POINT, 2),
        },
    )
    return parsed.withColumns(
        {
            "delay_seconds": -F.col("deviation_seconds"),
            "scheduled_date": F.to_date(time),
            "day_of_week": F.weekday(time),
            "hour": F.hour(time),
            "minute": F.minute(time),
            "month": F.month(time),
            "is_weekend": F.weekday(time) >= 5,
        }
    )


def duplicate_sets(rows: DataFrame, row_id: str, order: str) -> DataFrame:
    """Per repeated content: first position, first non-null id and number of copies."""
    return (
        rows.groupBy("_sig")
        .agg(
            F.count(F.lit(1)).alias("_copies"),
            F.min(order).alias("_first"),
            F.min_by(row_id, F.when(F.col(row_id).isNotNull(), F.col(order))).alias("_first_id"),
        )
        .where("_copies > 1")
    )


def flag_duplicates(
    rows: DataFrame,
    signature: list[str] = SIGNATURE,
    row_id: str = "row_id",
    order: str = "source_record_number",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Flag every copy after the first in source order and name the row it repeats.

    A window over the copies would put a hot content into one task; a combined
    aggregate over its digest and a join back does not.
    """
    signed = with_columns_once(rows, {"_sig": content_digest(signature)})
    sets = duplicate_sets(signed, row_id, order)
    flagged = F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    return (
        attach_by_key(signed, sets, ["_sig"], "_copies", hot_rows)
        .withColumn("flag_duplicate_candidate", flagged)
        .withColumn("duplicate_of_row_id", F.when(flagged, F.col("_first_id")))
        .drop("_sig", "_first", "_first_id")
    )


def content_digest(columns: list[str]) -> Column:
    """One comparable key for a tuple; a null differs from every text."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.sha2(F.to_json(F.array(*parts)), 256)


def conflicting_row_ids(typed: DataFrame, signature: list[str] = SIGNATURE) -> DataFrame:
    """Ids whose rows differ in any source field, nulls counted as values."""
    content = F.struct(*signature)
    return (
        typed.where(F.col("row_id").isNotNull())
        .groupBy("row_id")
        .agg(F.min(content).alias("_a"), F.max(content).alias("_b"))
        .where(~F.col("_a").eqNullSafe(F.col("_b")))
        .select("row_id")
    )


def quality_flags(typed: DataFrame, extreme_delay_seconds: int = 3600) -> DataFrame:
    required = F.lit(True)
    for name in REQUIRED:
        required = required & F.col(name).isNotNull()
    return typed.withColumns(
        {
            "flag_invalid_location": ~in_range(F.col("longitude"), F.col("latitude")),
            "valid_required_fields": required,
            "flag_missing_destination": F.col("destination").isNull(),
            "flag_missing_day_type": F.col("day_type").isNull(),
            "flag_extreme_delay": F.coalesce(
                F.abs("delay_seconds") > extreme_delay_seconds, F.lit(False)
            ),
        }
    )


def prepare_departures(
    raw: DataFrame,
    boundaries: Boundaries,
    extreme_delay_seconds: int = 3600,
    check_conflicts: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All selected rows with types, flags, eligibility and split label.

    Conflicting row ids are an error, found before anything is written.
    """
    typed = typed_departures(raw)
    if check_conflicts and not conflicting_row_ids(typed).isEmpty():
        raise ValueError("one row id names records that differ")
    flagged = flag_duplicates(quality_flags(typed, extreme_delay_seconds), hot_rows=hot_rows)
    eligible = F.col("valid_required_fields")
    for name in (
        "flag_extreme_delay", "flag_duplicate_candidate", "flag_missing_destination", "flag_missing_day_type",
    ):
        eligible = eligible & ~F.col(name)
    return flagged.withColumns(
        {
            "baseline_eligible": eligible,
            "split": split_label(F.col("scheduled_time_local"), boundaries),
        }
    )


def review_subset(prepared: DataFrame) -> DataFrame:
    return prepared.where(~F.col("baseline_eligible") | F.col("flag_invalid_location"))


def in_output_order(prepared: DataFrame) -> DataFrame:
    return prepared.orderBy(F.asc_nulls_last("scheduled_time_local"), F.asc_nulls_last("row_id"))
