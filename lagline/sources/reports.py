"""Reader of incident report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagline.functions.clock import REPORT_FORMAT, wall_time
from lagline.functions.geo import WHOLE_POINT, in_range, point_part
from lagline.functions.once import with_columns_once
from lagline.functions.text import destination_name, stripped
from lagline.schemas import REPORT_COLUMNS
from lagline.sources.departures import number_records, text_csv


def read_reports(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Typed reports with record number; unreadable places and times stay as nulls.

    A byte-order mark before the header is ignored; seven columns must be present.
    """
    rows = number_records(text_csv(spark, path, list(REPORT_COLUMNS), exact=False, multi_line=multi_line), "record_no")
    named = rows.select(*[F.col(c).alias(n) for c, n in REPORT_COLUMNS.items()], "record_no")
    point = lambda part: point_part(stripped(F.col("location_wkt")), WHOLE_POINT, part)
    parsed = {
        "reported": wall_time(F.col("time_raw"), REPORT_FORMAT),
        "dest": destination_name(F.coalesce("destination", F.lit(""))),
        "_lon": point(1), "_lat": point(2),
    }
    return (
        with_columns_once(named, parsed)
        .withColumn("_placed", in_range(F.col("_lon"), F.col("_lat")))
        .withColumn("lon", F.when(F.col("_placed"), F.col("_lon")))
        .withColumn("lat", F.when(F.col("_placed"), F.col("_lat")))
        .drop("_lon", "_lat", "_placed")
    )


def require_times(reports: DataFrame) -> DataFrame:
    """The reports unchanged; any unreadable time is an error before anything is written."""
    first_bad = reports.where(F.col("reported").isNull()).agg(F.min("record_no")).first()[0]
    if first_bad is not None:
        raise ValueError(f"record {first_bad} has a time that cannot be read")
    return reports
