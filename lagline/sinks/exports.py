"""Partitioned exports: route groups, daily departures, monthly reports, trip documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lagline.functions.numbering import number_rows
from lagline.functions.skew import HOT_ROWS, attach_by_key
from lagline.functions.text import group_key_json
from lagline.operators.clean import GROUP, as_metrics
from lagline.sources.reports import require_times

QUALITY_FLAGS = [
    "flag_extreme_delay", "flag_duplicate_candidate", "flag_missing_destination", "flag_missing_day_type",
    "flag_invalid_location",
]


def with_key_text(groups: DataFrame) -> DataFrame:
    return groups.withColumn("group_key", group_key_json(*[F.col(c) for c in GROUP]))


def dictionary(rows: DataFrame, column: str, code: str, value_order: Column | None = None, record: str | None = None) -> DataFrame:
    """(value, code, rows): dense codes from 0, by `value_order` of the distinct values or
    by the first `record` that holds them."""
    order = F.min(record) if record else F.first(value_order)
    values = rows.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("_n"), order.alias("_order")
    )
    return number_rows(values, [F.col("_order"), F.col(column)], code).select(column, code, "_n")


def quality_bits() -> Column:
    """Bit mask of the quality flags; bit 5 marks missing required fields."""
    bits = F.lit(0)
    for i, name in enumerate(QUALITY_FLAGS):
        bits = bits + F.when(F.col(name), F.lit(1 << i)).otherwise(0)
    return bits + F.when(~F.col("valid_required_fields"), F.lit(1 << len(QUALITY_FLAGS))).otherwise(0)


def coded_departures(prepared: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Compact departure rows and their dictionaries; a row without a date is an error."""
    if not prepared.where(F.col("scheduled_time_local").isNull()).isEmpty():
        raise ValueError("a history row has no scheduled date and would be lost")
    dictionaries = {
        "stop_number": dictionary(prepared, "stop_number", "stop_index", F.col("stop_number").try_cast("bigint")),
        "destination": dictionary(prepared, "destination", "destination_index", F.col("destination")),
        "day_type": dictionary(prepared, "day_type", "day_type_index", F.col("day_type")),
    }
    at = F.col("scheduled_time_local")
    rows = prepared.select(
        "row_id", "stop_number", "destination", "day_type", "delay_seconds",
        F.to_date(at).alias("date"),
        (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).alias("seconds_after_midnight"),
        quality_bits().cast("int").alias("quality_flags"),
    )
    for column, table in dictionaries.items():
        rows = attach_by_key(rows, table, [column], "_n", hot_rows, spread_by=["row_id"])
    codes = ["stop_index", "destination_index", "day_type_index"]
    coded = rows.select(
        "date", "row_id", *[F.coalesce(c, F.lit(-1)).cast("int").alias(c) for c in codes],
        "seconds_after_midnight", "delay_seconds", "quality_flags",
    )
    return coded, dictionaries


def with_stop_names(stops: DataFrame, trip_stops: DataFrame) -> DataFrame:
    """Dictionary of stops with the name of the latest trip that calls there, null if none."""
    names = trip_stops.groupBy("stop_number").agg(
        F.max_by("stop_name", F.struct("trip_date", "trip_key", "position")).alias("stop_name")
    )
    return stops.join(names, "stop_number", "left")


def day_summary(coded: DataFrame) -> DataFrame:
    return coded.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("quality_flags") != 0).alias("flagged")
    )


def export_history(prepared: DataFrame, root: str, trip_stops: DataFrame | None = None) -> dict[str, str]:
    """Daily shards, dictionaries (stops named from captured trips if given) and the day index."""
    coded, dictionaries = coded_departures(prepared)
    if trip_stops is not None:
        dictionaries["stop_number"] = with_stop_names(dictionaries["stop_number"], trip_stops)
    paths = {"days": f"{root}/days", "summary": f"{root}/summary"}
    (
        coded.hint("rebalance", F.col("date")).sortWithinPartitions("date", "seconds_after_midnight", "row_id")
        .write.mode("errorifexists").partitionBy("date").json(paths["days"])
    )
    day_summary(coded).write.mode("errorifexists").json(paths["summary"])
    for name, table in dictionaries.items():
        paths[name] = f"{root}/{name}"
        table.drop("_n").write.mode("errorifexists").json(paths[name])
    return paths


def coded_reports(reports: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Every report with dictionary codes in first-seen order, month and coordinates."""
    named = reports.select(
        "rid", "reported", "record_no", "lon", "lat",
        F.trim(F.coalesce("route", F.lit(""))).alias("route"), F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce("destination", F.lit("")).alias("destination"),
    )
    dictionaries = {
        c: dictionary(named, c, f"{c}_index", record="record_no") for c in ("route", "type", "destination")
    }
    rows = named
    for column, table in dictionaries.items():
        rows = attach_by_key(rows, table, [column], "_n", hot_rows, spread_by=["record_no"])
    place = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.array("lon", "lat"))
    return rows.select(
        F.date_format("reported", "yyyy-MM").alias("month"), "rid", "reported",
        *[F.col(f"{c}_index").cast("int").alias(f"{c}_index") for c in dictionaries], place.alias("coordinates"), "record_no",
    ), dictionaries


def report_months(coded: DataFrame) -> DataFrame:
    return coded.groupBy("month").agg(
        F.count(F.lit(1)).alias("records"), F.to_date(F.min("reported")).alias("first"),
        F.to_date(F.max("reported")).alias("last"),
    )


def report_gaps(reports: DataFrame) -> DataFrame:
    """Counts of missing routes, unusable places and repeated ids."""
    repeats = reports.groupBy("rid").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("additionalDuplicateIds")
    )
    gaps = reports.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.trim(F.coalesce("route", F.lit(""))) == "").alias("missingRoute"),
        F.count_if(F.col("lon").isNull() | F.col("lat").isNull()).alias("invalidLocation"),
    )
    return as_metrics(gaps).unionByName(as_metrics(repeats))


def export_reports(reports: DataFrame, root: str) -> dict[str, str]:
    """Monthly shards in time order with dictionaries and index; fails before writing on a
    bad time or an empty source."""
    require_times(reports)
    if reports.isEmpty():
        raise ValueError("the report file holds no records")
    coded, dictionaries = coded_reports(reports)
    paths = {"months": f"{root}/months", "index": f"{root}/index", "gaps": f"{root}/gaps"}
    (
        coded.hint("rebalance", F.col("month")).sortWithinPartitions("month", "reported", "record_no")
        .write.mode("errorifexists").partitionBy("month").json(paths["months"])
    )
    report_months(coded).write.mode("errorifexists").json(paths["index"])
    report_gaps(reports).write.mode("errorifexists").json(paths["gaps"])
    for name, table in dictionaries.items():
        paths[name] = f"{root}/{name}"
        table.drop("_n").write.mode("errorifexists").json(paths[name])
    return paths


def export_trips(measured: DataFrame, times: DataFrame, summary: DataFrame, root: str) -> dict[str, str]:
    """Trip stops, captured times and summaries, each a folder per trip date."""
    paths = {}
    for name, frame in {"stops": measured, "times": times, "trips": summary}.items():
        paths[name] = f"{root}/{name}"
        frame.hint("rebalance", F.col("trip_date")).write.mode("errorifexists").partitionBy("trip_date").json(paths[name])
    return paths
