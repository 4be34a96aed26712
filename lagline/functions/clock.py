"""Column expressions for wall-clock text, instants and calendar parts.

Local wall times are TIMESTAMP_NTZ. Instants are TIMESTAMP under a session pinned to UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lagline.functions.once import with_columns_once

LOCAL_ZONE = "America/Chicago"  # North American Central time
DAY = 86400
HALF_DAY = 43200

# The source formats.
RECENT_FORMAT = "yyyy MMM d h:mm:ss a"
REPORT_FORMAT = "M/d/yyyy h:mm:ss a"
CLOCK_ONLY = r"^\d{1,2}:\d{2}:\d{2}$"
CLOCK_FRACTION = r"^\d{1,2}:\d{2}:\d{2}(\.\d+)?$"
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
ISO_OFFSET = r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"


def wall_time(text: Column, pattern: str) -> Column:
    """Wall time in one explicit format; null where the text does not fit."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def departure_time(text: Column) -> Column:
    """ISO text of the monthly archives, or the 12-hour text of the recent file."""
    return F.coalesce(text.try_cast("timestamp_ntz"), wall_time(text, RECENT_FORMAT))


def local_of(instant: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(instant, zone).cast("timestamp_ntz")


def utc_of_unambiguous(local: Column, zone: str = LOCAL_ZONE) -> Column:
    """Instant of a wall time, null where the clock skips or repeats it.

    The session reads a wall time as UTC, so shifting there and back keeps it only when
    it exists, and an hour to either side shows the same wall time only when it repeats.
    """
    wall = local.cast("timestamp")
    utc = F.to_utc_timestamp(wall, zone)
    hour = F.expr("interval 1 hour")
    exists = F.from_utc_timestamp(utc, zone) == wall
    repeats = (F.from_utc_timestamp(utc + hour, zone) == wall) | (F.from_utc_timestamp(utc - hour, zone) == wall)
    return F.when(exists & ~repeats, utc)


def instant_of(text: Column, zone: str = LOCAL_ZONE) -> Column:
    """UTC instant of ISO text; text without an offset is local and may be refused."""
    local = utc_of_unambiguous(text.try_cast("timestamp_ntz"), zone)
    return (
        F.when(text.isNull() | ~text.rlike(ISO_SHAPE), F.lit(None).cast("timestamp"))
        .when(text.rlike(ISO_OFFSET), text.try_cast("timestamp"))
        .otherwise(local)
    )


def instant_issue(text: Column, zone: str = LOCAL_ZONE, instant: Column | None = None) -> Column:
    """Why `instant_of` gives null, or null where it gives an instant (pass it if at hand)."""
    known = instant_of(text, zone) if instant is None else instant
    readable = text.rlike(ISO_SHAPE) & text.try_cast("timestamp_ntz").isNotNull()
    return (
        F.when(known.isNotNull(), F.lit(None).cast("string"))
        .when(text.isNull() | (text == ""), F.lit("missing"))
        .when(text.rlike(CLOCK_FRACTION), F.lit("date_missing"))
        .when(~readable, F.lit("invalid_time"))
        .otherwise(F.lit("ambiguous_or_nonexistent_local_time"))
    )


def clock_seconds(text: Column) -> Column:
    """Seconds after midnight of `H:MM:SS` text with hours 0-47, else null."""
    colon = F.instr(text, ":")  # after one or two digits, so the parts stand at known places
    places = ((F.lit(1), colon - 1), (colon + 1, F.lit(2)), (colon + 4, F.lit(2)))
    hour, minute, second = (F.substring(text, at, length).try_cast("bigint") for at, length in places)
    return F.when(
        text.rlike(CLOCK_ONLY) & (hour < 48) & (minute < 60) & (second < 60), hour * 3600 + minute * 60 + second
    )


def epoch_seconds(instant: Column) -> Column:
    """Seconds with microsecond fraction since 1970, exact for present-day instants."""
    return F.unix_micros(instant.cast("timestamp")) / F.lit(1e6)


def plus_seconds(moment: Column, seconds: Column) -> Column:
    return moment + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def plus_whole_seconds(moment: Column, seconds: Column) -> Column:
    """`plus_seconds` for whole seconds, without a decimal per row."""
    return F.timestamp_add("SECOND", seconds.cast("bigint"), moment)


def seconds_of_day(local: Column) -> Column:
    return (F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)).cast("bigint")


def with_instant_near_schedule(
    rows: DataFrame, name: str, text: str, scheduled: str, zone: str = LOCAL_ZONE, bound: int = 3600
) -> DataFrame:
    """Date a clock-only estimate: the nearest of yesterday, today and tomorrow.

    Null where two candidates tie or the nearest lies more than `bound` seconds away.
    Each candidate is a column of its own, so it is worked out once and compiled.
    """
    shifts = {"_yesterday": -1, "_today": 0, "_tomorrow": 1}
    due = F.col(scheduled)
    midnight = F.date_trunc("day", local_of(due, zone)).cast("timestamp_ntz")
    dated = with_columns_once(
        rows.withColumns({"_midnight": midnight, "_clock": clock_seconds(F.col(text))}),
        {
            c: utc_of_unambiguous(plus_whole_seconds(F.col("_midnight"), F.col("_clock") + shift * DAY), zone)
            for c, shift in shifts.items()
        },
    )
    gap = lambda c: F.abs(epoch_seconds(F.col(c)) - epoch_seconds(due))
    gaps = dated.withColumns({f"_gap{c}": gap(c) for c in shifts})
    nearest = F.least(*[F.col(f"_gap{c}") for c in shifts])
    hits = [F.coalesce(F.col(f"_gap{c}") == F.col("_nearest"), F.lit(False)) for c in shifts]
    ties = hits[0].cast("int") + hits[1].cast("int") + hits[2].cast("int")
    chosen = F.coalesce(*[F.when(hit, F.col(c)) for hit, c in zip(hits, shifts)])
    return (
        gaps.withColumn("_nearest", nearest)
        .withColumn(name, F.when((F.col("_nearest") <= bound) & (ties == 1), chosen))
        .drop("_midnight", "_clock", "_nearest", *shifts, *[f"_gap{c}" for c in shifts])
    )


def day_type(moment: Column) -> Column:
    return F.when(F.weekday(moment) >= 5, F.lit("weekend")).otherwise(F.lit("weekday"))


def window_start_hour(moment: Column, hours: int = 2) -> Column:
    return (F.hour(moment) - F.hour(moment) % hours).cast("int")


def expected_service_day(moment: Column) -> Column:
    weekday = F.weekday(moment)
    return (
        F.when(weekday == 5, F.lit("Saturday")).when(weekday == 6, F.lit("Sunday")).otherwise(F.lit("Weekday"))
    )
