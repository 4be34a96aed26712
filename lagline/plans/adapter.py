"""Domain views over the star-schema tables, as SQL that Spark and DuckDB both run.

The tables hold no departures, so each view maps every row of a table to a domain row by
fixed arithmetic. Copies, conflicts and broken values are added to the rows, never
taken from a subset: every event appears in every departure view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK, DUCK = "spark", "duckdb"


# Known schemas spare the job that would otherwise read a footer for every use.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


TASK_BYTES = 4 << 20  # of a stored table whose rows are costly, for one task; about 200,000 events


def spread(frame: DataFrame, key: str, parts: int = 1) -> DataFrame:
    """Give every core a part of an input too small to split, and a large one at least `parts` parts.

    A file of one row group is one task, whatever the work per row, and a split may hold as
    much as the input divided by the cores. Inputs with enough splits pass unchanged.
    """
    wanted = max(frame.sparkSession.sparkContext.defaultParallelism, parts)
    return frame if frame.rdd.getNumPartitions() >= wanted else frame.repartition(wanted, key)


def stored_bytes(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def view(spark: SparkSession, sf_dir: str, sql, parse_heavy: bool = False) -> DataFrame:
    """Run one of the views below over the parquet tables of a scale folder.

    `parse_heavy` spreads an input whose rows are costly to read: the parts grow in number
    with the input, not in size.
    """
    text = sql(SPARK)
    names = [n for n in ("events", "orders", "lineitem") if "{" + n + "}" in text]
    tables = {n: table(spark, sf_dir, n) for n in names}
    if parse_heavy:
        parts = {n: -(-stored_bytes(spark, f"{sf_dir.rstrip('/')}/{n}.parquet") // TASK_BYTES) for n in tables}
        tables = {n: spread(t, t.columns[0], parts[n]) for n, t in tables.items()}
    return spark.sql(text, **tables)


def oracle(sql, **params) -> str:
    text = sql(DUCK, **params) if params else sql(DUCK)
    return text.format(events="events", orders="orders", lineitem="lineitem")


def second(engine: str, column: str = "ts") -> str:
    """Wall time cut to whole seconds, as a time without zone."""
    cut = f"date_trunc('second', {column})"
    return f"cast({cut} AS timestamp_ntz)" if engine == SPARK else f"cast({cut} AS timestamp)"


def day_start(engine: str, column: str = "ts") -> str:
    cut = f"date_trunc('day', {column})"
    return f"cast({cut} AS timestamp_ntz)" if engine == SPARK else f"cast({cut} AS timestamp)"


def iso_weekday(engine: str, column: str = "ts") -> str:
    """Monday 0 to Sunday 6."""
    return f"weekday({column})" if engine == SPARK else f"(isodow({column}) - 1)"


def wall_text(engine: str, column: str, spark_format: str, duck_format: str) -> str:
    if engine == SPARK:
        return f"date_format({column}, '{spark_format}')"
    return f"strftime({column}, '{duck_format}')"


def iso_text(engine: str, column: str) -> str:
    spaced = wall_text(engine, column, "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S")
    return f"replace({spaced}, ' ', 'T')"


def grouped_digits(engine: str, column: str) -> str:
    return f"format_number({column}, 0)" if engine == SPARK else "format('{{:,}}', " + column + ")"


def one_per(engine: str, entries: list[str]) -> str:
    """One output row per non-null entry of a list."""
    listed = ", ".join(entries)
    if engine == SPARK:
        return f"explode(array_compact(array({listed})))"
    return f"unnest(list_filter([{listed}], lambda x: x IS NOT NULL))"


def plus(engine: str, moment: str, seconds: str) -> str:
    """A wall time moved by whole seconds."""
    if engine == SPARK:
        return f"({moment} + make_dt_interval(0, 0, 0, cast({seconds} AS decimal(18, 6))))"
    return f"({moment} + to_seconds(cast({seconds} AS bigint)))"


DELAY = "(cast(round(value * 100) AS bigint) % 4801 - 900)"


def service(engine: str) -> str:
    dow = iso_weekday(engine)
    return (
        "CASE WHEN event_id % 97 = 0 THEN 'Holiday' "
        f"WHEN {dow} = 5 THEN 'Saturday' WHEN {dow} = 6 THEN 'Sunday' ELSE 'Weekday' END"
    )


def departures(engine: str, stops: int = 3) -> str:
    """Every event as a recorded departure."""
    return f"""
SELECT cast(event_id AS string) AS id,
       concat('R', cast(user_id % 3 AS string)) AS route,
       cast(user_id % {stops} AS string) AS stop,
       event_type AS dest,
       {second(engine)} AS scheduled,
       {DELAY} AS delay,
       {service(engine)} AS service,
       -97e0 - (user_id % {stops}) * 4e-3 AS lon,
       49.8e0 + (user_id % 3) * 1e-2 AS lat
FROM {{events}}"""


def raw_departures(engine: str, stops: int = 3) -> str:
    """Departures plus exact copies, conflicting ids, conflicting visits, renamed copies
    and structurally broken rows."""
    copies = one_per(engine, [
        "0", "CASE WHEN event_id % 50 = 0 THEN 1 END", "CASE WHEN event_id % 211 = 0 THEN 2 END",
        "CASE WHEN event_id % 307 = 0 THEN 3 END", "CASE WHEN event_id % 113 = 0 THEN 4 END",
    ])
    source = departures(engine, stops).replace("FROM {events}", ", event_id FROM {events}")
    return f"""
SELECT CASE k WHEN 3 THEN concat('x', id) WHEN 4 THEN concat('y', id) ELSE id END AS id,
       route, stop, dest, scheduled,
       CASE WHEN event_id % 131 = 0 THEN NULL WHEN event_id % 137 = 0 THEN cast(700000 AS bigint)
            WHEN k = 2 THEN delay + 60 WHEN k = 3 THEN delay + 120 ELSE delay END AS delay,
       service, CASE WHEN event_id % 139 = 0 THEN NULL ELSE lon END AS lon, lat
FROM (SELECT *, {copies} AS k FROM ({source}) e) c"""


def text_departures(engine: str) -> str:
    """Departures as the text file has them, with unreadable values and repeated rows."""
    copies = one_per(engine, ["0", "CASE WHEN event_id % 50 = 0 THEN 1 END"])
    time = wall_text(engine, "ts", "yyyy MMM dd hh:mm:ss a", "%Y %b %d %I:%M:%S %p")
    number = grouped_digits(engine, "-" + DELAY)
    return f"""
SELECT CASE WHEN k = 1 THEN concat('copy', cast(event_id AS string)) ELSE cast(event_id AS string) END AS row_id,
       cast(user_id % 12 AS string) AS stop_number,
       concat('R', cast(user_id % 3 AS string)) AS route_number,
       concat('Route ', cast(user_id % 3 AS string)) AS route_name,
       CASE WHEN event_id % 71 = 0 THEN NULL ELSE event_type END AS destination,
       CASE WHEN event_id % 73 = 0 THEN NULL ELSE {service(engine)} END AS day_type,
       CASE WHEN event_id % 101 = 0 THEN 'not a time' ELSE {time} END AS scheduled_time_raw,
       CASE WHEN event_id % 89 = 0 THEN '1,2,3' ELSE {number} END AS deviation_raw,
       CASE WHEN event_id % 67 = 0 THEN 'POINT (500 95)'
            ELSE concat('POINT (-97.', cast(user_id % 12 AS string), ' 49.8)') END AS location_wkt,
       event_id + 1 + k * cast(1000000000000 AS bigint) AS source_record_number
FROM (SELECT *, {copies} AS k FROM {{events}}) t"""


def reports(engine: str) -> str:
    """Every event as an incident report; errors are the full-bus ones."""
    copies = one_per(engine, ["0", "CASE WHEN event_id % 50 = 0 THEN 1 END"])
    return f"""
SELECT cast(event_id AS string) AS rid,
       CASE WHEN event_type = 'error' THEN 'Full Bus Pass-Up' ELSE 'Wheelchair User Pass-Up' END AS type,
       concat('R', cast(user_id % 3 AS string)) AS route,
       CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'click' END AS dest,
       {second(engine)} AS reported,
       CASE WHEN event_id % 61 = 0 THEN 500e0
            ELSE -97e0 - (user_id % 12) * 4e-3 + (event_id % 11) * 3e-4 END AS lon,
       49.8e0 + (user_id % 3) * 1e-2 AS lat,
       event_id + 1 + k * cast(1000000000000 AS bigint) AS record_no
FROM (SELECT *, {copies} AS k FROM {{events}}) t"""


def deliveries(engine: str) -> str:
    """Line items against their order date as a larger lookup workload: supplier, priority,
    return flag and ship month stand for stop, destination, day type and hour."""
    lag = "date_diff('day', o_orderdate, l_shipdate)" if engine == DUCK else "datediff(l_shipdate, o_orderdate)"
    month = "month(l_shipdate)"
    return f"""
SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string)) AS row_id,
       cast(l_suppkey % 25 AS string) AS stop_number, o_orderpriority AS destination,
       l_returnflag AS day_type, cast({month} AS integer) AS hour,
       cast({lag} AS bigint) AS delay_seconds, l_shipdate AS scheduled_time_local,
       l_linestatus = 'O' AS baseline_eligible, true AS valid_required_fields,
       CASE WHEN l_shipdate < timestamp '1998-01-01' THEN 'train'
            WHEN l_shipdate < timestamp '2000-01-01' THEN 'validation' ELSE 'test' END AS split
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey"""


def observations(engine: str) -> str:
    """Every event as a captured estimate of its user's departure at the next three-day
    boundary."""
    day = day_start(engine)
    gap = (
        f"datediff({day}, date'2024-01-01')" if engine == SPARK else f"date_diff('day', date '2024-01-01', {day})"
    )
    due = plus(engine, day, f"(3 - {gap} % 3) * 86400")
    iso = iso_text(engine, "scheduled")
    instant = "cast({} AS timestamp)"
    return f"""
SELECT cast(event_id AS string) AS snapshot_id, cast(0 AS integer) AS row_number,
       concat('trip', cast(user_id AS string)) AS trip_key,
       concat('stop', cast(user_id % 7 AS string)) AS scheduled_stop_key,
       concat({iso}, '+00:00') AS scheduled_departure_raw,
       {instant.format("scheduled")} AS scheduled_departure_utc,
       {instant.format("received")} AS received_at_utc,
       CASE WHEN event_id % 7 = 0 THEN 'spare' ELSE concat('bus', cast(user_id AS string)) END AS bus_key,
       event_id % 41 = 0 AS cancelled,
       CASE WHEN event_id % 37 = 0 THEN NULL ELSE cast(delay AS double) END AS estimated_delay_seconds,
       CASE WHEN event_id % 37 = 0 THEN NULL ELSE {instant.format(plus(engine, "scheduled", "delay"))} END AS estimated_departure_utc,
       'BLUE' AS route_number, cast(user_id % 7 AS string) AS stop_number, event_type AS variant_name
FROM (SELECT *, {due} AS scheduled, {second(engine)} AS received, {DELAY} AS delay FROM {{events}}) t"""


def rounded(frame: DataFrame, places: int, *names: str) -> DataFrame:
    """Doubles rounded for comparison, as summation order differs between engines."""
    from pyspark.sql import functions as F

    return frame.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


def day_number(engine: str, column: str = "ts") -> str:
    """Whole days since the first of January 2024."""
    day = day_start(engine, column)
    if engine == SPARK:
        return f"cast(datediff({day}, date'2024-01-01') AS bigint)"
    return f"date_diff('day', date '2024-01-01', {day})"


def outcomes(engine: str) -> str:
    """Every event as a measured departure of its user's three-day schedule, several of
    them sharing one."""
    due = plus(engine, day_start(engine), f"(3 - {day_number(engine)} % 3) * 86400")
    iso = iso_text(engine, "scheduled")
    return f"""
SELECT cast(event_id AS string) AS row_id, 'BLUE' AS route_number,
       CASE WHEN event_id % 59 = 0 THEN NULL ELSE cast(user_id AS string) END AS stop_number,
       concat('  ', upper(event_type), ' Plaza ') AS route_destination,
       concat({iso}, 'Z') AS scheduled_time, cast(-{DELAY} AS string) AS deviation
FROM (SELECT *, {due} AS scheduled FROM {{events}}) t"""


def linked_observations(engine: str) -> str:
    """Every event as an observation whose stop is its user, for linkage to `outcomes`."""
    due = plus(engine, day_start(engine), f"(3 - {day_number(engine)} % 3) * 86400")
    iso = iso_text(engine, "scheduled")
    return f"""
SELECT cast(event_id AS string) AS snapshot_id,
       concat('trip', cast(user_id AS string), '-', cast(event_id % 2 AS string)) AS trip_key,
       event_type AS scheduled_stop_key, concat({iso}, '+00:00') AS scheduled_departure_raw,
       cast(ts AS timestamp) AS received_at_utc, 'BLUE' AS route_number,
       CASE WHEN event_id % 61 = 0 THEN NULL ELSE cast(user_id AS string) END AS stop_number,
       concat(event_type, '  plaza') AS variant_name
FROM (SELECT *, {due} AS scheduled FROM {{events}}) t"""


def trip_snapshots(engine: str) -> str:
    """Every event as a trip response of its user."""
    return f"""
SELECT cast(event_id AS string) AS snapshot_id, concat('trip', cast(user_id AS string)) AS trip_key,
       cast({second(engine)} AS timestamp) AS received_at_utc,
       cast(CASE WHEN event_id % 43 = 0 THEN 500 ELSE 200 END AS integer) AS http_status,
       CASE WHEN event_id % 47 = 0 THEN 'timeout' END AS error_kind,
       CASE WHEN event_id % 53 = 0 THEN 'other' ELSE concat('trip', cast(user_id AS string)) END AS payload_trip_key,
       CASE WHEN event_id % 11 = 0 THEN 'spare' ELSE concat('bus', cast(user_id AS string)) END AS payload_bus_key
FROM {{events}}"""


def trip_stops(engine: str) -> str:
    """Every event as one stop of a trip response: a user's events inside a 16-hour block,
    in time order. The block's last event is the dated target."""
    epoch = (
        f"unix_seconds(cast({second(engine)} AS timestamp))" if engine == SPARK else f"epoch({second(engine)})::bigint"
    )
    local = second(engine)
    clock = lambda c: wall_text(engine, c, "HH:mm:ss", "%H:%M:%S")
    moved = plus(engine, local, f"CASE WHEN event_id % 29 = 0 THEN -1200 ELSE 0 END")
    late = plus(engine, local, DELAY)
    return f"""
SELECT concat(cast(user_id AS string), '-', cast(block AS string)) AS snapshot_id, event_id,
       row_number() OVER (PARTITION BY user_id, block ORDER BY due_at, event_id) - 1 AS position,
       CASE WHEN event_id % 3 = 0 THEN 'shared' ELSE cast(event_id AS string) END AS event_key,
       {clock("moved")} AS scheduled_clock, {clock("late")} AS estimated_clock, event_id % 23 = 0 AS cancelled, due_at
FROM (SELECT *, {local} AS due_at, {moved} AS moved, {late} AS late,
             {epoch} // 57600 AS block FROM {{events}}) t""".replace(
        f"{epoch} // 57600", f"({epoch} div 57600)" if engine == SPARK else f"({epoch} // 57600)"
    )


def linked_responses(engine: str) -> str:
    """Every event as a trip response for the trip of its `linked_observations` row."""
    trip = "concat('trip', cast(user_id AS string), '-', cast(event_id % 2 AS string))"
    return f"""
SELECT cast(event_id AS string) AS snapshot_id, {trip} AS trip_key, cast({second(engine)} AS timestamp) AS received_at_utc,
       cast(CASE WHEN event_id % 43 = 0 THEN 500 ELSE 200 END AS integer) AS http_status,
       CASE WHEN event_id % 47 = 0 THEN 'timeout' END AS error_kind,
       CASE WHEN event_id % 53 = 0 THEN 'other' ELSE {trip} END AS payload_trip_key,
       CASE WHEN event_id % 13 = 0 THEN 'spare' ELSE concat('bus', cast(user_id AS string)) END AS payload_bus_key
FROM {{events}}"""


def linked_response_stops(engine: str) -> str:
    """The stops of each `linked_responses` row: five on the way, two hours apart, then one
    per event type at the schedule itself; some out of order, missing, doubled or cancelled."""
    due = plus(engine, day_start(engine), f"(3 - {day_number(engine)} % 3) * 86400")
    scheduled = plus(engine, "due", "-21600 - CASE WHEN p < 5 THEN (5 - p) * 7200 WHEN event_id % 19 = 0 AND p = 5 THEN -600 ELSE 0 END")
    estimated = plus(engine, "scheduled", "(event_id * 7 + p * 131) % 4201 - 600")
    positions = one_per(engine, [str(p) for p in range(10)])
    names = ["view", "click", "purchase", "signup", "error"]
    target = " ".join(f"WHEN {5 + k} THEN '{n}'" for k, n in enumerate(names))
    clock = lambda c: wall_text(engine, c, "HH:mm:ss", "%H:%M:%S")
    return f"""
SELECT cast(event_id AS string) AS snapshot_id, p AS position, event_id,
       CASE WHEN p < 5 THEN CASE WHEN event_id % 31 = 0 AND p = 4 THEN 'view' ELSE concat('s', cast(p AS string)) END
            ELSE CASE p {target} END END AS event_key,
       concat('stop', cast(p AS string)) AS stop_key, {clock("scheduled")} AS scheduled_clock,
       CASE WHEN (event_id + p) % 17 = 0 THEN NULL ELSE {clock("estimated")} END AS estimated_clock,
       (event_id + p) % 23 = 0 AS cancelled, scheduled AS due_at
FROM (SELECT *, {estimated} AS estimated FROM (SELECT *, {scheduled} AS scheduled FROM (
  SELECT *, {due} AS due, {positions} AS p FROM {{events}}) e) t) u"""


def requests(engine: str) -> str:
    """Every event as a first-attempt request for its user's stop."""
    return f"""
SELECT cast(user_id AS string) AS stop, cast({second(engine)} AS timestamp) AS requested_at FROM {{events}}"""


def captures(engine: str) -> str:
    """Every event as a stored response with status, origin and polling cycle."""
    return f"""
SELECT cast(event_id AS string) AS snapshot_id,
       concat('cycle', cast({day_number(engine)} AS string)) AS cycle_id,
       CASE WHEN event_id % 19 = 0 THEN 'synthetic_fixture' ELSE 'live' END AS origin,
       CASE WHEN event_id % 4 = 0 THEN 'trip' ELSE 'stop' END AS resource_type,
       cast(event_id % 3 AS integer) AS attempt_number,
       cast(CASE WHEN event_id % 43 = 0 THEN 500 ELSE 200 END AS integer) AS http_status,
       CASE WHEN event_id % 43 = 0 THEN 'http_error' WHEN event_id % 47 = 0 THEN 'schema_error' END AS error_kind,
       cast(ts AS timestamp) AS received_at_utc, cast(event_id % 5 AS integer) AS observation_count
FROM {{events}}"""


def envelopes(engine: str) -> str:
    """Every event as a stop or trip response envelope with its JSON payload text."""
    iso = iso_text(engine, second(engine))
    clock = wall_text(engine, second(engine), "HH:mm:ss", "%H:%M:%S")
    late = iso_text(engine, plus(engine, second(engine), DELAY))
    c = lambda v: f"cast({v} AS string)"
    stop_event = (
        f"""'{{{{"key":"e', {c("event_id")}, '","trip-key":', {c("user_id")}, ',"bus":{{{{"key":', {c("event_id % 9")}, '}}}},"""
        f""""variant":{{{{"key":"v","name":"', event_type, '"}}}},"cancelled":"', CASE WHEN event_id % 41 = 0 THEN 'true' ELSE 'false' END, '","""
        f""""times":{{{{"departure":{{{{"scheduled":"', {iso}, '","estimated":"', {late}, '"}}}}}}}}}}}}'"""
    )
    trip_event = (
        f"""'{{{{"key":"t', {c("event_id")}, '","stop":{{{{"key":7,"number":"n7"}}}},"cancelled":false,"times":{{{{"departure":{{{{"scheduled":"', {clock}, '"}}}}}}}}}}}}'"""
    )
    return f"""
SELECT cast(event_id AS string) AS snapshot_id,
       CASE WHEN event_id % 4 = 0 THEN 'trip' ELSE 'stop' END AS resource_type,
       cast(user_id AS string) AS resource_id, cast({second(engine)} AS timestamp) AS received_at_utc,
       cast(CASE WHEN event_id % 43 = 0 THEN 500 ELSE 200 END AS integer) AS http_status,
       cast(NULL AS string) AS error_kind,
       CASE WHEN event_id % 31 = 0 THEN '{{{{"unexpected":"data"}}}}'
            WHEN event_id % 4 = 0 THEN concat('{{{{"trip":{{{{"key":"T', {c("user_id")}, '","schedule-type":"Weekday","scheduled-stops":[', {trip_event}, ',', {trip_event}, ']}}}}}}}}')
            ELSE concat('{{{{"stop-schedule":{{{{"stop":{{{{"key":"s', {c("user_id")}, '","number":', {c("user_id")}, '}}}},"route-schedules":[',
                        '{{{{"route":{{{{"key":"OTHER"}}}},"scheduled-stops":[]}}}},{{{{"route":{{{{"key":"BLUE","number":"BLUE"}}}},"scheduled-stops":[', {stop_event}, ']}}}}]}}}}}}}}')
       END AS payload_json
FROM {{events}}"""


def local_times(engine: str) -> str:
    """Every event's time moved over one calendar year, as local, dated and broken text."""
    moved = plus(engine, second(engine), "(event_id % 366) * 86400")
    iso = iso_text(engine, moved)
    clock = wall_text(engine, moved, "HH:mm:ss", "%H:%M:%S")
    return f"""
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN concat({iso}, '-05:00') WHEN event_id % 19 = 0 THEN concat({iso}, 'Z')
            WHEN event_id % 23 = 0 THEN {clock} WHEN event_id % 29 = 0 THEN '' WHEN event_id % 31 = 0 THEN 'soon'
            ELSE {iso} END AS raw FROM {{events}}"""
