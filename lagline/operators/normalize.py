"""Captured API responses to observation rows.

Envelopes: snapshot_id, resource_type, resource_id, received_at_utc, http_status,
error_kind, payload_json and further capture columns.
"""

from __future__ import annotations

import json
import re
from urllib.parse import quote, quote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lagline.functions.clock import LOCAL_ZONE, epoch_seconds, instant_issue, instant_of
from lagline.functions.once import with_columns_once
from lagline.functions.text import lenient_boolean

_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name.replace("_", "-"), kind) for name, kind in fields.items()])


# Parts that arrive as an object or as a bare value stay JSON text until read.
TIMES = _struct(
    departure=_struct(scheduled=_S, estimated=_S), arrival=_struct(scheduled=_S, estimated=_S)
)
EVENT = _struct(
    key=_S, trip_key=_S, bus=_S, stop=_S, variant=_S, destination=_S, cancelled=_S, times=TIMES
)
EVENTS = T.ArrayType(EVENT)
ROUTE_BLOCK = _struct(route=_S, scheduled_stops=EVENTS)
TRIP = _struct(
    key=_S, bus=_S, route=_S, variant=_S, previous_trip_key=_S, next_trip_key=_S,
    effective_from=_S, effective_to=_S, schedule_type=_S, scheduled_stops=EVENTS,
)
PAYLOAD = _struct(
    stop_schedule=_struct(stop=_S, route_schedules=T.ArrayType(ROUTE_BLOCK)), trip=TRIP, trip_schedule=TRIP
)


def member(text: Column, name: str) -> Column:
    """A field of an object held as JSON text; null for a bare value."""
    return F.when(F.ltrim(text).startswith("{"), F.get_json_object(text, f"$.{name}"))


def identity(text: Column) -> Column:
    """The `key` of an object, or the bare value itself."""
    return F.when(F.ltrim(text).startswith("{"), F.get_json_object(text, "$.key")).otherwise(text)


def parse_payload(envelopes: DataFrame) -> DataFrame:
    """Add `blocks` (route, stop list) and the trip header; `schema_error` where the
    payload does not have the shape its resource type promises."""
    body = F.col("_body")
    stop_root, trip_root = body["stop-schedule"], F.coalesce(body["trip"], body["trip-schedule"])
    is_stop, is_trip = F.col("resource_type") == "stop", F.col("resource_type") == "trip"
    none = F.lit(None).cast(T.ArrayType(ROUTE_BLOCK))
    trip_block = F.array(F.struct(trip_root["route"].alias("route"), trip_root["scheduled-stops"].alias("scheduled-stops")))
    return (
        with_columns_once(envelopes, {"_body": F.from_json("payload_json", PAYLOAD)})
        .withColumn("trip_header", F.when(is_trip, trip_root.dropFields("`scheduled-stops`")))
        .withColumn("shared_stop", F.when(is_stop, stop_root["stop"]))
        .withColumn(
            "blocks",
            F.when(is_stop, stop_root["route-schedules"])
            .when(is_trip & trip_root.isNotNull(), trip_block)
            .otherwise(none),
        )
        .drop("_body")
    )


def route_number(route: Column, fallback: Column) -> Column:
    return F.coalesce(member(route, "number"), fallback)


def wanted_blocks(requested_route: str) -> Column:
    """Trip responses keep their block; stop responses only the requested route's."""
    requested = F.lit(requested_route)
    return F.when(
        F.col("resource_type") == "stop",
        F.filter(
            F.col("blocks"),
            lambda b: F.coalesce(member(b["route"], "number"), member(b["route"], "key"), requested) == requested,
        ),
    ).otherwise(F.col("blocks"))


def judged_payloads(envelopes: DataFrame, requested_route: str) -> DataFrame:
    """Parsed envelopes with `error_kind` completed by `schema_error`; nothing is dropped."""
    readable = (F.col("http_status") == 200) & (F.coalesce("error_kind", F.lit("")) == "")
    blocks = F.col("blocks")
    broken = blocks.isNull() | F.exists(
        blocks, lambda b: b["scheduled-stops"].isNull() | F.exists(b["scheduled-stops"], lambda e: e.isNull())
    )
    return (
        with_columns_once(parse_payload(envelopes), {"blocks": wanted_blocks(requested_route)})
        .withColumn("_readable", F.coalesce(readable, F.lit(False)))
        .withColumn("_broken", F.coalesce(broken, F.lit(True)))
        .withColumn(
            "error_kind", F.when(F.col("_readable") & F.col("_broken"), F.lit("schema_error")).otherwise(F.col("error_kind"))
        )
        .withColumn("blocks", F.when(F.col("_readable") & ~F.col("_broken"), blocks))
        .drop("_readable", "_broken")
    )


def snapshot_rows(judged: DataFrame) -> DataFrame:
    """Envelopes as stored: payload kept whatever its state, with digest and row count."""
    counts = F.aggregate(
        F.coalesce("blocks", F.array()), F.lit(0), lambda n, b: n + F.size(b["scheduled-stops"])
    )
    return (
        judged.withColumn("payload_sha256", F.sha2("payload_json", 256))
        .withColumn("observation_count", counts)
        .drop("blocks", "trip_header", "shared_stop")
    )


def _rows_before_block() -> Column:
    """For each route block, how many rows the blocks before it hold."""
    sizes = F.transform(F.col("blocks"), lambda b: F.size(b["scheduled-stops"]))
    return F.transform(
        sizes, lambda _, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n)
    )


def observation_rows(judged: DataFrame, requested_route: str, zone: str = LOCAL_ZONE) -> DataFrame:
    """One row per scheduled stop of every readable response."""
    event, trip, route = F.col("event"), F.col("trip_header"), F.col("route")
    requested = F.lit(requested_route)
    # Outer explodes with the filter behind them: a filter on the blocks themselves would
    # be pushed below the parse and repeat it.
    spread = (
        judged.select(
            "snapshot_id", "resource_type", "resource_id", "received_at_utc", "trip_header", "shared_stop",
            F.posexplode_outer("blocks").alias("_block", "_b"), _rows_before_block().alias("_starts"),
        )
        .withColumn("_before", F.col("_starts")[F.col("_block")])
        .select("*", F.col("_b.route").alias("route"), F.posexplode_outer(F.col("_b")["scheduled-stops"]).alias("position", "event"))
        .where(F.col("event").isNotNull())
    )
    shared = F.coalesce(F.col("shared_stop"), F.to_json(F.struct(F.col("resource_id").alias("key"))))
    stop = F.coalesce(event["stop"], F.when(F.col("resource_type") == "stop", shared))
    variant = F.coalesce(event["variant"], trip["variant"])
    departure, arrival = event["times"]["departure"], event["times"]["arrival"]
    destination = F.coalesce(event["destination"], member(variant, "destination"))
    destination = F.when(
        F.ltrim(destination).startswith("{"),
        F.coalesce(F.get_json_object(destination, "$.name"), F.get_json_object(destination, "$.key")),
    ).otherwise(destination)
    scheduled, estimated = instant_of(departure["scheduled"], zone), instant_of(departure["estimated"], zone)
    trip_key = F.coalesce(
        event["trip-key"], trip["key"], F.when(F.col("resource_type") == "trip", F.col("resource_id"))
    )
    instants = {"_scheduled": scheduled, "_estimated": estimated}
    flat = with_columns_once(spread, instants).select(
        "snapshot_id", "resource_type", "received_at_utc", "_before", F.col("position").alias("_position"),
        identity(event["key"]).alias("scheduled_stop_key"),
        identity(trip_key).alias("trip_key"),
        identity(F.coalesce(event["bus"], trip["bus"])).alias("bus_key"),
        identity(stop).alias("stop_key"),
        member(stop, "number").alias("stop_number"),
        identity(route).alias("route_key"),
        route_number(route, requested).alias("route_number"),
        identity(variant).alias("variant_key"),
        destination.alias("destination"),
        member(variant, "name").alias("variant_name"),
        identity(trip["previous-trip-key"]).alias("previous_trip_key"),
        identity(trip["next-trip-key"]).alias("next_trip_key"),
        trip["effective-from"].alias("effective_from"), trip["effective-to"].alias("effective_to"),
        trip["schedule-type"].alias("schedule_type"),
        lenient_boolean(event["cancelled"]).alias("cancelled"),
        F.when(F.col("resource_type") == "trip", F.col("position")).alias("response_stop_index"),
        departure["scheduled"].alias("scheduled_departure_raw"),
        departure["estimated"].alias("estimated_departure_raw"),
        arrival["scheduled"].alias("scheduled_arrival_raw"),
        arrival["estimated"].alias("estimated_arrival_raw"),
        F.col("_scheduled").alias("scheduled_departure_utc"), F.col("_estimated").alias("estimated_departure_utc"),
    )
    issues = F.map_filter(
        F.create_map(
            F.lit("scheduled"), instant_issue(F.col("scheduled_departure_raw"), zone, F.col("scheduled_departure_utc")),
            F.lit("estimated"), instant_issue(F.col("estimated_departure_raw"), zone, F.col("estimated_departure_utc")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return flat.withColumns(
        {
            "estimated_delay_seconds": epoch_seconds(F.col("estimated_departure_utc"))
            - epoch_seconds(F.col("scheduled_departure_utc")),
            "scheduled_lead_seconds": epoch_seconds(F.col("scheduled_departure_utc"))
            - epoch_seconds(F.col("received_at_utc")),
            "time_issues": issues,
            "measurement_kind": F.lit("api_estimate"),
        }
    )


def numbered_observations(judged: DataFrame, requested_route: str, zone: str = LOCAL_ZONE) -> DataFrame:
    """Observation rows with a zero-based `row_number` inside their response."""
    return observation_rows(judged, requested_route, zone).withColumn(
        "row_number", (F.col("_before") + F.col("_position")).cast("int")
    ).drop("_before", "_position")


def normalize_envelopes(envelopes: DataFrame, requested_route: str, zone: str = LOCAL_ZONE) -> tuple[DataFrame, DataFrame]:
    """(snapshots, observations) of raw response envelopes."""
    judged = judged_payloads(envelopes, requested_route)
    return snapshot_rows(judged), numbered_observations(judged, requested_route, zone)


# The member names, in lower case without dashes and underscores.
CREDENTIALS = {"apikey", "authorization"}
MASK = "[REDACTED]"
PARAMETER = re.compile(r"""(?i)(api[-_]key=)[^&\s"<>]+""")


def redact(text: Column, secret: str = "") -> Column:
    """Blank out credentials in JSON or other text.

    In JSON whatever stands under a credential's name goes, objects and lists too. In every
    string `api-key=` parameters and the secret go, as it is and as it is quoted in an
    address. Text in which nothing has to go stays as it is, byte for byte.
    """
    secrets = sorted({secret, quote(secret, safe=""), quote_plus(secret)} - {""}, key=len, reverse=True)

    def plain(value: str) -> str:
        for known in secrets:
            value = value.replace(known, MASK)
        return PARAMETER.sub(rf"\g<1>{MASK}", value)

    def clean(value):
        if isinstance(value, dict):
            return {k: MASK if re.sub("[-_]", "", k.lower()) in CREDENTIALS else clean(v) for k, v in value.items()}
        if isinstance(value, list):
            return [clean(v) for v in value]
        return plain(value) if isinstance(value, str) else value

    def harmless(value: str) -> bool:
        """Holds neither a credential's name nor a secret; escapes, which can hide both, are looked into."""
        if "\\" in value or any(known in value for known in secrets):
            return False
        names = value.lower().replace("-", "").replace("_", "")
        return not any(name in names for name in CREDENTIALS)

    def one(value: str | None) -> str | None:
        if value is None or harmless(value):
            return value
        try:
            parsed = json.loads(value)
        except ValueError:
            return plain(value)
        if not isinstance(parsed, (dict, list)):
            return plain(value)
        cleaned = clean(parsed)
        return value if cleaned == parsed else json.dumps(cleaned, ensure_ascii=False)

    @F.pandas_udf("string")
    def masked(values: pd.Series) -> pd.Series:
        return values.map(one)

    return masked(text)


def trip_stop_rows(trip_snapshots: DataFrame) -> DataFrame:
    """Stops of trip responses in response order, for dating and earlier-stop signals.

    Input: snapshots of resource type trip with `payload_json`. Adds the payload's own
    trip, bus, variant and schedule type.
    """
    parsed = with_columns_once(trip_snapshots, {"_trip": F.from_json("payload_json", PAYLOAD)["trip"]})
    event = F.col("_event")
    return (
        parsed.select(
            *trip_snapshots.columns, F.col("_trip.key").alias("payload_trip_key"),
            identity(F.col("_trip.bus")).alias("payload_bus_key"),
            identity(F.col("_trip.variant")).alias("payload_variant_key"),
            F.col("_trip")["schedule-type"].alias("schedule_type"),
            F.posexplode_outer(F.col("_trip")["scheduled-stops"]).alias("position", "_event"),
        )
        .where(F.col("_event").isNotNull())
        .select(
            "*", event["key"].alias("event_key"), identity(event["stop"]).alias("stop_key"),
            F.coalesce(member(event["stop"], "number"), identity(event["stop"])).alias("stop_number"),
            F.coalesce(member(event["stop"], "name"), F.lit("Unnamed stop")).alias("stop_name"),
            F.get_json_object(event["stop"], "$.centre.geographic.latitude").try_cast("double").alias("lat"),
            F.get_json_object(event["stop"], "$.centre.geographic.longitude").try_cast("double").alias("lon"),
            event["times"]["departure"]["scheduled"].alias("scheduled_clock"),
            event["times"]["departure"]["estimated"].alias("estimated_clock"),
            event["times"]["arrival"]["scheduled"].alias("scheduled_arrival_clock"),
            event["times"]["arrival"]["estimated"].alias("estimated_arrival_clock"),
            F.coalesce(lenient_boolean(event["cancelled"]), F.lit(False)).alias("cancelled"),
        )
        .drop("_event", "payload_json")
    )


def trip_headers(trip_snapshots: DataFrame) -> DataFrame:
    """Trip snapshots with the trip and bus their payload names."""
    parsed = with_columns_once(trip_snapshots, {"_trip": F.from_json("payload_json", PAYLOAD)["trip"]})
    return parsed.select(
        *[c for c in trip_snapshots.columns if c != "payload_json"],
        F.col("_trip.key").alias("payload_trip_key"), identity(F.col("_trip.bus")).alias("payload_bus_key"),
    )
