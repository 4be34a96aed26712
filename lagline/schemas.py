"""Fixed schemas of the landed inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

from lagline.operators.prepare import SOURCE_COLUMNS

STRING = T.StringType()

# Header names of the report file.
REPORT_COLUMNS = {
    "Pass-Up ID": "rid", "Pass-Up Type": "type", "Time": "time_raw", "Route Number": "route",
    "Route Name": "route_name", "Route Destination": "destination", "Location": "location_wkt",
}
DEPARTURE_COLUMNS = list(SOURCE_COLUMNS)


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, STRING) for c in columns])


def fields(**kinds: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in kinds.items())


_OUTCOME_FIELDS = {
    **dict.fromkeys(
        ["row_id", "route_number", "route_name", "stop_number", "route_destination", "day_type", "scheduled_time",
         "deviation"], "string",
    ),
    "location": "struct<type: string, coordinates: array<double>>",
}
OUTCOME = fields(**_OUTCOME_FIELDS)
OUTCOME_FILE = fields(
    retrievedAt="string", url="string",
    rows="array<struct<" + ", ".join(f"{name}: {kind}" for name, kind in _OUTCOME_FIELDS.items()) + ">>",
)

ENVELOPE = fields(
    snapshot_id="string", cycle_id="string", origin="string", resource_type="string", resource_id="string",
    request_started_at_utc="timestamp", received_at_utc="timestamp", endpoint="string", parameters_json="string",
    attempt_number="int", http_status="int", error_kind="string", server_date="string",
    retry_after_seconds="double", payload_json="string",
)
