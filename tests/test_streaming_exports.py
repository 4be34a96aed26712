"""Streaming jobs against their batch twins, and exports read back."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lagline.operators import asof
from lagline.operators.normalize import normalize_envelopes
from lagline.schemas import ENVELOPE
from lagline.sinks import exports, tables
from lagline.sources import capture
from lagline.sources.reports import read_reports
from lagline.streaming import forecasts, ingest
from tests.conftest import rows
from tests.test_live import stop_payload, trip_payload
from tests.test_prepare import BOUNDS, frame, record
from lagline.operators.prepare import prepare_departures


def land(spark, folder, name, entries):
    keys = [c.split(" ")[0] for c in ENVELOPE.split(", ")]
    with open(f"{folder}/{name}.json", "w") as f:
        for e in entries:
            f.write(json.dumps({k: e.get(k) for k in keys}) + "\n")


def envelope(ident, payload, kind="stop", origin="live", at="2026-09-15T00:25:00Z"):
    return {"snapshot_id": ident, "cycle_id": "c", "origin": origin, "resource_type": kind, "resource_id": "77",
            "request_started_at_utc": at, "received_at_utc": at, "endpoint": "x?api-key=abc", "parameters_json": "{}",
            "attempt_number": 1, "http_status": 200, "payload_json": json.dumps(payload)}


def test_ingest_appends_once(spark, folder):
    import os

    landing = f"{folder}/in"
    os.mkdir(landing)
    start = lambda: ingest.start_ingest(spark, landing, f"{folder}/store", f"{folder}/cp", "BLUE").awaitTermination()
    land(spark, landing, "a", [envelope("s0", stop_payload()), envelope("s1", {"unexpected": "data"})])
    start()
    land(spark, landing, "b", [envelope("s2", trip_payload(), "trip"), envelope("s3", stop_payload(), origin="synthetic_fixture")])
    start()
    start()
    everything = spark.read.parquet(f"{folder}/store/snapshots")
    assert rows(everything, "snapshot_id", "error_kind", "observation_count") == [
        ("s0", None, 2), ("s1", "schema_error", 0), ("s2", None, 1), ("s3", None, 2)
    ]
    assert everything.where("endpoint like '%abc%'").count() == 0
    snapshots, observations = capture.read_capture(spark, f"{folder}/store", "2026-09-15", "2026-09-16")
    assert rows(snapshots, "snapshot_id") == [("s0",), ("s1",), ("s2",)]
    batch = spark.read.schema(ENVELOPE).json(landing)
    _, twin = normalize_envelopes(batch, "BLUE")
    keys = ["snapshot_id", "row_number", "trip_key", "scheduled_stop_key", "estimated_delay_seconds"]
    assert rows(observations, *keys) == rows(twin.where("snapshot_id <> 's3'"), *keys)
    # A replayed batch replaces its own folder.
    ingest.append_batch(batch.where("snapshot_id = 's0'"), 0, f"{folder}/store", "BLUE")
    assert spark.read.parquet(f"{folder}/store/snapshots").where("snapshot_id = 's0'").count() == 1


def test_running_status(spark, folder):
    land(spark, folder, "a", [envelope("s0", {}), envelope("s1", {}), envelope("s2", {}, origin="synthetic_fixture")])
    stream = ingest.landed_envelopes(spark, f"{folder}/*.json")
    query = ingest.running_status(stream).writeStream.format("memory").queryName("status").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("status"), "origin", "responses", "errors") == [("live", 2, 0), ("synthetic_fixture", 1, 0)]


def test_receipts_per_minute(spark, folder):
    land(spark, folder, "a", [envelope("s0", {}), envelope("s1", {}, at="2026-09-15T00:25:59Z"), envelope("s2", {}, at="2026-09-15T00:26:00Z")])
    batch = ingest.receipts_per_minute(spark.read.schema(ENVELOPE).json(folder))
    assert rows(batch, "responses") == [(1,), (2,)]


def test_forecasts_equal_the_batch(spark, folder):
    due = datetime(2026, 9, 15, 12)
    data = []
    for trip in range(4):
        for i in range(40):
            at = due - timedelta(minutes=30) + timedelta(seconds=37 * i + trip)
            delay = None if i % 11 == 0 else float(i * 7 % 50)
            data.append((f"s{trip}-{i:02d}", f"trip{trip}", "stop", "2026-09-15T12:00:00Z", at, due, i % 13 == 0, delay,
                         None if delay is None else due + timedelta(seconds=delay), "bus" if i % 9 else "spare"))
    columns = ("snapshot_id string, trip_key string, scheduled_stop_key string, scheduled_departure_raw string, received_at_utc timestamp, "
               "scheduled_departure_utc timestamp, cancelled boolean, estimated_delay_seconds double, estimated_departure_utc timestamp, bus_key string")
    # Clock-only rows have no schedule, broken ones no key: they must not stop the stream.
    data += [("n1", "trip0", "stop", "19:30:00", due - timedelta(minutes=20), None, False, 1.0, due, "bus"),
             ("n2", None, "stop", "2026-09-15T12:00:00Z", due - timedelta(minutes=20), due, None, None, None, None)]
    full = spark.createDataFrame(data, columns)
    pusher = [(f"z{n}", "later", "stop", "x", due + timedelta(hours=n), due + timedelta(days=9), False, 1.0, due, "b") for n in (1, 2)]
    import time

    parts = [full.where(F.col("received_at_utc") < F.lit("2026-09-15 11:40:00")), full.where(F.col("received_at_utc") >= F.lit("2026-09-15 11:40:00")),
             *[spark.createDataFrame([p], columns) for p in pusher]]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = (forecasts.horizon_forecasts(stream, [1, 5, 10, 20]).writeStream.format("memory").queryName("forecasts")
             .option("checkpointLocation", f"{folder}/cp").outputMode("append").start())
    query.processAllAvailable()
    query.stop()
    timed = full.where("trip_key is not null and scheduled_departure_utc is not null")
    batch = asof.with_revision(asof.select_at_horizons(timed, [1, 5, 10, 20], lag_seconds=180))
    usable = F.col("reason").isNull()
    twin = batch.select(
        *asof.EVENT, F.col("horizon_minutes").cast("double").alias("horizon_minutes"), "reason",
        F.when(usable, F.col("current.snapshot_id")).alias("snapshot_id"),
        F.when(usable, F.col("current.estimated_delay_seconds")).alias("estimated_delay_seconds"),
        F.when(usable, F.col("revision_reason")).alias("revision_reason"), F.when(usable, F.col("revision_seconds")).alias("revision_seconds"),
    )
    assert rows(spark.table("forecasts").where("trip_key <> 'later'")) == rows(twin) and twin.count() == 16


def test_late_outcomes_join(spark, folder):
    from lagline.streaming.outcomes import late_outcomes

    key = ("BLUE", "1", "downtown", datetime(2026, 9, 15))
    columns = "match_route string, match_stop string, match_destination string, match_instant timestamp"
    event, found = f"{columns}, trip_key string", f"{columns}, row_id string, deviation string"
    spark.createDataFrame([(*key, "t"), ("BLUE", "2", *key[2:], "u")], event).write.parquet(f"{folder}/events")
    spark.createDataFrame([(*key, "m", "-90")], found).write.parquet(f"{folder}/outcomes")
    read = lambda schema, name: spark.readStream.schema(schema).parquet(f"{folder}/{name}")
    query = (late_outcomes(read(event, "events"), read(found, "outcomes")).writeStream.format("memory")
             .queryName("late").option("checkpointLocation", f"{folder}/cp").start())
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("late"), "trip_key", "row_id", "deviation") == [("t", "m", "-90")]


def test_stop_names_and_lookup_store(spark, folder):
    stops = spark.createDataFrame([("1", 0), ("2", 1)], "stop_number string, stop_index bigint")
    calls = spark.createDataFrame(
        [("1", "Old", "2026-01-01", "t", 0), ("1", "New", "2026-01-02", "t", 0)],
        "stop_number string, stop_name string, trip_date string, trip_key string, position int",
    )
    assert rows(exports.with_stop_names(stops, calls), "stop_number", "stop_name") == [("1", "New"), ("2", None)]
    from lagline.operators.lookup import fit_lookup

    train = spark.createDataFrame([("A", "N", "W", 8, 10)], "stop_number string, destination string, day_type string, hour int, delay_seconds bigint")
    model = fit_lookup(train, 1)
    assert spark.read.parquet(tables.write_lookup(model, f"{folder}/lookup")).count() == 7


REPORT_HEADER = "Pass-Up ID,Pass-Up Type,Time,Route Number,Route Name,Route Destination,Location\n"


def report_file(folder, *lines):
    with open(f"{folder}/reports.csv", "w", encoding="utf-8-sig") as f:
        f.write(REPORT_HEADER + "\n".join(lines) + "\n")
    return f"{folder}/reports.csv"


def test_report_export(spark, folder):
    path = report_file(
        folder, "a,Full Bus Pass-Up,02/01/2026 12:00:00 AM,BLUE,BLUE,South,POINT (-97 49)",
        "a,Wheelchair User Pass-Up,01/31/2026 11:59:59 PM,,,North,nowhere",
    )
    paths = exports.export_reports(read_reports(spark, path), f"{folder}/out")
    assert rows(spark.read.json(paths["index"]), "month", "records", "first") == [("2026-01", 1, "2026-01-31"), ("2026-02", 1, "2026-02-01")]
    gaps = {r["metric"]: r["value"] for r in spark.read.json(paths["gaps"]).collect()}
    assert gaps == {"records": 2, "missingRoute": 1, "invalidLocation": 1, "additionalDuplicateIds": 1}
    assert rows(spark.read.json(paths["route"]), "route", "route_index") == [("", 1), ("BLUE", 0)]
    months = spark.read.json(paths["months"]).orderBy("record_no").collect()
    assert months[0]["coordinates"] == [-97, 49] and months[1]["coordinates"] is None


def test_bad_time_fails_before_writing(spark, folder):
    import os

    path = report_file(folder, "a,Full Bus Pass-Up,02/30/2026 12:00:00 AM,BLUE,BLUE,South,POINT (-97 49)")
    with pytest.raises(ValueError, match="record 1"):
        exports.export_reports(read_reports(spark, path), f"{folder}/out")
    assert not os.path.exists(f"{folder}/out")


def test_history_export_and_prepared_store(spark, folder):
    data = frame(spark, record(1), record(2), record(3, Deviation="5,000", **{"Stop Number": "7", "Route Destination": None}))
    prepared = prepare_departures(data, BOUNDS)
    paths = tables.write_prepared(prepared, folder)
    tables.verify_stored(prepared, paths["prepared"])
    assert spark.read.parquet(paths["review"]).count() == 2
    with pytest.raises(ValueError):
        tables.verify_stored(prepared.limit(1), paths["prepared"])
    out = exports.export_history(spark.read.parquet(paths["prepared"]), f"{folder}/days")
    days = spark.read.json(out["days"])
    assert rows(days, "row_id", "stop_index", "destination_index", "seconds_after_midnight", "quality_flags") == [
        ("001", 1, 0, 28800, 0), ("002", 1, 0, 28800, 2), ("003", 0, -1, 28800, 5)
    ]
    assert rows(spark.read.json(out["summary"]), "rows", "flagged") == [(3, 2)]
    with pytest.raises(ValueError, match="no scheduled date"):
        exports.export_history(prepare_departures(frame(spark, record(1, **{"Scheduled Time": "bad"})), BOUNDS), f"{folder}/x")


def test_outcome_files(spark, folder):
    row = {"row_id": "1", "route_number": "BLUE", "stop_number": "10", "route_destination": "S", "day_type": "Weekday",
           "scheduled_time": "2026-09-14T19:30:00.000", "deviation": "-90", "location": {"type": "Point", "coordinates": [-97.1, 49.5]}}
    with open(f"{folder}/2026-09-14.json", "w") as f:
        json.dump({"retrievedAt": "t", "url": "u", "rows": [row, {**row, "row_id": "2", "location": None}]}, f)
    found = capture.read_outcome_files(spark, f"{folder}/2026-09-14.json")
    text = capture.outcomes_as_departures(found)
    assert rows(text, "Row ID", "Scheduled Time", "Location") == [
        ("1", "2026 Sep 14 07:30:00 PM", "POINT (-97.1 49.5)"), ("2", "2026 Sep 14 07:30:00 PM", None)
    ]
    assert found.first()["file_day"] == "2026-09-14"
    with open(f"{folder}/plain.json", "w") as f:
        json.dump([row], f)
    assert capture.read_outcomes_json(spark, f"{folder}/plain.json").first()["location"]["coordinates"] == [-97.1, 49.5]


def test_unmatched_events_leave_with_a_status(spark):
    """An event without outcome leaves when the slower side's watermark has passed it, one without a key at once; a restart loses nothing."""
    from lagline.streaming.outcomes import late_outcomes
    from lagline.streaming.replay import replayed, row_of

    at = datetime(2026, 9, 15)
    key = "match_route string, match_stop string, match_destination string, match_instant timestamp"
    event, found = f"trip_key string, {key}, landed_at timestamp", f"{key}, row_id string, deviation double, landed_at timestamp"
    day = timedelta(days=1)
    events = spark.createDataFrame([("t", "BLUE", "1", "x", at, at), ("u", "BLUE", "2", "x", at, at), ("v", None, None, None, None, at),
                                    ("w", "BLUE", "1", "x", at + day, at + day)], event)
    outcomes = spark.createDataFrame([("BLUE", "1", "x", at, "m", -90.0, at + 2 * day), ("BLUE", "1", "x", at, "n", 5.0, at + 2 * day)], found)
    far = lambda frame, n: row_of(frame, match_route="~", match_stop="~", match_destination="~", match_instant=at + n * 30 * day)
    table = replayed(
        spark, {"events": (events, "landed_at"), "outcomes": (outcomes, "landed_at")},
        lambda s: late_outcomes(s["events"].drop("landed_at"), s["outcomes"].drop("landed_at"), "3 days"), steps=2,
        closing=[{"events": far(events, n), "outcomes": far(outcomes, n)} for n in (1, 2)])
    assert rows(table.where("trip_key is not null"), "trip_key", "status", "row_id") == [
        ("t", "matched", "m"), ("t", "matched", "n"), ("u", "no_exact_outcome", None), ("v", "invalid_live_identity", None), ("w", "no_exact_outcome", None)]


def test_replay_of_nothing(spark):
    from lagline.streaming.replay import replayed

    empty = spark.createDataFrame([], "name string, at timestamp")
    assert replayed(spark, {"rows": (empty, "at")}, lambda s: s["rows"].select("name"), steps=2).count() == 0


def test_one_timer_judges_all_passed_cutoffs():
    from types import SimpleNamespace

    class Value:
        held = None
        get = lambda self: self.held
        update = lambda self, value: setattr(self, "held", value)
        clear = lambda self: setattr(self, "held", None)

    value, timers = Value(), []
    handle = SimpleNamespace(getValueState=lambda *_: value, registerTimer=timers.append)
    watermark = lambda at: SimpleNamespace(getCurrentWatermarkInMs=lambda: at)
    processor, minute = forecasts.HorizonForecasts([1, 5, 10, 20], 600, 180), 60_000
    processor.init(handle)
    Read = forecasts.Row(*forecasts.READ)
    # The event is captured often, so that rows are cut to those needed on the way.
    taken = [Read(at * 1000, 100 * minute, f"s{at:05d}", False, float(at), "bus") for at in range(79 * 60, 100 * 60)]
    assert list(processor.handleInputRows(("t", "s", "x"), iter(taken), watermark(0))) == []
    assert timers == [80 * minute] and len(value.held[2]) == 7
    fired = SimpleNamespace(getExpiryTimeInMs=lambda: 80 * minute)
    told = list(processor.handleExpiredTimer(("t", "s", "x"), watermark(96 * minute), fired))
    assert [(r.horizon_minutes, r.snapshot_id) for r in told] == [(20.0, "s04800"), (10.0, "s05400"), (5.0, "s05700")]
    assert timers == [80 * minute, 99 * minute] and value.held[1] == [20.0, 10.0, 5.0]
    last = SimpleNamespace(getExpiryTimeInMs=lambda: 99 * minute)
    told = list(processor.handleExpiredTimer(("t", "s", "x"), watermark(131 * minute), last))
    assert [r.snapshot_id for r in told] == ["s05940"] and value.held is None
