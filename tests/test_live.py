"""Payloads, linkage, as-of selection, signals, trips."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lagline.functions.clock import instant_issue, instant_of, with_instant_near_schedule
from lagline.functions.text import destination_match_key
from lagline.operators import asof, audit, evaluate, link, normalize, signals, trips
from lagline.operators.signals import clock_offsets
from lagline.plans import catalog
from tests.conftest import rows

ENV = "snapshot_id string, resource_type string, resource_id string, received_at_utc timestamp, http_status int, error_kind string, payload_json string"


def stop_payload():
    event = lambda key, est, **more: {
        "key": key, "trip-key": 77, "bus": {"key": 9}, "variant": {"key": "v", "name": "St. Norbert"}, "cancelled": "false",
        "times": {"departure": {"scheduled": "2026-09-14T19:30:00", "estimated": est}}, **more,
    }
    return {"stop-schedule": {"stop": {"key": 11027, "number": "TEST-27"}, "route-schedules": [
        {"route": {"key": "66", "number": "66"}, "scheduled-stops": [event("other", "2026-09-14T19:31:00")]},
        {"route": {"key": "BLUE", "number": "BLUE"}, "scheduled-stops": [
            event("e1", "2026-09-14T19:32:00"), event("e2", None, cancelled="true", bus=None)]}]}}


def trip_payload():
    return {"trip": {"key": "77", "bus": {"key": 9}, "schedule-type": "Weekday", "scheduled-stops": [
        {"key": "e1", "stop": {"key": 11027, "number": 27, "name": "Main"}, "cancelled": False,
         "times": {"departure": {"scheduled": "19:30:00", "estimated": "19:33:00"}}}]}}


def envelopes(spark, *payloads):
    data = [(f"s{i}", kind, "11027", datetime(2026, 9, 15, 0, 25), status, None, p if isinstance(p, str) else json.dumps(p))
            for i, (kind, status, p) in enumerate(payloads)]
    return spark.createDataFrame(data, ENV)


def test_normalized_rows(spark):
    snapshots, out = normalize.normalize_envelopes(envelopes(
        spark, ("stop", 200, stop_payload()), ("trip", 200, trip_payload()), ("stop", 200, {"unexpected": "data"}),
        ("stop", 500, stop_payload()), ("stop", 200, "not json")), "BLUE")
    got = {(r["snapshot_id"], r["row_number"]): r for r in out.collect()}
    assert set(got) == {("s0", 0), ("s0", 1), ("s1", 0)}
    first = got[("s0", 0)]
    assert (first["scheduled_stop_key"], first["trip_key"], first["bus_key"]) == ("e1", "77", "9")
    assert (first["stop_key"], first["stop_number"], first["variant_name"]) == ("11027", "TEST-27", "St. Norbert")
    assert (first["estimated_delay_seconds"], first["scheduled_lead_seconds"], first["cancelled"]) == (120, 300, False)
    second = got[("s0", 1)]
    assert second["cancelled"] and second["bus_key"] is None and second["time_issues"] == {"estimated": "missing"}
    trip = got[("s1", 0)]
    assert trip["estimated_delay_seconds"] is None and trip["time_issues"]["scheduled"] == "date_missing"
    assert (trip["trip_key"], trip["bus_key"], trip["response_stop_index"], trip["schedule_type"]) == ("77", "9", 0, "Weekday")
    kinds = rows(snapshots, "snapshot_id", "error_kind", "observation_count")
    assert kinds == [("s0", None, 2), ("s1", None, 1), ("s2", "schema_error", 0), ("s3", None, 0), ("s4", "schema_error", 0)]
    assert json.loads(snapshots.where("snapshot_id = 's2'").first()["payload_json"]) == {"unexpected": "data"}
    audited = dict(rows(audit.reconcile_payloads(snapshots, out, "BLUE")))
    assert audited == {"snapshot_row_count": 0, "payload_hash": 0, "reparse_failure": 0, "normalized_payload": 0}


def test_redaction(spark):
    text = json.dumps({"api-key": "s3cret", "Authorization": "tok", "url": "x?api-key=abc&y=1", "note": "has s3cret"})
    out = json.loads(spark.createDataFrame([(text,)], "t string").select(normalize.redact(F.col("t"), "s3cret")).first()[0])
    assert out == {"api-key": "[REDACTED]", "Authorization": "[REDACTED]", "url": "x?api-key=[REDACTED]&y=1", "note": "has [REDACTED]"}


@pytest.mark.parametrize("value,want", [
    ({"authorization": {"scheme": "Bearer", "token": "t"}, "API_KEY": ["k"]}, {"authorization": "[REDACTED]", "API_KEY": "[REDACTED]"}),
    ([{"deep": [{"ApiKey": 5}]}, "a b&c", "a%20b%26c", "a+b%26c"], [{"deep": [{"ApiKey": "[REDACTED]"}]}, "[REDACTED]", "[REDACTED]", "[REDACTED]"]),
])
def test_redaction_of_structures_and_quoted_secrets(spark, value, want):
    frame = spark.createDataFrame([(json.dumps(value),), (None,), ('{ "kept":1.50 }',), ("http://x?api-key=q&y=a+b%26c",)], "t string")
    out = [r[0] for r in frame.select(normalize.redact(F.col("t"), "a b&c")).collect()]
    assert json.loads(out[0]) == want
    assert out[1:] == [None, '{ "kept":1.50 }', "http://x?api-key=[REDACTED]&y=[REDACTED]"]


@pytest.mark.parametrize("text,utc,issue", [
    ("2026-11-01T01:30:00", None, "ambiguous_or_nonexistent_local_time"),
    ("2026-03-08T02:30:00", None, "ambiguous_or_nonexistent_local_time"),
    ("2026-09-14T08:00:00", datetime(2026, 9, 14, 13), None), ("2026-09-14T08:00:00-05:00", datetime(2026, 9, 14, 13), None),
    ("2026-09-14T13:00:00Z", datetime(2026, 9, 14, 13), None), (None, None, "missing"), ("19:30:00", None, "date_missing"),
    ("tomorrow", None, "invalid_time"), ("2026-13-14T08:00:00", None, "invalid_time"),
])
def test_local_times(spark, text, utc, issue):
    c = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(instant_of(c).cast("timestamp_ntz").alias("u"), instant_issue(c).alias("i")).first()
    assert (row["u"], row["i"]) == (utc, issue)


def test_match_key_folds_presentation_only(spark):
    data = [(" ST.  NORBERT ",), ("Ｓt. Norbert",), ("Straße",), (None,)]
    out = spark.createDataFrame(data, "t string").select(destination_match_key(F.col("t"))).collect()
    assert [r[0] for r in out] == ["st. norbert", "st. norbert", "strasse", ""]


OBS = ("snapshot_id string, trip_key string, scheduled_stop_key string, scheduled_departure_raw string, received_at_utc timestamp, "
       "scheduled_departure_utc timestamp, cancelled boolean, estimated_delay_seconds double, estimated_departure_utc timestamp, "
       "bus_key string, route_number string, stop_number string, variant_name string")
DUE = datetime(2026, 9, 15, 0, 30)


def observation(ident, received, delay=60.0, cancelled=False, bus="bus-a", trip="trip-a", destination="St. Norbert", stop="11027"):
    est = None if delay is None else DUE + timedelta(seconds=delay)
    return (ident, trip, "target", "2026-09-14T19:30:00", received, DUE, cancelled, delay, est, bus, "BLUE", stop, destination)


def observations(spark, *entries):
    return spark.createDataFrame(list(entries), OBS)


OUT = "row_id string, route_number string, stop_number string, route_destination string, scheduled_time string, deviation string"


def outcome(ident="measured-a", destination=" ST.  NORBERT ", time="2026-09-14T19:30:00.000"):
    return (ident, "BLUE", "11027", destination, time, "-90")


@pytest.mark.parametrize("outcomes,status", [
    ([outcome()], "matched"), ([outcome(time="2026-09-14T19:30:01.000")], "no_exact_outcome"),
    ([outcome(destination="Elsewhere")], "no_exact_outcome"), ([outcome(), outcome("b")], "multiple_outcomes"),
])
@pytest.mark.parametrize("hot_rows", [1, 5_000_000])
def test_linkage(spark, outcomes, status, hot_rows):
    live = observations(spark, observation("x", DUE - timedelta(minutes=6)))
    row = link.link_outcomes(live, spark.createDataFrame(outcomes, OUT), hot_rows=hot_rows).first()
    assert row["status"] == status
    assert row["actual_delay_seconds"] == (90 if status == "matched" else None)


def test_ambiguous_and_invalid_live_events(spark):
    measured = spark.createDataFrame([outcome()], OUT)
    two = observations(spark, observation("x", DUE), observation("y", DUE, trip="trip-b"))
    assert rows(link.link_outcomes(two, measured), "status") == [("multiple_live_events_same_match_key",)] * 2
    bad = observations(spark, observation("x", DUE, stop=None))
    assert rows(link.link_outcomes(bad, measured), "status") == [("invalid_live_identity",)]


CUT = DUE - timedelta(minutes=5)


@pytest.mark.parametrize("entries,reason,value", [
    ([observation("a", CUT), observation("b", CUT + timedelta(seconds=1), 999.0)], None, 60.0),
    ([observation("a", CUT - timedelta(seconds=91))], "snapshot_stale", None),
    ([observation("a", CUT - timedelta(seconds=90))], None, 60.0),
    ([observation("a", CUT + timedelta(seconds=1))], "no_snapshot_before_cutoff", None),
    ([observation("a", CUT - timedelta(seconds=20)), observation("b", CUT, cancelled=True)], "cancelled_at_cutoff", None),
    ([observation("a", CUT - timedelta(seconds=20)), observation("b", CUT, None)], "estimate_missing", None),
])
def test_asof_never_falls_back(spark, entries, reason, value):
    row = asof.select_at_horizons(observations(spark, *entries), [5]).first()
    assert row["reason"] == reason
    if reason is None:
        assert row["current"]["estimated_delay_seconds"] == value


def revision(spark, *entries):
    current = observation("current", datetime(2026, 9, 15, 0, 24, 30))
    chosen = asof.select_at_horizons(observations(spark, current, *entries), [5], lag_seconds=180)
    return asof.with_revision(chosen).first()


def test_revision(spark):
    old = lambda bus: observation("old", datetime(2026, 9, 15, 0, 21, 30), 30.0, bus=bus)
    future = observation("future", datetime(2026, 9, 15, 0, 22, 1), 999.0)
    row = revision(spark, old("bus-a"), future)
    assert (row["revision_seconds"], row["revision_seconds_per_minute"], row["history_snapshot_id"]) == (30, 10, "old")
    assert revision(spark, old("other"))["revision_reason"] == "revision_bus_changed_or_missing"
    assert revision(spark)["revision_reason"] == "revision_history_missing"


STOPS = "snapshot_id string, position int, event_key string, scheduled_clock string, estimated_clock string, cancelled boolean"
TRIPS = "resource_id string, snapshot_id string, received_at_utc timestamp, http_status int, error_kind string, payload_trip_key string, payload_bus_key string"
PAIR = [("previous", "19:22:00", "19:23:00", False), ("target", "19:30:00", "19:31:00", False)]


def upstream(spark, stops=PAIR, snapshots=None, bus="bus-a", trip="trip-a"):
    current = spark.createDataFrame([("trip-a", CUT, "bus-a", "target", DUE)], "trip_key string, cutoff_utc timestamp, bus_key string, target_key string, anchor_utc timestamp")
    found = snapshots or [("trip-snapshot", datetime(2026, 9, 15, 0, 24))]
    heads = spark.createDataFrame([("trip-a", s, t, 200, None, trip, bus) for s, t in found], TRIPS)
    lines = spark.createDataFrame([(s, i, *e) for s, _ in found for i, e in enumerate(stops)], STOPS)
    return signals.with_upstream(current, heads, lines, ["trip_key"]).first()


def test_upstream_signal(spark):
    row = upstream(spark)
    assert row["upstream_reason"] is None and row["upstream_delay_seconds"] == 60
    assert (row["upstream_event_key"], row["upstream_response_index"], row["upstream_snapshot_id"]) == ("previous", 0, "trip-snapshot")


def test_upstream_reasons(spark):
    assert upstream(spark, bus="other")["upstream_reason"] == "trip_bus_changed_or_missing"
    assert upstream(spark, trip="other")["upstream_reason"] == "trip_identity_mismatch"
    late = [("trip-snapshot", datetime(2026, 9, 15, 0, 24)), ("future", datetime(2026, 9, 15, 0, 25, 1))]
    assert upstream(spark, snapshots=late)["upstream_snapshot_id"] == "trip-snapshot"
    stale = [("s", datetime(2026, 9, 15, 0, 20, 59))]
    assert upstream(spark, snapshots=stale)["upstream_reason"] == "trip_snapshot_stale"
    early = [("previous", "19:22:00", "19:25:00", False), PAIR[1]]
    assert upstream(spark, early)["upstream_reason"] == "recent_earlier_stop_proxy_missing"
    gone = [("previous", "19:22:00", "19:23:00", True), PAIR[1]]
    assert upstream(spark, gone)["upstream_reason"] == "recent_earlier_stop_proxy_missing"
    assert upstream(spark, [PAIR[0], ("target", "19:30:00", "19:31:00", True)])["upstream_reason"] == "trip_target_cancelled"


def resolve(spark, clocks, anchor):
    data = [("s", i, key, clock, "target", anchor) for i, (key, clock) in enumerate(clocks)]
    df = spark.createDataFrame(data, "snapshot_id string, position int, event_key string, scheduled_clock string, target_key string, anchor_utc timestamp")
    return [(r["resolved"], r["scheduled_utc"]) for r in signals.resolve_trip_schedule(df, ["snapshot_id"])
            .withColumn("scheduled_utc", F.col("scheduled_utc").cast("timestamp_ntz")).orderBy("position").collect()]


def test_midnight_and_rejections(spark):
    out = resolve(spark, [("before", "23:58:00"), ("target", "00:05:00")], datetime(2026, 9, 15, 5, 5))
    assert out == [(True, datetime(2026, 9, 15, 4, 58)), (True, datetime(2026, 9, 15, 5, 5))]
    refused = [
        ([("prior", "19:31:00"), ("target", "19:30:00")], DUE), ([("target", "19:29:00")], DUE),
        ([("prior", "01:30:00"), ("target", "02:05:00")], datetime(2026, 11, 1, 8, 5)),
        ([("target", "19:30:00"), ("target", "19:30:00")], DUE), ([("a", "06:00:00"), ("target", "19:30:00")], DUE),
        ([("a", "x"), ("target", "19:30:00")], DUE),
    ]
    for clocks, anchor in refused:
        assert not any(ok for ok, _ in resolve(spark, clocks, anchor))


def test_estimate_takes_the_nearest_date(spark):
    df = spark.createDataFrame([("00:01:00", datetime(2026, 9, 15, 4, 58)), ("12:00:00", datetime(2026, 9, 15, 5, 0)), ("05:00:00", datetime(2026, 9, 15, 4, 58))], "c string, s timestamp")
    out = with_instant_near_schedule(df, "e", "c", "s").select(F.col("e").cast("timestamp_ntz")).collect()
    assert [r[0] for r in out] == [datetime(2026, 9, 15, 5, 1), None, None]


def test_fixed_rules(spark):
    df = spark.createDataFrame([(60.0, 10.0, 90.0, 5), (60.0, 100.0, None, 5), (60.0, None, 90.0, 1)],
                               "api_prediction_seconds double, revision_seconds_per_minute double, upstream_delay_seconds double, horizon_minutes int")
    names = [f"{m}_prediction_seconds" for m in signals.UPSTREAM_METHODS]
    out = [tuple(r[n] for n in names) for r in signals.fixed_rules(df).collect()]
    assert out == [(90.0, 90.0, 75.0, 90.0), (180.0, None, None, None), (None, 90.0, 75.0, None)]


def test_asof_join_equals_brute_force(spark):
    start = datetime(2026, 9, 1)
    left = [(i, f"k{i % 3}", start + timedelta(minutes=37 * i)) for i in range(200)] + [(900, None, start), (901, "k1", None), (902, "none", start)]
    right = [(f"r{i}", f"k{i % 3}", start + timedelta(minutes=91 * (i // 2)), i) for i in range(90)]
    a = spark.createDataFrame(left, "i int, k string, t timestamp")
    b = spark.createDataFrame(right, "s string, k string, at timestamp, v int")
    out = {r["i"]: r["found"] and r["found"]["tie"] for r in asof.asof_backward(a, b, ["k"], "t", "at", "s", ["v"]).collect()}
    for i, k, t in left:
        options = [(at, s) for s, kk, at, _ in right if kk == k and t is not None and at <= t]
        assert out[i] == (max(options)[1] if options else None)


def test_trip_documents(spark):
    head = [("t1", datetime(2026, 9, 15, 0, 24)), ("t2", datetime(2026, 9, 15, 0, 26)), ("t3", datetime(2026, 9, 15, 0, 28))]
    lines = []
    for s, at in head:
        for i, (key, sched, est) in enumerate([("p", "19:22:00", "19:23:00"), ("target", "19:30:00" if s != "t3" else "19:30:00", "19:31:00")]):
            if s == "t3" and key == "p":
                sched = "19:21:00"
            lines.append((s, at, "trip-a", "bus-a", "v", "Weekday", i, key, f"k{i}", str(100 + i), f"Stop {i}", None, None, sched, est, None, None, False))
    stops = spark.createDataFrame(lines, "snapshot_id string, received_at_utc timestamp, payload_trip_key string, payload_bus_key string, payload_variant_key string, schedule_type string, position int, event_key string, stop_key string, stop_number string, stop_name string, lat double, lon double, scheduled_clock string, estimated_clock string, scheduled_arrival_clock string, estimated_arrival_clock string, cancelled boolean")
    obs = observations(spark, observation("o1", datetime(2026, 9, 15, 0, 20)), observation("o2", datetime(2026, 9, 15, 0, 23), bus="other")).withColumn("row_number", F.lit(0)).withColumn("destination", F.lit("d"))
    dated = trips.trip_identity(trips.anchored_stops(stops, trips.dated_anchors(obs)))
    captures = trips.consistent_captures(dated)
    assert rows(captures, "snapshot_id", "schedule_changed") == [("t1", False), ("t2", False), ("t3", True)]
    documents, times = trips.trip_documents(dated, captures)
    assert rows(documents.withColumn("u", F.col("scheduled_utc").cast("timestamp_ntz")), "position", "u", "destination") == [
        (0, datetime(2026, 9, 15, 0, 22), "St. Norbert"), (1, DUE, "St. Norbert")]
    assert times.count() == 4
    measured = trips.measured_stops(documents, spark.createDataFrame([("m", "BLUE", "101", "st. norbert", "2026-09-14T19:30:00", "-90")], OUT))
    assert rows(measured, "position", "match_status", "actual_delay_seconds") == [(0, "unavailable", None), (1, "matched", 90.0)]
    row = trips.trip_summary(measured, captures).first()
    assert (row["stops"], row["measured_stops"], row["captures"], row["median_delay_seconds"], row["within_120_share"]) == (2, 1, 2, 90.0, 1.0)
    assert (row["from_stop"], row["to_stop"]) == ("Stop 0", "Stop 1")
    assert trips.default_trip(trips.trip_summary(measured, captures)).first()["trip_key"] == "trip-a"


def test_responses_without_a_bus_are_not_dated_by_anchors_without_one(spark):
    line = ("t1", datetime(2026, 9, 15, 0, 24), "trip-a", None, "v", "Weekday", 0, "target", "k0", "100", "Stop", None, None, "19:30:00", "19:31:00", None, None, False)
    stops = spark.createDataFrame([line], "snapshot_id string, received_at_utc timestamp, payload_trip_key string, payload_bus_key string, payload_variant_key string, schedule_type string, position int, event_key string, stop_key string, stop_number string, stop_name string, lat double, lon double, scheduled_clock string, estimated_clock string, scheduled_arrival_clock string, estimated_arrival_clock string, cancelled boolean")
    obs = observations(spark, observation("o1", datetime(2026, 9, 15, 0, 20), bus=None)).withColumn("row_number", F.lit(0)).withColumn("destination", F.lit("d"))
    dated = trips.anchored_stops(stops, trips.dated_anchors(obs))
    assert dated.count() == 0
    assert rows(trips.undated_responses(stops, dated)) == [("t1", "no_unambiguous_dated_anchor")]


def test_upper_median(spark):
    data = [("t", i, float(v)) for i, v in enumerate([10, 20, 30, 500])]
    df = spark.createDataFrame(data, "trip string, position int, actual_delay_seconds double").withColumns({"scheduled_utc": F.lit("2026-01-01").cast("timestamp"), "stop_name": F.lit("x")})
    assert trips.trip_summary(df, trip=["trip"]).first()["median_delay_seconds"] == 30.0


def test_live_evaluation_and_cohorts(spark):
    live = observations(spark, observation("a", CUT - timedelta(seconds=10)), observation("o", CUT - timedelta(seconds=190), 30.0))
    links = link.link_outcomes(live, spark.createDataFrame([outcome()], OUT))
    ledger = evaluate.forecast_ledger(live, links, [5, 20])
    assert rows(ledger, "horizon_minutes", "exclusion") == [(20, "no_snapshot_before_cutoff"), (5, None)]
    scores = {r["method"]: r for r in evaluate.horizon_scores(ledger).collect()}
    assert scores["api"]["mae_seconds"] == 30 and scores["on_time"]["mae_seconds"] == 90 and scores["api"]["distinct_trips"] == 1
    heads = spark.createDataFrame([("trip-a", "trip-snapshot", datetime(2026, 9, 15, 0, 24), 200, None, "trip-a", "bus-a")], TRIPS)
    lines = spark.createDataFrame([("trip-snapshot", i, *e) for i, e in enumerate(PAIR)], STOPS)
    features = evaluate.signal_features(live, heads, lines, [5])
    labelled = evaluate.label_features(features, links)
    out = {(r["cohort"], r["method"]): r["mae_seconds"] for r in evaluate.cohort_scores(labelled).collect()}
    assert out[("both", "api")] == 30 and out[("both", "trend")] == 0 and out[("upstream", "upstream")] == 30
    assert out[("both", "on_time")] == 90 and set(c for c, _ in out) == {"revision", "upstream", "both"}


def test_early_departure_is_excluded(spark):
    live = observations(spark, observation("a", CUT - timedelta(seconds=10)))
    gone = spark.createDataFrame([("m", "BLUE", "11027", "St. Norbert", "2026-09-14T19:30:00", "300")], OUT)
    ledger = evaluate.forecast_ledger(live, link.link_outcomes(live, gone), [5])
    assert ledger.first()["exclusion"] == "already_departed_at_cutoff"


def test_poll_gaps_bridge_blocks(spark):
    at = datetime(2026, 9, 15)
    data = [("s", at + timedelta(seconds=t)) for t in (0, 60, 120, 86400, 86460)] + [("lone", at)]
    out = {r["stop"]: r for r in audit.poll_gaps(spark.createDataFrame(data, "stop string, requested_at timestamp")).collect()}
    assert (out["s"]["polls"], out["s"]["median_gap_seconds"], out["s"]["max_gap_seconds"]) == (5, 60.0, 86280.0)
    assert out["lone"]["polls"] == 1 and out["lone"]["median_gap_seconds"] is None


def test_requests_share_a_dated_response(spark):
    """Targets of one response look their proxy up; stops at the target's own time do not count, and each anchor day is dated apart."""
    request = "trip_key string, cutoff_utc timestamp, bus_key string, target_key string, anchor_utc timestamp, current_snapshot_id string"
    day = timedelta(days=1)
    asked = [("trip-a", CUT, "bus-a", key, due, f"now-{key}") for key, due in (
        ("b", DUE - timedelta(minutes=8)), ("c", DUE), ("d", DUE), ("twice", DUE), ("away", DUE))] + [("trip-a", CUT + day, "bus-a", "c", DUE + day, "next")]
    heads = spark.createDataFrame([("trip-a", f"r{n}", datetime(2026, 9, 15, 0, 24) + n * day, 200, None, "trip-a", "bus-a") for n in (0, 1)], TRIPS)
    stops = [("a", "19:20:00", "19:21:00", False), ("b", "19:22:00", "19:23:00", False), ("x", "19:30:00", "19:23:30", False),
             ("c", "19:30:00", "19:31:00", False), ("d", "19:30:00", None, False), ("twice", "19:31:00", None, False), ("twice", "19:32:00", None, False)]
    lines = spark.createDataFrame([(f"r{n}", i, *e, f"key-{i}") for n in (0, 1) for i, e in enumerate(stops)], f"{STOPS}, stop_key string")
    found = {r["current_snapshot_id"]: r for r in signals.with_upstream(
        spark.createDataFrame(asked, request), heads, lines, ["trip_key", "target_key", "cutoff_utc"]).collect()}
    got = {k: (r["upstream_reason"], r["upstream_event_key"], r["upstream_stop_key"], r["target_response_index"], r["upstream_snapshot_id"]) for k, r in found.items()}
    assert got == {
        "now-b": (None, "a", "key-0", 1, "r0"), "now-c": (None, "b", "key-1", 3, "r0"), "now-d": (None, "b", "key-1", 4, "r0"),
        "now-twice": ("trip_date_unresolved", None, None, None, None), "now-away": ("trip_date_unresolved", None, None, None, None),
        "next": (None, "b", "key-1", 3, "r1"),
    }
    row = found["now-c"]
    assert (row["upstream_delay_seconds"], row["upstream_estimated_passage_age_seconds"], row["date_anchor_snapshot_id"]) == (60, 60, "now-c")
    assert (row["upstream_bus_key"], row["upstream_trip_key"], row["progress_measurement_kind"]) == ("bus-a", "trip-a", signals.PROXY_KIND)
    assert row["upstream_scheduled_departure_utc"] == DUE - timedelta(minutes=8)


def test_recent_anchors_equal_brute_force(spark):
    """Ties in time, null trips, times and buses, anchors beyond the look-back and beyond the age."""
    import random

    rng, start = random.Random(5), datetime(2026, 9, 1)
    moment = lambda: start + timedelta(seconds=600 * rng.randrange(60))
    received = sorted((f"t{rng.randrange(3)}", moment()) for _ in range(240))
    placed, seen = [], {}
    for trip, at in received:
        seen[trip] = seen.get(trip, 0) + 1
        placed.append((trip, seen[trip], at, f"s{len(placed)}", DUE + timedelta(days=rng.randrange(2)), rng.choice("ab"), rng.choice(["x", "y", None]), "d"))
    asked = [(f"r{i}", rng.choice(["t0", "t1", "t2", "t9", None]), rng.choice(["x", "y", "z", None]), moment()) for i in range(150)] + [("late", "t0", "x", None)]
    anchors = spark.createDataFrame(placed, "trip_key string, place bigint, received_at_utc timestamp, snapshot_id string, anchor_utc timestamp, anchor_event string, anchor_bus string, anchor_destination string")
    headers = spark.createDataFrame(asked, "snapshot_id string, trip_key string, payload_bus_key string, received_at_utc timestamp")
    for look_back, age in ((4, 3600.0), (50, 7200.0), (1, 100000.0)):
        expected = {}
        for name, trip, bus, at in asked:
            past = [p for p in placed if at is not None and p[0] == trip and p[2] <= at][-look_back:]
            for p in past:
                if p[6] == (bus or "") and (at - p[2]).total_seconds() <= age:
                    expected[name, p[5], p[4]] = p[1]
        found = trips.recent_anchors(headers, anchors, look_back, age)
        got = {(r["snapshot_id"], r["anchor_event"], r["anchor_utc"]): r["anchor"]["place"] for r in found.collect()}
        assert got == expected and expected
    assert trips.recent_anchors(headers.where("false"), anchors, 4, 3600.0).count() == 0
    assert trips.recent_anchors(headers, anchors.where("false"), 4, 3600.0).count() == 0


def test_dating_moves_no_stop_rows_for_bases_or_targets(spark):
    stops = spark.createDataFrame(
        [("r", p, e, "trip", "bus", datetime(2026, 9, 15, 0, 25), c) for p, (e, c) in enumerate([("a", "23:50:00"), ("b", "00:10:00"), ("c", "0:20:00")])],
        "snapshot_id string, position int, event_key string, payload_trip_key string, payload_bus_key string, received_at_utc timestamp, scheduled_clock string")
    anchors = spark.createDataFrame(
        [("trip", n, datetime(2026, 9, 15, 0, n), f"o{n}", at, e, "bus", "Downtown") for n, (e, at) in enumerate([
            ("b", datetime(2026, 9, 15, 5, 10)), ("c", datetime(2026, 9, 15, 5, 20)), ("a", datetime(2026, 9, 15, 5, 50))], 1)],
        "trip_key string, place bigint, received_at_utc timestamp, snapshot_id string, anchor_utc timestamp, anchor_event string, anchor_bus string, anchor_destination string")
    dated = trips.anchored_stops(stops, anchors)
    plan = dated._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # Joins by base or target once dealt out and sorted every stop again.
    assert not [line for line in dealt if "base#" in line or "event_key#" in line]
    found = rows(dated.select("event_key", "scheduled_utc", "anchor.place"))
    # The newest anchor names a stop at another time of day; the one before it dates the whole response.
    assert found == [("a", datetime(2026, 9, 15, 4, 50), 2), ("b", datetime(2026, 9, 15, 5, 10), 2), ("c", datetime(2026, 9, 15, 5, 20), 2)]


def test_clock_seconds_equal_the_shape(spark):
    from lagline.functions.clock import clock_seconds

    texts = ["0:00:00", "00:00:59", "7:05:09", "47:59:59", "48:00:00", "12:60:00", "12:00:60", "1:2:3", "123:00:00", "", "x", "12:00:00 ", "12:00", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clock_seconds(F.col("t")).alias("v"))
    assert {r.t: r.v for r in frame.collect()} == dict.fromkeys(texts) | {"0:00:00": 0, "00:00:59": 59, "7:05:09": 25509, "47:59:59": 172799}


def test_redaction_looks_behind_escapes_and_marks(spark):
    texts = ['{"\\u0061pi-key":"k"}', '{"a_p_i-key":1}', '{"note":"a\\u0020b&c"}', '{"AuthorIzation":[1]}', '{ "kept":1.50 }', "a b&c", "plain"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [r[0] for r in frame.select(normalize.redact(F.col("t"), "a b&c")).collect()] == [
        '{"api-key": "[REDACTED]"}', '{"a_p_i-key": "[REDACTED]"}', '{"note": "[REDACTED]"}', '{"AuthorIzation": "[REDACTED]"}', '{ "kept":1.50 }', "[REDACTED]", "plain"]


def test_costly_views_have_parts_in_proportion_to_the_input(spark, folder, monkeypatch):
    from lagline.plans import adapter

    spark.range(5000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' AS ts", "id AS user_id", "'view' AS event_type", "cast(id AS double) AS value", "'' AS props",
    ).coalesce(1).write.parquet(f"{folder}/events.parquet")
    size = adapter.stored_bytes(spark, f"{folder}/events.parquet")
    monkeypatch.setattr(adapter, "TASK_BYTES", size // 50)
    parts = adapter.view(spark, folder, adapter.envelopes, parse_heavy=True)
    assert parts.rdd.getNumPartitions() >= 50 and parts.count() == 5000


def test_clocks_are_dated_without_decimals(spark):
    frame = spark.createDataFrame([("23:59:00", datetime(2026, 9, 15, 5, 1)), ("00:02:00", datetime(2026, 9, 15, 5, 1))], "c string, due timestamp")
    dated = with_instant_near_schedule(frame, "at", "c", "due")
    assert "decimal" not in dated._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r["at"] for r in dated.collect()] == [datetime(2026, 9, 15, 4, 59), datetime(2026, 9, 15, 5, 2)]


def test_listed_stops_have_the_offsets_of_single_ones(spark):
    clocks = {"night": ["23:50:00", "00:10:00", "1:05:00"], "twice": ["47:00:00", "24:00:00", "1:00:00"], "back": ["10:00:00", "09:59:59", "10:01:00"],
              "long": ["01:00:00", "14:00:00"], "blank": ["10:00:00", None, "10:05:00"], "odd": ["10:00:00", "soon"], "one": ["05:00:00"], "half": ["12:00:00", "00:00:00"]}
    stops = spark.createDataFrame(
        [(s, p, f"{s}{p}", datetime(2026, 9, 15), "trip", None, c) for s, texts in clocks.items() for p, c in reversed(list(enumerate(texts)))],
        "snapshot_id string, position int, event_key string, received_at_utc timestamp, payload_trip_key string, payload_bus_key string, scheduled_clock string").repartition(5)
    heads = stops.select("snapshot_id", *trips.HEADS).distinct()
    single = clock_offsets(stops, ["snapshot_id"]).where("_ordered and _span <= 43200")
    expected = rows(single, "snapshot_id", "position", "event_key", "offset")
    assert {r[0] for r in expected} == {"night", "twice", "one", "half"}
    for listed in (trips.response_rows(stops), trips.response_rows(stops.drop(*trips.HEADS), heads)):
        assert listed.count() == len(clocks) and listed.where("_dateable = isnull(_stops)").isEmpty()
        assert rows(listed.selectExpr("snapshot_id", "inline(_stops)"), "snapshot_id", "position", "event_key", "offset") == expected
    assert trips.response_rows(stops.drop(*trips.HEADS), heads.where("snapshot_id = 'one'")).count() == 1


def test_undated_responses_need_one_row_per_response(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = catalog.QUERIES["undated_trip_responses"](spark, "/root/testdata/sf0.001")
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Stops were once made, dealt out and counted again, and dated ones listed, only to name their responses.
    assert "explode(_stops" not in plan and "explode([0,1,2" not in plan
