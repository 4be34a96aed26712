"""Captured trip responses as dated trips, linked stop by stop to measured departures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lagline.functions.clock import (
    DAY, HALF_DAY, LOCAL_ZONE, clock_seconds, epoch_seconds, instant_of, local_of, plus_whole_seconds, seconds_of_day,
    utc_of_unambiguous, with_instant_near_schedule,
)
from lagline.functions.once import let, with_columns_once
from lagline.functions.skew import HOT_ROWS, attach_by_key
from lagline.functions.text import destination_match_key
from lagline.operators.asof import age_at
from lagline.staging import staged

ANCHOR_MAX_AGE_SECONDS = 7200
ANCHOR_LOOK_BACK = 50
GUARD = 3 * 3600  # seconds around a response that must know no change of the clock
TRIP = ["trip_date", "trip_key", "bus_key"]


def dated_anchors(observations: DataFrame) -> DataFrame:
    """Dated stop observations of each trip, numbered in receipt order (`place`, from 1)."""
    read = {"anchor_utc": instant_of(F.col("scheduled_departure_raw"))}
    dated = with_columns_once(observations, read).where(
        F.col("anchor_utc").isNotNull() & F.col("trip_key").isNotNull()
    )
    order = ["received_at_utc", "snapshot_id", "row_number"]
    # Numbers inside the hour plus the trip's earlier hours: no trip is sorted whole.
    hourly = dated.withColumn("_hour", F.floor(epoch_seconds(F.col("received_at_utc")) / 3600))
    sizes = hourly.groupBy("trip_key", "_hour").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("trip_key").orderBy("_hour").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("trip_key", "_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("trip_key", "_hour").orderBy(*order))
    return (
        hourly.withColumn("_inside", inside).join(starts, ["trip_key", "_hour"])
        .select(
            "trip_key", (F.col("_start") + F.col("_inside")).alias("place"), "received_at_utc", "snapshot_id",
            "anchor_utc", F.col("scheduled_stop_key").alias("anchor_event"), F.col("bus_key").alias("anchor_bus"),
            F.coalesce("variant_name", "destination").alias("anchor_destination"),
        )
    )


def recent_anchors(headers: DataFrame, anchors: DataFrame, look_back: int, max_age_seconds: float) -> DataFrame:
    """(snapshot_id, anchor_event, anchor_utc, anchor): what may date each response.

    Anchors and responses of a trip are read in time order, once, and every response takes
    the places of the `look_back` anchors before it. A span of time is as long as the age
    bound and an anchor stands in its own and the next one, so no response looks further and
    a trip that owns much of the data splits by time. Bus and age are judged before anything
    is moved on, and anchors of one event and schedule leave the task as the newest of them.
    Trips, times or buses that are null date nothing; a response without a bus is called ''.
    """
    width = F.lit(max(float(max_age_seconds), 1.0))
    span = F.floor(epoch_seconds(F.col("received_at_utc")) / width)
    known = F.col("trip_key").isNotNull() & F.col("received_at_utc").isNotNull()
    fact = F.struct("place", "anchor_destination", "anchor_event", "anchor_utc", "anchor_bus", "received_at_utc")
    offered = anchors.where(known).select(
        "trip_key", F.explode(F.array(span, span + 1)).alias("_span"), "received_at_utc", F.lit(0).alias("_side"), "place",
        fact.alias("_anchor"), F.lit(None).cast(headers.schema["snapshot_id"].dataType).alias("snapshot_id"),
        F.lit(None).cast("string").alias("_bus"),
    )
    asked = headers.where(known).select(
        "trip_key", span.alias("_span"), "received_at_utc", F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("place"),
        F.lit(None).cast(offered.schema["_anchor"].dataType).alias("_anchor"), "snapshot_id",
        F.coalesce("payload_bus_key", F.lit("")).alias("_bus"),
    )
    together = W.partitionBy("trip_key", "_span")
    so_far = together.orderBy("received_at_utc", "_side", "place").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = together.orderBy("_newest").rangeBetween(1 - look_back, W.currentRow)
    at = F.col("received_at_utc")
    usable = lambda a: (a["anchor_bus"] == F.col("_bus")) & (age_at(at, a["received_at_utc"]) <= max_age_seconds)
    return (
        offered.unionByName(asked)
        .withColumn("_newest", F.max("place").over(so_far)).where(F.col("_newest").isNotNull())
        .withColumn("_seen", F.collect_list("_anchor").over(near)).where("_side = 1")
        .select("snapshot_id", F.explode(F.filter("_seen", usable)).alias("_a"))
        .groupBy("snapshot_id", F.col("_a.anchor_event").alias("anchor_event"), F.col("_a.anchor_utc").alias("anchor_utc"))
        .agg(F.max(F.struct("_a.place", "_a.anchor_destination")).alias("anchor"))
    )


HEADS = ["payload_trip_key", "payload_bus_key", "received_at_utc"]


def response_rows(trip_stops: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """One row per trip response: its heads, its stops as one list, bounded by one payload, and
    whether the list's clocks allow dates at all (`_dateable`; the list is null if not).

    The heads stand on the stops, or in `headers`, which then meet finished lists instead of
    every stop; responses that `headers` lacks are left out.
    """
    own = [c for c in trip_stops.columns if c not in ("snapshot_id", "position", *HEADS)]
    carried = HEADS if headers is None else []
    listed = F.collect_list(F.struct("position", "_clock", *own))
    # Lists are made before the exchange, where a response's stops stand together, and put in order behind it.
    rows = trip_stops.withColumn("_clock", clock_seconds(F.col("scheduled_clock"))).groupBy("snapshot_id").agg(
        *[F.first(c).alias(c) for c in carried], F.array_sort(listed, _by_position).alias("_stops"))
    if headers is not None:
        rows = rows.join(headers.select("snapshot_id", *HEADS), "snapshot_id")
    # As `clock_offsets`, inside the list.
    fall = lambda stop, i: F.get("_stops", i - 1)["_clock"] - stop["_clock"]
    rows = with_columns_once(rows, {"_falls": F.transform("_stops", fall)})
    ordered = ~F.exists("_stops", lambda stop: stop["_clock"].isNull()) & ~F.exists(
        "_falls", lambda f: F.coalesce((f > 0) & (f < HALF_DAY), F.lit(False)))
    places = F.array_compact(F.transform("_falls", lambda f, i: F.when(f > 0, i)))
    rows = with_columns_once(rows, {"_after": F.when(ordered, places)})
    offset = lambda stop, i: stop["_clock"] + F.size(F.filter("_after", lambda x: x <= i)).cast("bigint") * DAY
    dated = F.transform("_stops", lambda stop, i: stop.withField("offset", offset(stop, i)).dropFields("_clock"))
    rows = with_columns_once(rows, {"_stops": F.when(F.col("_after").isNotNull(), dated)})
    offsets = F.transform("_stops", lambda stop: stop["offset"])
    dateable = F.coalesce(F.array_max(offsets) - F.array_min(offsets) <= HALF_DAY, F.lit(False))
    return staged(
        rows.select("snapshot_id", *HEADS, dateable.alias("_dateable"), F.when(dateable, F.col("_stops")).alias("_stops")), "responses")


def _by_position(a, b):
    return F.when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1).otherwise(0)


def anchored_stops(
    trip_stops: DataFrame,
    anchors: DataFrame,
    look_back: int = ANCHOR_LOOK_BACK,
    max_age_seconds: float = ANCHOR_MAX_AGE_SECONDS,
    zone: str = LOCAL_ZONE,
) -> DataFrame:
    """Stops of trip responses dated by the newest anchor that resolves the response.

    Only the trip's last `look_back` anchors at or before receipt count, whatever their
    bus; among those the bus must match and the age be at most `max_age_seconds`.
    `undated_responses` lists the responses that no anchor dates.
    """
    return dated_stops(dated_responses(response_rows(trip_stops), anchors, look_back, max_age_seconds, zone), zone)


def dated_responses(
    responses: DataFrame,
    anchors: DataFrame,
    look_back: int = ANCHOR_LOOK_BACK,
    max_age_seconds: float = ANCHOR_MAX_AGE_SECONDS,
    zone: str = LOCAL_ZONE,
) -> DataFrame:
    """The rows of `response_rows` that an anchor dates, each with the best one (`_best`); see `anchored_stops`."""
    heads = HEADS
    responses = responses.where("_dateable").drop("_dateable")
    headers = responses.select("snapshot_id", *heads).withColumnRenamed("payload_trip_key", "trip_key")
    offers = (
        recent_anchors(headers, anchors, look_back, max_age_seconds)
        .withColumn("_local", local_of(F.col("anchor_utc"), zone))
        .groupBy("snapshot_id").agg(F.collect_list(F.struct("anchor_event", "_local", "anchor")).alias("_offers"))
    )
    moment = lambda base, stop: utc_of_unambiguous(plus_whole_seconds(base, stop["offset"]), zone)

    def fit(offer):
        """The offer's anchor and the first midnight it implies; null unless it names one stop at its own time."""
        def base(hits):
            at = F.get(hits, F.lit(0))["offset"]
            fits = (F.size(hits) == 1) & (at % DAY == seconds_of_day(offer["_local"]))
            return F.when(fits, plus_whole_seconds(offer["_local"], -at))

        hits = F.filter("_stops", lambda stop: stop["event_key"] == offer["anchor_event"])
        return F.struct(offer["anchor"].alias("anchor"), let(hits, base).alias("base"))

    fitting = (
        with_columns_once(responses.join(offers, "snapshot_id"), {
            "_fits": F.filter(F.transform("_offers", fit), lambda f: f["base"].isNotNull())})
        .where(F.size("_fits") > 0).drop("_offers")
    )
    offsets = F.transform("_stops", lambda stop: stop["offset"])
    # Anchors agreeing on the base date every stop alike, so each base is judged once. Where the zone
    # keeps its distance from UTC from hours before the first stop to hours after the last, which one
    # look at either end tells, no time is skipped or repeated; other bases are judged stop by stop.
    reach = {"_from": F.array_min(offsets) - GUARD, "_to": F.array_max(offsets) + GUARD}
    distance = lambda wall: F.unix_micros(F.to_utc_timestamp(wall.cast("timestamp"), zone)) - F.unix_micros(wall.cast("timestamp"))

    def judged(fit):
        first, last = (distance(plus_whole_seconds(fit["base"], F.col(c))) for c in reach)
        return F.struct(fit["anchor"].alias("anchor"), fit["base"].alias("base"), let(first, lambda d: F.when(d == last, d)).alias("distance"))

    steady = with_columns_once(fitting.withColumns(reach), {"_fits": F.transform("_fits", judged)})
    whole = lambda f: f["distance"].isNotNull() | F.forall("_stops", lambda stop: moment(f["base"], stop).isNotNull())
    dated = with_columns_once(steady, {"_best": F.array_max(F.filter("_fits", whole))}).where(F.col("_best").isNotNull())
    return dated.select("snapshot_id", *heads, "_best", "_stops")


def dated_stops(dated: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Every stop of `dated_responses` with its anchor and instant."""
    rows = dated.select("snapshot_id", *HEADS, "_best", F.explode("_stops").alias("_stop")).select(
        "snapshot_id", *HEADS, "_stop.*", F.col("_best.anchor").alias("anchor"), F.col("_best.base").alias("_base"), F.col("_best.distance").alias("_distance"))
    local = plus_whole_seconds(F.col("_base"), F.col("offset"))
    near = F.timestamp_micros(F.unix_micros(local.cast("timestamp")) + F.col("_distance"))
    return rows.withColumn(
        "scheduled_utc", F.when(F.col("_distance").isNotNull(), near).otherwise(utc_of_unambiguous(local, zone))).drop("_base", "_distance")


def undated_responses(trip_stops: DataFrame, dated: DataFrame) -> DataFrame:
    """(snapshot_id, reason) of responses that `anchored_stops` leaves out.

    Both sides may hold a row per stop or, as `response_rows` and `dated_responses` do, per response.
    """
    return (
        trip_stops.select("snapshot_id").distinct().join(dated.select("snapshot_id").distinct(), "snapshot_id", "left_anti")
        .withColumn("reason", F.lit("no_unambiguous_dated_anchor"))
    )


def trip_identity(stops: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Local date of the first stop, trip and bus identify a trip."""
    first = F.min_by("scheduled_utc", "position").over(W.partitionBy("snapshot_id"))
    return stops.withColumns(
        {
            "trip_date": F.to_date(local_of(first, zone)),
            "trip_key": F.col("payload_trip_key"), "bus_key": F.coalesce("payload_bus_key", F.lit("")),
        }
    )


def consistent_captures(stops: DataFrame) -> DataFrame:
    """Flag responses whose stops or times differ from the trip's first response."""
    listed = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("position", "event_key", "scheduled_utc")))), 256)
    # A list covers one response's stops, bounded by one payload.
    captures = staged(stops.groupBy(*TRIP, "snapshot_id", "received_at_utc").agg(listed.alias("_schedule")), "captures")
    first = captures.groupBy(*TRIP).agg(
        F.min_by("_schedule", F.struct("received_at_utc", "snapshot_id")).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
    )
    marked = attach_by_key(captures, first, TRIP, "_n")
    return marked.withColumn("schedule_changed", F.col("_schedule") != F.col("_first")).drop("_schedule", "_first")


def trip_documents(stops: DataFrame, captures: DataFrame, zone: str = LOCAL_ZONE) -> tuple[DataFrame, DataFrame]:
    """(trip stops, capture times) of every trip whose schedule stayed as first captured."""
    kept = stops.join(captures.where("not schedule_changed").select("snapshot_id"), "snapshot_id", "left_semi")
    order = F.struct("received_at_utc", "snapshot_id")
    fields = ["stop_key", "stop_number", "stop_name", "lat", "lon", "scheduled_arrival_clock"]
    named = F.coalesce("anchor.anchor_destination", F.lit("")) != ""
    trip_stops = (
        kept.groupBy(*TRIP, "position", "event_key", "scheduled_utc")
        .agg(
            F.min_by(F.struct(*fields, F.col("schedule_type"), F.col("payload_variant_key")), order).alias("_first"),
            F.min_by(F.col("anchor.anchor_destination"), F.when(named, order)).alias("destination"),
        )
        .select(*TRIP, "position", "event_key", "scheduled_utc", "destination", "_first.*")
    )
    trip_stops = with_instant_near_schedule(
        trip_stops, "scheduled_arrival_utc", "scheduled_arrival_clock", "scheduled_utc", zone
    ).drop("scheduled_arrival_clock")
    times = kept
    for name in ("departure", "arrival"):
        text = "estimated_clock" if name == "departure" else "estimated_arrival_clock"
        times = with_instant_near_schedule(times, f"estimated_{name}_utc", text, "scheduled_utc", zone)
    times = times.select(
        *TRIP, "snapshot_id", "received_at_utc", "position", "estimated_departure_utc", "estimated_arrival_utc", "cancelled"
    )
    return trip_stops, times


def measured_stops(trip_stops: DataFrame, outcomes: DataFrame, unicode_aware: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Link every trip stop to the one outcome of its stop, destination and schedule."""
    keys = ["_stop", "_dest", "_second"]
    second = lambda c: F.floor(epoch_seconds(c)).cast("bigint")
    keyed = trip_stops.withColumns(
        {
            "_stop": F.col("stop_number"), "_dest": destination_match_key(F.col("destination"), unicode_aware),
            "_second": second(F.col("scheduled_utc")),
        }
    )
    event = F.struct("trip_date", "trip_key", "event_key")
    sides = keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), (F.min(event) == F.max(event)).alias("_one_event")
    )
    instant = F.col("_instant")
    measured = (
        with_columns_once(outcomes, {"_instant": instant_of(F.col("scheduled_time"))}).where(instant.isNotNull())
        .groupBy(
            F.col("stop_number").alias("_stop"),
            destination_match_key(F.col("route_destination"), unicode_aware).alias("_dest"),
            second(instant).alias("_second"),
        )
        .agg(
            F.count(F.lit(1)).alias("_outcomes"),
            F.min(F.struct("row_id", F.col("deviation").cast("double").alias("deviation"))).alias("_outcome"),
        )
    )
    facts = sides.join(measured, keys, "left")
    n = F.coalesce("_outcomes", F.lit(0))
    status = (
        F.when((n == 1) & F.col("_one_event"), F.lit("matched"))
        .when((n > 1) | ~F.col("_one_event"), F.lit("ambiguous"))
        .otherwise(F.lit("unavailable"))
    )
    matched = F.col("match_status") == "matched"
    return (
        attach_by_key(keyed, facts, keys, "_rows", hot_rows)
        .withColumn("match_status", status)
        .withColumn("outcome_row_id", F.when(matched, F.col("_outcome.row_id")))
        .withColumn("actual_delay_seconds", F.when(matched, -F.col("_outcome.deviation")))
        .drop(*keys, "_one_event", "_outcomes", "_outcome")
    )


def trip_summary(measured: DataFrame, captures: DataFrame | None = None, trip: list[str] = TRIP) -> DataFrame:
    """One row per trip: extent, measured stops, share within 120 s, upper-median delay.

    The median takes the upper of two middle values. It is read from counts per delay,
    so a trip's values are never gathered into one list.
    """
    delay = F.col("actual_delay_seconds")
    frame = measured.groupBy(*trip).agg(
        F.count(F.lit(1)).alias("stops"),
        F.min("scheduled_utc").alias("start_utc"), F.max("scheduled_utc").alias("end_utc"),
        F.min_by("stop_name", "position").alias("from_stop"), F.max_by("stop_name", "position").alias("to_stop"),
        F.count(delay).alias("measured_stops"),
        F.avg(F.when(delay.isNotNull(), (F.abs(delay) <= 120).cast("int"))).alias("within_120_share"),
    )
    counted = measured.where(delay.isNotNull()).groupBy(*trip, delay.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    by_trip = W.partitionBy(*trip)
    running = by_trip.orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    median = (
        counted.withColumn("_to", F.sum("_n").over(running)).withColumn("_all", F.sum("_n").over(by_trip))
        .where(F.col("_to") > F.floor(F.col("_all") / 2))
        .groupBy(*trip).agg(F.min("_v").alias("median_delay_seconds"))
    )
    result = frame.join(median, trip, "left")
    if captures is None:
        return result
    seen = captures.where("not schedule_changed").groupBy(*trip).agg(
        F.count(F.lit(1)).alias("captures"), F.min("received_at_utc").alias("first_capture_utc"),
        F.max("received_at_utc").alias("last_capture_utc"),
    )
    return result.join(seen, trip, "left")


def in_list_order(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("trip_date"), F.desc("start_utc"), F.desc("trip_key"))


def default_trip(summary: DataFrame) -> DataFrame:
    """The trip a viewer opens first: measured, well captured, most measured, most captures."""
    rank = F.struct(
        (F.col("measured_stops") > 0).alias("a"), (F.col("captures") >= 5).alias("b"),
        F.col("measured_stops").alias("c"), F.col("captures").alias("d"),
        F.col("trip_date").alias("e"), F.col("start_utc").alias("f"), F.col("trip_key").alias("g"),
    )
    return summary.agg(*[F.max_by(c, rank).alias(c) for c in TRIP])
