"""Queries over recorded departures and incident reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline.functions import text
from lagline.operators import clean, policy, prepare, profile, sets, spatial, timing
from lagline.plans import adapter
from lagline.plans.adapter import departures, oracle, raw_departures, reports, rounded, text_departures, view
from lagline.plans.registry import query
from lagline.staging import staged
from lagline.sinks import exports

CUTOFF = "2024-01-03"
GROUP = clean.GROUP
SPLITS = prepare.Boundaries("2024-01-03", "2024-01-16", "2024-01-23", "2024-01-29")

GROUPED = """
SELECT *, date_trunc('day', scheduled)::date AS day,
       if(isodow(scheduled) > 5, 'weekend', 'weekday') AS daytype, (hour(scheduled) // 2 * 2)::integer AS hour"""
KEYS = "route, stop, dest, daytype, hour"


def _visits(spark, sf_dir, stops: int = 3):
    return clean.with_group(view(spark, sf_dir, lambda e: departures(e, stops)))


# The statement follows its own road: a class for every visit, one row per day and class
# share, and the spread of the days' residuals around the share.
TIMING_CTE = f"""
WITH classed AS (
  SELECT v.*, CASE WHEN delay < -60 THEN 'early' WHEN delay > 300 THEN 'late' ELSE 'within' END AS class
  FROM ({GROUPED} FROM ({oracle(departures)}) d) v WHERE delay BETWEEN -3600 AND 3600),
by_day AS (
  SELECT {KEYS}, day, count(*) AS n, sum((class = 'early')::int) AS early, sum((class = 'within')::int) AS within,
         sum((class = 'late')::int) AS late, sum((delay < 0)::int) AS before_schedule
  FROM classed GROUP BY ALL),
spread AS (
  SELECT *, sum(n) OVER g AS total, count(*) OVER g AS days, {", ".join(f"sum({c}) OVER g / sum(n) OVER g AS {c}_p" for c in ("early", "within", "late", "before_schedule"))}
  FROM by_day WINDOW g AS (PARTITION BY {KEYS})),
shares AS (
  SELECT {KEYS}, any_value(total) AS total, any_value(days) AS days, min(day) AS first_day, max(day) AS last_day,
         any_value(before_schedule_p) AS before_schedule_p,
         {", ".join(f"any_value({c}_p) AS {c}_p, 1.96 * sqrt(any_value(days)::double / (any_value(days) - 1) * sum(pow({c} - {c}_p * n, 2))) / any_value(total) AS {c}_m" for c in ("early", "within", "late"))}
  FROM spread WHERE total >= 30 AND days >= 5 GROUP BY {KEYS}),
ranks AS (
  SELECT {KEYS}, {", ".join(f"quantile_cont(delay, {q}) AS {n}" for n, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))}
  FROM classed GROUP BY {KEYS})
"""
INTERVALS = ", ".join(
    f"round(greatest(0, {c}_p - {c}_m), 4) AS {c}_low, round(least(1, {c}_p + {c}_m), 4) AS {c}_high" for c in ("early", "within", "late")
)
SHARES = ", ".join(f"round({c}_p, 6) AS {c}_share" for c in ("early", "within", "late", "before_schedule"))
QUANTILES = "round(p50, 6) AS median_seconds, round(p10, 6) AS p10_seconds, round(p90, 6) AS p90_seconds"


@query(f"""{TIMING_CTE}
SELECT {KEYS}, total::bigint AS observations, days AS distinct_dates, first_day AS coverage_start, last_day AS coverage_end,
       {QUANTILES}, {SHARES}, {INTERVALS}
FROM shares JOIN ranks USING ({KEYS})""")
def timing_groups(spark, sf_dir):
    result = timing.timing_groups(_visits(spark, sf_dir))
    doubles = [c for c in result.columns if c.endswith("_share") or c.endswith("_seconds")]
    return rounded(result, 6, *doubles)


@query(f"""{TIMING_CTE} SELECT {KEYS}, day, n AS visits, early::bigint AS early, within::bigint AS within, late::bigint AS late,
       before_schedule::bigint AS before_schedule FROM by_day""")
def daily_counts(spark, sf_dir):
    return timing.daily_counts(_visits(spark, sf_dir))


@query(f"""{TIMING_CTE} SELECT {KEYS}, {QUANTILES} FROM ranks""")
def group_quantiles(spark, sf_dir):
    result = timing.group_quantiles(_visits(spark, sf_dir))
    return rounded(result, 6, "p10_seconds", "median_seconds", "p90_seconds")


@query(f"""{TIMING_CTE} SELECT {KEYS}, total::bigint AS visits, days AS dates, {SHARES}, {INTERVALS} FROM shares""")
def share_intervals(spark, sf_dir):
    summary = timing.group_summary(timing.daily_counts(_visits(spark, sf_dir)))
    shares = ["early_share", "within_share", "late_share", "before_schedule_share"]
    bounds = [f"{c}_{end}" for c in timing.CATEGORIES for end in ("low", "high")]
    return rounded(timing.share_intervals(summary).select(*GROUP, "visits", "dates", *shares, *bounds), 6, *shares)


# Every record keeps its row and learns its fate from windows: its state, which copy of its
# content it is, whether its id's contents agree, and its rank within its visit.
CLEAN_CTE = f"""
WITH records AS (
  SELECT *, CASE WHEN scheduled IS NULL THEN 'undated' WHEN scheduled < timestamp '{CUTOFF}' THEN 'old' ELSE 'dated' END AS state,
         delay BETWEEN -604800 AND 604800 AND least(length(id), length(route), length(stop), length(dest)) > 0
           AND id IS NOT NULL AND route IS NOT NULL AND stop IS NOT NULL AND dest IS NOT NULL AS filled
  FROM ({oracle(raw_departures)}) r),
copies AS (
  SELECT *, row(route, stop, dest, scheduled, delay, service)::varchar AS content,
         row_number() OVER (PARTITION BY id, route, stop, dest, scheduled, delay, service, lon, lat) AS copy,
         list_extract(['Weekday', 'Weekday', 'Weekday', 'Weekday', 'Weekday', 'Saturday', 'Sunday'], isodow(scheduled)) AS calendar
  FROM records WHERE state = 'dated' AND filled),
judged AS (
  SELECT *, min(content) OVER i <> max(content) OVER i AS id_differs, service IS NOT DISTINCT FROM calendar AS on_calendar
  FROM copies WHERE copy = 1 WINDOW i AS (PARTITION BY id)),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY route, stop, dest, scheduled ORDER BY id) AS rank,
         min(delay) OVER v <> max(delay) OVER v AS delay_differs, avg(lon) OVER v AS mean_lon, avg(lat) OVER v AS mean_lat
  FROM judged WHERE NOT id_differs AND on_calendar WINDOW v AS (PARTITION BY route, stop, dest, scheduled))
"""


@query(f"""{CLEAN_CTE} SELECT {KEYS}, day, scheduled, delay, round(mean_lon, 6) AS lon, round(mean_lat, 6) AS lat
FROM ({GROUPED} FROM seen WHERE rank = 1 AND NOT delay_differs) g""")
def clean_visits(spark, sf_dir):
    visits = clean.clean_visits(view(spark, sf_dir, raw_departures), CUTOFF)
    return rounded(visits.select(*GROUP, "day", "scheduled", "delay", "lon", "lat"), 6, "lon", "lat")


@query(f"""{CLEAN_CTE}
SELECT unnest(map_entries(m)).key AS metric, unnest(map_entries(m)).value::bigint AS value FROM (SELECT map {{
  'sourceRows': (SELECT count(*) FROM records), 'beforeOverhaulRows': (SELECT count(*) FROM records WHERE state = 'old'),
  'invalidRows': (SELECT count(*) FROM records WHERE state = 'undated' OR coalesce(filled, false) = false),
  'distinctSourceRows': (SELECT count(*) FROM judged),
  'conflictingSourceIds': (SELECT count(DISTINCT id) FROM judged WHERE id_differs),
  'calendarMismatchRows': (SELECT count(*) FROM judged WHERE NOT on_calendar),
  'conflictingVisitIdentities': (SELECT count(*) FROM seen WHERE rank = 1 AND delay_differs),
  'collapsedConsistentCopies': (SELECT count(*) FROM seen WHERE rank > 1 AND NOT delay_differs),
  'retainedRecordedVisits': (SELECT count(*) FROM seen WHERE rank = 1 AND NOT delay_differs)}} AS m) one""")
def clean_audit(spark, sf_dir):
    return clean.clean_audit(view(spark, sf_dir, raw_departures), CUTOFF)


@query(f"""{CLEAN_CTE} SELECT DISTINCT id FROM judged WHERE id_differs""")
def conflicting_ids(spark, sf_dir):
    return clean.conflicting_ids(clean.usable_rows(view(spark, sf_dir, raw_departures), CUTOFF))


PREPARED_CTE = f"""
WITH src AS ({oracle(text_departures)}),
typed AS (
  SELECT *, try_strptime(scheduled_time_raw, '%Y %b %d %I:%M:%S %p') AS scheduled_time_local,
         CASE WHEN regexp_full_match(deviation_raw, '[+-]?(\\d+|\\d{{1,3}}(,\\d{{3}})+)')
              THEN -try_cast(replace(deviation_raw, ',', '') AS bigint) END AS delay_seconds,
         try_cast(regexp_extract(location_wkt, '^POINT \\((-?\\d+(\\.\\d+)?) (-?\\d+(\\.\\d+)?)\\)$', 1) AS double) AS longitude,
         try_cast(regexp_extract(location_wkt, '^POINT \\((-?\\d+(\\.\\d+)?) (-?\\d+(\\.\\d+)?)\\)$', 3) AS double) AS latitude
  FROM src),
numbered AS (
  SELECT *, row_number() OVER w > 1 AS flag_duplicate_candidate,
         first_value(row_id IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_id
  FROM typed
  WINDOW w AS (PARTITION BY stop_number, route_number, route_name, destination, day_type, scheduled_time_raw,
               deviation_raw, location_wkt ORDER BY source_record_number)),
flagged AS (
  SELECT *, CASE WHEN flag_duplicate_candidate THEN first_id END AS duplicate_of_row_id,
         NOT coalesce(longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90, false) AS flag_invalid_location,
         row_id IS NOT NULL AND route_number IS NOT NULL AND stop_number IS NOT NULL
           AND scheduled_time_local IS NOT NULL AND delay_seconds IS NOT NULL AS valid_required_fields,
         destination IS NULL AS flag_missing_destination, day_type IS NULL AS flag_missing_day_type,
         coalesce(abs(delay_seconds) > 3600, false) AS flag_extreme_delay,
         CASE WHEN scheduled_time_local IS NULL THEN 'invalid'
              WHEN scheduled_time_local < timestamp '{SPLITS.train_start}' THEN 'outside'
              WHEN scheduled_time_local < timestamp '{SPLITS.validation_start}' THEN 'train'
              WHEN scheduled_time_local < timestamp '{SPLITS.test_start}' THEN 'validation'
              WHEN scheduled_time_local < timestamp '{SPLITS.test_end_exclusive}' THEN 'test' ELSE 'later' END AS split
  FROM numbered),
prepared AS (
  SELECT *, valid_required_fields AND NOT flag_extreme_delay AND NOT flag_duplicate_candidate
            AND NOT flag_missing_destination AND NOT flag_missing_day_type AS baseline_eligible,
         hour(scheduled_time_local)::integer AS hour, cast(scheduled_time_local AS date) AS scheduled_date FROM flagged)
"""


def prepared(spark, sf_dir, check_conflicts: bool = False):
    return prepare.prepare_departures(
        view(spark, sf_dir, text_departures, parse_heavy=True), SPLITS, check_conflicts=check_conflicts
    )


FLAG_COLUMNS = [
    "flag_invalid_location", "flag_missing_destination", "flag_missing_day_type", "flag_extreme_delay",
    "flag_duplicate_candidate",
]


@query(f"""{PREPARED_CTE}
SELECT row_id, route_number, stop_number, destination, day_type, scheduled_time_local, scheduled_date, hour,
       minute(scheduled_time_local)::integer AS minute, month(scheduled_time_local)::integer AS month,
       (isodow(scheduled_time_local) - 1)::integer AS day_of_week, isodow(scheduled_time_local) >= 6 AS is_weekend,
       delay_seconds, longitude, latitude, {", ".join(FLAG_COLUMNS)}, duplicate_of_row_id, valid_required_fields,
       baseline_eligible, split FROM prepared""")
def prepared_departures(spark, sf_dir):
    return prepared(spark, sf_dir, check_conflicts=True).select(
        "row_id", "route_number", "stop_number", "destination", "day_type", "scheduled_time_local", "scheduled_date",
        "hour", "minute", "month", "day_of_week", "is_weekend", "delay_seconds", "longitude", "latitude",
        *FLAG_COLUMNS, "duplicate_of_row_id", "valid_required_fields", "baseline_eligible", "split",
    )


@query(f"""{PREPARED_CTE} SELECT row_id, source_record_number, flag_duplicate_candidate, duplicate_of_row_id FROM prepared""")
def duplicate_flags(spark, sf_dir):
    flagged = prepare.flag_duplicates(view(spark, sf_dir, text_departures, parse_heavy=True))
    return flagged.select("row_id", "source_record_number", "flag_duplicate_candidate", "duplicate_of_row_id")


@query(f"""{PREPARED_CTE} SELECT row_id, split, baseline_eligible, flag_invalid_location FROM prepared
WHERE NOT baseline_eligible OR flag_invalid_location""")
def review_subset(spark, sf_dir):
    return prepare.review_subset(prepared(spark, sf_dir)).select(
        "row_id", "split", "baseline_eligible", "flag_invalid_location"
    )


@query(f"""{PREPARED_CTE} SELECT split, count(*) AS rows, count(*) FILTER (WHERE baseline_eligible) AS baseline_eligible,
       count(*) FILTER (WHERE flag_extreme_delay) AS extreme_delay,
       count(*) FILTER (WHERE flag_duplicate_candidate) AS duplicate_candidates,
       min(scheduled_time_local) AS date_min, max(scheduled_time_local) AS date_max FROM prepared GROUP BY split""")
def split_profile(spark, sf_dir):
    return profile.split_profile(prepared(spark, sf_dir))


ROUTE_METRICS = {
    "rows": "true", "baseline_eligible_rows": "baseline_eligible", "invalid_required_rows": "NOT valid_required_fields",
    **{c: c for c in FLAG_COLUMNS}, "extreme_early_rows": "flag_extreme_delay AND delay_seconds < 0",
    "extreme_late_rows": "flag_extreme_delay AND delay_seconds > 0",
}


@query(PREPARED_CTE + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, count(*) FILTER (WHERE {c}) AS value FROM prepared" for n, c in ROUTE_METRICS.items()))
def route_profile(spark, sf_dir):
    return profile.route_profile(prepared(spark, sf_dir))


@query(f"""{PREPARED_CTE}, q AS (SELECT quantile_cont(delay_seconds, [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]) AS v FROM prepared)
SELECT unnest([0.0, 0.01, 0.5, 0.95, 0.99, 1.0])::double AS quantile, round(unnest(v)::double, 6) AS delay_seconds FROM q""")
def delay_quantiles(spark, sf_dir):
    return rounded(profile.delay_quantiles(prepared(spark, sf_dir)), 6, "delay_seconds")


@query(f"""{PREPARED_CTE} SELECT scheduled_date, count(*) AS rows FROM prepared WHERE flag_extreme_delay GROUP BY scheduled_date""")
def extreme_by_date(spark, sf_dir):
    return profile.extreme_by_date(prepared(spark, sf_dir))


SOURCE_COLUMNS = list(prepare.SOURCE_COLUMNS.values())


@query(PREPARED_CTE + "SELECT 'source_rows' AS metric, count(*) AS value FROM src" + "".join(
    f" UNION ALL SELECT 'missing_{c}', count(*) FILTER (WHERE {c} IS NULL) FROM src" for c in SOURCE_COLUMNS) + """
UNION ALL SELECT 'invalid_scheduled_times', count(*) FILTER (WHERE scheduled_time_local IS NULL) FROM typed
UNION ALL SELECT 'invalid_deviations', count(*) FILTER (WHERE delay_seconds IS NULL) FROM typed
UNION ALL SELECT 'deviations_with_commas', count(*) FILTER (WHERE contains(deviation_raw, ',')) FROM src
UNION ALL SELECT 'unique_stops', count(DISTINCT stop_number) FROM src
UNION ALL SELECT 'unique_routes', count(DISTINCT route_number) FROM src
UNION ALL SELECT 'duplicate_id_candidates', count(row_id) - count(DISTINCT row_id) FROM src""")
def source_profile(spark, sf_dir):
    return profile.source_profile(view(spark, sf_dir, text_departures, parse_heavy=True), SOURCE_COLUMNS)


@query(f"""WITH s AS (SELECT delay, scheduled, cast(id AS bigint) AS n FROM ({oracle(departures)}) d),
p AS (SELECT *, lag(scheduled) OVER (ORDER BY n) AS before FROM s)
SELECT count(*) AS rows, count(*) FILTER (WHERE scheduled < before) AS backward_steps,
       count(*) FILTER (WHERE scheduled IS NULL) AS unreadable_times,
       count(*) FILTER (WHERE scheduled < before OR scheduled IS NULL) = 0 AS is_sorted FROM p""")
def is_sorted(spark, sf_dir):
    rows = view(spark, sf_dir, departures).withColumn("n", F.col("id").cast("bigint"))
    return profile.order_breaks(rows, "scheduled", "n")


@query(f"""{PREPARED_CTE} SELECT destination AS value, count(*) AS rows FROM prepared WHERE destination IS NOT NULL GROUP BY destination""")
def value_counts(spark, sf_dir):
    return profile.value_counts(view(spark, sf_dir, text_departures, parse_heavy=True), "destination")


VISITS_CTE = f"WITH visits AS ({GROUPED} FROM ({oracle(departures)}) d)"


@query(f"""{VISITS_CTE}, observed AS (SELECT day, count(*) AS n FROM visits GROUP BY day),
calendar AS (SELECT unnest(generate_series(min(day), max(day), interval 1 day))::date AS day FROM observed)
SELECT day, coalesce(n, 0) AS rows FROM calendar LEFT JOIN observed USING (day)""")
def daily_coverage(spark, sf_dir):
    return profile.daily_coverage(_visits(spark, sf_dir))


@query(f"""WITH observed AS (SELECT DISTINCT cast(o_orderdate AS date) AS day FROM orders),
calendar AS (SELECT unnest(generate_series(min(day), max(day), interval 1 day))::date AS day FROM observed)
SELECT day FROM calendar ANTI JOIN observed USING (day)""")
def missing_dates(spark, sf_dir):
    orders = adapter.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return profile.missing_dates(orders)


@query(f"""{PREPARED_CTE}, train AS (SELECT * FROM prepared WHERE split = 'train' AND baseline_eligible),
hours AS (SELECT DISTINCT day_type, unnest(range(24))::integer AS hour FROM train),
medians AS (SELECT day_type, hour, median(delay_seconds)::double AS median, count(*) AS count FROM train
            GROUP BY day_type, hour HAVING count(*) >= 5)
SELECT day_type, hour, median, count FROM hours LEFT JOIN medians USING (day_type, hour)""")
def hour_profile(spark, sf_dir):
    rows = prepared(spark, sf_dir).where("split = 'train' and baseline_eligible")
    return profile.hour_profile(rows, minimum_count=5)


@query(f"""{PREPARED_CTE}
SELECT CASE WHEN delay_seconds BETWEEN -600 AND 1800 THEN least((delay_seconds + 600) // 24 + 1, 100) ELSE 0 END::integer AS bin,
       count(*) AS rows FROM prepared WHERE delay_seconds IS NOT NULL GROUP BY 1""")
def delay_histogram(spark, sf_dir):
    return profile.delay_histogram(prepared(spark, sf_dir))


@query(f"""{PREPARED_CTE} SELECT row_id, stop_number, destination, scheduled_time_local, delay_seconds FROM prepared
WHERE flag_extreme_delay ORDER BY abs(delay_seconds) DESC, row_id LIMIT 6""")
def top_delays(spark, sf_dir):
    return profile.top_delays(prepared(spark, sf_dir))


@query(f"""{PREPARED_CTE} SELECT stop_number, destination, median(delay_seconds)::double AS median, count(*) AS count
FROM prepared WHERE split = 'train' AND baseline_eligible GROUP BY stop_number, destination HAVING count(*) >= 50
ORDER BY median DESC, stop_number, destination LIMIT 10""")
def top_stops(spark, sf_dir):
    rows = prepared(spark, sf_dir).where("split = 'train' and baseline_eligible")
    return profile.top_stops(rows, minimum_count=50)


# --- Incident reports ---------------------------------------------------------------

METRES = (
    "12742000e0 * asin(least(1e0, sqrt(pow(sin((radians(s.lat) - radians(r.lat)) / 2), 2) + cos(radians(r.lat)) "
    "* cos(radians(s.lat)) * pow(sin((radians(s.lon) - radians(r.lon)) / 2), 2))))"
)
MATCH_CTE = f"""
WITH visits AS ({GROUPED} FROM ({adapter.departures("duckdb", 12).format(events="events")}) d),
reports AS (SELECT *, cast(reported AS date) AS day FROM ({oracle(reports)}) r),
scoped AS (
  SELECT *, type = 'Full Bus Pass-Up' AND day IN (SELECT day FROM visits) AS in_scope FROM reports),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rid, in_scope ORDER BY record_no) AS place FROM scoped),
screened AS (
  SELECT *, CASE WHEN type <> 'Full Bus Pass-Up' THEN 'other_type'
                 WHEN NOT in_scope THEN 'outside_covered_dates'
                 WHEN place > 1 THEN 'duplicate_report'
                 WHEN NOT (lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90) THEN 'invalid_coordinates' END AS reject_reason
  FROM ranked),
kept AS (SELECT * FROM screened WHERE reject_reason IS NULL),
stops AS (SELECT route, dest, day, stop, avg(lon) AS lon, avg(lat) AS lat FROM visits
          WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 GROUP BY route, dest, day, stop),
pairs AS (SELECT r.rid, s.stop, {METRES} AS metres FROM kept r JOIN stops s USING (route, dest, day)),
nearest AS (SELECT rid, min((metres, stop)) AS best FROM pairs GROUP BY rid),
matched AS (
  SELECT r.rid, r.route, CASE WHEN best[1] <= 150 THEN best[2] END AS stop, r.dest, r.day,
         CASE WHEN best[1] <= 150 THEN best[1] END AS metres,
         CASE WHEN dayofweek(reported) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS daytype,
         cast(hour(reported) - hour(reported) % 2 AS integer) AS hour
  FROM kept r LEFT JOIN nearest USING (rid)),
profiles AS (
  SELECT {KEYS},
         count(*) FILTER (WHERE metres <= 60) AS reports_60m, count(DISTINCT day) FILTER (WHERE metres <= 60) AS dates_60m,
         count(*) FILTER (WHERE metres <= 100) AS reports_100m, count(DISTINCT day) FILTER (WHERE metres <= 100) AS dates_100m,
         count(*) AS reports_150m, count(DISTINCT day) AS dates_150m,
         min(day) AS coverage_start, max(day) AS coverage_end
  FROM matched WHERE stop IS NOT NULL GROUP BY {KEYS}),
refs AS (SELECT {KEYS}, count(*) AS recorded_departures, count(DISTINCT day) AS departure_dates,
                min(day) AS reference_start, max(day) AS reference_end FROM visits GROUP BY {KEYS}),
evidence AS (
  SELECT {KEYS}, coalesce(recorded_departures, 0) AS recorded_departures, coalesce(departure_dates, 0) AS departure_dates,
         reference_start, reference_end, coalesce(reports_60m, 0) AS reports_60m, coalesce(dates_60m, 0) AS dates_60m,
         coalesce(reports_100m, 0) AS reports_100m, coalesce(dates_100m, 0) AS dates_100m,
         coalesce(reports_150m, 0) AS reports_150m, coalesce(dates_150m, 0) AS dates_150m, coverage_start, coverage_end
  FROM refs FULL JOIN profiles USING ({KEYS})),
judged AS (
  SELECT *, reports_150m::double / nullif(recorded_departures, 0) AS ratio,
         recorded_departures < 20 OR departure_dates < 5 AS thin FROM evidence),
labelled AS (
  SELECT *, CASE WHEN thin THEN 'insufficient_reference_history'
                 WHEN reports_150m > recorded_departures THEN 'reports_exceed_recorded_visits'
                 WHEN reports_150m = 0 AND recorded_departures < 24 THEN 'insufficient_zero_report_history'
                 WHEN ratio >= 0.15 AND dates_150m < 3 THEN 'insufficient_reporting_dates'
                 WHEN ratio < 0.15 AND ratio >= 0.05 AND dates_150m < 2 THEN 'insufficient_reporting_dates'
                 ELSE 'report_to_recorded_visit_ratio' END AS reason FROM judged),
classified AS (
  SELECT *, CASE WHEN reason <> 'report_to_recorded_visit_ratio' THEN 'unknown' WHEN ratio >= 0.15 THEN 'high'
                 WHEN ratio >= 0.05 THEN 'medium' ELSE 'low' END AS label FROM labelled)
"""
POLICY = policy.RatioPolicy(20, 5, 24, 0.05, 0.15, 2, 3)


def _screened(spark, sf_dir, visits):
    return spatial.screen_reports(view(spark, sf_dir, reports), visits.select("day"))


def _matched(spark, sf_dir):
    visits = _visits(spark, sf_dir, 12)
    kept = _screened(spark, sf_dir, visits).where("reject_reason is null")
    return visits, spatial.matched_reports(kept, visits)


@query(f"""{MATCH_CTE} SELECT rid, record_no, reject_reason FROM screened""")
def screened_reports(spark, sf_dir):
    return _screened(spark, sf_dir, _visits(spark, sf_dir, 12)).select("rid", "record_no", "reject_reason")


@query(f"""{MATCH_CTE} SELECT rid, {KEYS}, day, round(metres, 2) AS metres FROM matched""")
def nearest_stop(spark, sf_dir):
    _, matched = _matched(spark, sf_dir)
    return rounded(matched.select("rid", *GROUP, "day", "metres"), 2, "metres")


@query(f"""{MATCH_CTE} SELECT route, dest, day, stop, round(lon, 6) AS lon, round(lat, 6) AS lat FROM stops""")
def day_stops(spark, sf_dir):
    return rounded(spatial.day_stops(_visits(spark, sf_dir, 12)), 6, "lon", "lat")


@query(f"""{MATCH_CTE} SELECT * FROM profiles""")
def report_profiles(spark, sf_dir):
    return spatial.report_profiles(_matched(spark, sf_dir)[1])


@query(f"""{MATCH_CTE} SELECT * FROM refs""")
def reference_exposure(spark, sf_dir):
    return timing.reference_exposure(_visits(spark, sf_dir, 12))


@query(f"""{MATCH_CTE}
SELECT 'sourceReports' AS metric, count(*) AS value FROM screened
UNION ALL SELECT 'nonFullBusReports', count(*) FROM screened WHERE reject_reason = 'other_type'
UNION ALL SELECT 'outsideCoveredDates', count(*) FROM screened WHERE reject_reason = 'outside_covered_dates'
UNION ALL SELECT 'reportsOnCoveredDates', count(*) FROM screened WHERE in_scope
UNION ALL SELECT 'duplicateReports', count(*) FROM screened WHERE reject_reason = 'duplicate_report'
UNION ALL SELECT 'invalidCoordinates', count(*) FROM screened WHERE reject_reason = 'invalid_coordinates'
UNION ALL SELECT 'noNearbyStop', count(*) FROM matched WHERE stop IS NULL
UNION ALL SELECT 'matchedReports', count(stop) FROM matched
UNION ALL SELECT '60mReports', count(*) FROM matched WHERE metres <= 60
UNION ALL SELECT '100mReports', count(*) FROM matched WHERE metres <= 100
UNION ALL SELECT '150mReports', count(*) FROM matched WHERE metres <= 150""")
def match_audit(spark, sf_dir):
    visits = _visits(spark, sf_dir, 12)
    screened = _screened(spark, sf_dir, visits)
    matched = spatial.matched_reports(screened.where("reject_reason is null"), visits)
    return spatial.match_audit(screened, matched)


def _evidence(spark, sf_dir):
    visits, matched = _matched(spark, sf_dir)
    return policy.report_evidence(timing.reference_exposure(visits), spatial.report_profiles(matched))


@query(f"""{MATCH_CTE} SELECT *, reports_150m AS report_count, dates_150m AS report_dates FROM evidence""")
def report_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir)


@query(f"""{MATCH_CTE} SELECT {KEYS}, label, reason FROM classified""")
def policy_labels(spark, sf_dir):
    return policy.classify(_evidence(spark, sf_dir), POLICY).select(*GROUP, "label", "reason")


@query(MATCH_CTE + "SELECT 'groups' AS metric, count(*) AS value FROM classified"
       " UNION ALL SELECT 'groupsWithReports', count(*) FILTER (WHERE reports_150m > 0) FROM classified"
       + "".join(f" UNION ALL SELECT 'label_{x}', count(*) FILTER (WHERE label = '{x}') FROM classified" for x in policy.LABELS)
       + "".join(f" UNION ALL SELECT '{x}', count(*) FILTER (WHERE reason = '{x}') FROM classified" for x in (
           "insufficient_reference_history", "insufficient_reporting_dates", "insufficient_zero_report_history",
           "reports_exceed_recorded_visits"))
       + " UNION ALL SELECT 'groupsWithReportsWithoutReferenceDepartures',"
         " count(*) FILTER (WHERE reports_150m > 0 AND recorded_departures = 0) FROM classified")
def policy_summary(spark, sf_dir):
    return policy.summarize_policy(policy.classify(_evidence(spark, sf_dir), POLICY))


@query(f"""WITH r AS ({oracle(reports)})
SELECT rid, record_no, type, route, dest, reported FROM r WHERE cast(reported AS date) BETWEEN date '2024-01-05' AND date '2024-01-20'
AND type = 'Full Bus Pass-Up' AND contains(lower(concat_ws(' ', rid, dest)), 'ick')""")
def report_filter(spark, sf_dir):
    found = profile.filter_reports(
        view(spark, sf_dir, reports), "2024-01-05", "2024-01-20", kind="Full Bus Pass-Up", query="ICK"
    )
    return found.select("rid", "record_no", "type", "route", "dest", "reported")


@query(f"""WITH r AS (SELECT *, strftime(reported, '%Y-%m') AS m FROM ({oracle(reports)}) x),
spine AS (
  SELECT 'month' AS part, unnest(['2023-12', '2024-01', '2024-02', '2024-03']) AS member
  UNION ALL SELECT 'hour', printf('%02d', unnest(range(24))) UNION ALL SELECT 'weekday', unnest(range(7))::varchar
  UNION ALL SELECT 'missing_location', 'all' UNION ALL SELECT 'records', 'all'),
counted AS (
  SELECT 'month' AS part, m AS member, count(*) AS n FROM r GROUP BY m
  UNION ALL SELECT 'hour', strftime(reported, '%H'), count(*) FROM r GROUP BY 2
  UNION ALL SELECT 'weekday', (isodow(reported) - 1)::varchar, count(*) FROM r GROUP BY 2
  UNION ALL SELECT 'route', coalesce(route, ''), count(*) FROM r GROUP BY 2
  UNION ALL SELECT 'type', coalesce(type, ''), count(*) FROM r GROUP BY 2
  UNION ALL SELECT 'missing_location', 'all', count(*) FILTER (WHERE lon IS NULL OR lat IS NULL) FROM r
  UNION ALL SELECT 'records', 'all', count(*) FROM r)
SELECT part, member, coalesce(n, 0) AS records FROM spine FULL JOIN counted USING (part, member)""")
def report_summary(spark, sf_dir):
    return profile.report_summary(view(spark, sf_dir, reports), "2023-12-15", "2024-03-31")


# --- Exports ------------------------------------------------------------------------

CODED_CTE = f"""WITH r AS (SELECT *, coalesce(trim(route), '') AS route_value FROM ({oracle(reports)}) x),
routes AS (SELECT route, row_number() OVER (ORDER BY min(record_no)) - 1 AS code FROM r GROUP BY route),
types AS (SELECT type, row_number() OVER (ORDER BY min(record_no)) - 1 AS code FROM r GROUP BY type),
dests AS (SELECT dest, row_number() OVER (ORDER BY min(record_no)) - 1 AS code FROM r GROUP BY dest)"""


@query(f"""{CODED_CTE} SELECT strftime(reported, '%Y-%m') AS month, rid, reported, record_no, routes.code::integer AS route_index,
types.code::integer AS type_index, dests.code::integer AS destination_index
FROM r JOIN routes USING (route) JOIN types USING (type) JOIN dests USING (dest)""")
def sorted_export(spark, sf_dir):
    rows = view(spark, sf_dir, reports).withColumnRenamed("dest", "destination")
    return exports.coded_reports(rows)[0].drop("coordinates").orderBy("month", "reported", "record_no")


@query(f"""{PREPARED_CTE}, kept AS (SELECT * FROM prepared WHERE scheduled_time_local IS NOT NULL),
stops AS (SELECT stop_number, row_number() OVER (ORDER BY stop_number::bigint) - 1 AS code FROM kept GROUP BY stop_number),
dests AS (SELECT destination, row_number() OVER (ORDER BY destination) - 1 AS code FROM kept WHERE destination IS NOT NULL GROUP BY destination),
days AS (SELECT day_type, row_number() OVER (ORDER BY day_type) - 1 AS code FROM kept WHERE day_type IS NOT NULL GROUP BY day_type)
SELECT scheduled_date AS date, row_id, coalesce(stops.code, -1)::integer AS stop_index, coalesce(dests.code, -1)::integer AS destination_index,
       coalesce(days.code, -1)::integer AS day_type_index,
       (hour(scheduled_time_local) * 3600 + minute(scheduled_time_local) * 60 + second(scheduled_time_local))::integer AS seconds_after_midnight,
       delay_seconds, (flag_extreme_delay::int + 2 * flag_duplicate_candidate::int + 4 * flag_missing_destination::int
       + 8 * flag_missing_day_type::int + 16 * flag_invalid_location::int + 32 * (NOT valid_required_fields)::int)::integer AS quality_flags
FROM kept LEFT JOIN stops USING (stop_number) LEFT JOIN dests USING (destination) LEFT JOIN days USING (day_type)""")
def dictionary_codes(spark, sf_dir):
    dated = staged(prepared(spark, sf_dir).where("scheduled_time_local is not null"))
    return exports.coded_departures(dated)[0]


@query(f"""WITH r AS ({oracle(reports)}) SELECT strftime(reported, '%Y-%m') AS month, count(*) AS records,
cast(min(reported) AS date) AS first, cast(max(reported) AS date) AS last FROM r GROUP BY 1""")
def report_months(spark, sf_dir):
    rows = view(spark, sf_dir, reports).withColumn("month", F.date_format("reported", "yyyy-MM"))
    return exports.report_months(rows)


@query(f"""WITH r AS ({oracle(reports)}) SELECT 'records' AS metric, count(*) AS value FROM r
UNION ALL SELECT 'missingRoute', count(*) FILTER (WHERE coalesce(route, '') = '') FROM r
UNION ALL SELECT 'invalidLocation', count(*) FILTER (WHERE lon IS NULL OR lat IS NULL) FROM r
UNION ALL SELECT 'additionalDuplicateIds', count(*) - count(DISTINCT rid) FROM r""")
def report_gaps(spark, sf_dir):
    return exports.report_gaps(view(spark, sf_dir, reports))


@query(f"""WITH g AS (SELECT DISTINCT {KEYS} FROM ({GROUPED} FROM ({oracle(departures)}) d) v)
SELECT json_array(route, stop, dest, daytype, hour)::varchar AS group_key FROM g""")
def group_keys(spark, sf_dir):
    return _visits(spark, sf_dir).select(*GROUP).distinct().select(
        text.group_key_json(*[F.col(c) for c in GROUP]).alias("group_key"))


@query(f"""WITH d AS (SELECT DISTINCT dest FROM ({oracle(departures)}) x)
SELECT dest, prefix, regexp_replace(lower(trim(prefix || dest || '  ')), '^to\\s+', '') AS name
FROM d, (SELECT unnest(['', 'To ', '  TO   ', 'to', 'Into ']) AS prefix)""")
def destination_forms(spark, sf_dir):
    forms = F.explode(F.array(*[F.lit(p) for p in ("", "To ", "  TO   ", "to", "Into ")])).alias("prefix")
    return view(spark, sf_dir, departures).select("dest").distinct().select("dest", forms).select(
        "dest", "prefix", text.destination_name(F.concat("prefix", "dest", F.lit("  "))).alias("name"))


@query(f"""WITH d AS (SELECT *, cast(id AS bigint) AS n FROM ({oracle(departures)}) x)
SELECT id AS row_id FROM d WHERE n % 7 = 0 AND n % 3 = 0""")
def overlapping_splits(spark, sf_dir):
    """Ids dealt to two splits by different rules."""
    rows = view(spark, sf_dir, departures).select(F.col("id").alias("row_id"), F.col("id").cast("bigint").alias("n"))
    dealt = rows.where("n % 7 = 0").withColumn("split", F.lit("train")).unionByName(
        rows.where("n % 3 = 0").withColumn("split", F.lit("test")))
    return sets.split_overlap(dealt)


@query(f"""WITH d AS ({oracle(departures)})
SELECT id, scheduled::date AS day FROM d WHERE scheduled::date <> (SELECT min(scheduled::date) FROM d) OR scheduled IS NULL""")
def outside_the_day(spark, sf_dir):
    """Rows that a file of the first day may not hold."""
    rows = view(spark, sf_dir, departures)
    day = rows.agg(F.to_date(F.min("scheduled"))).first()[0]
    return sets.check_single_date(rows, "scheduled", str(day)).select("id", F.to_date("scheduled").alias("day"))


@query(f"""WITH d AS ({oracle(departures)}) SELECT id AS row_id, delay FROM d""")
def appended_days(spark, sf_dir):
    """A history and its newer rows, put together again."""
    rows = view(spark, sf_dir, departures).select(F.col("id").alias("row_id"), "delay", "scheduled")
    recent = F.coalesce(F.col("scheduled") >= F.lit("2024-01-16").cast("timestamp_ntz"), F.lit(False))
    return sets.append_disjoint(rows.where(~recent), rows.where(recent)).select("row_id", "delay")
