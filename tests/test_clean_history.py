"""The small end-to-end history build, from archives to stored results."""

import zipfile
from dataclasses import asdict
from datetime import datetime, timedelta

import pytest

from lagline.operators import clean
from lagline.operators.policy import RatioPolicy
from lagline.plans.history_build import build_history
from lagline.schemas import DEPARTURE_COLUMNS
from lagline.sources.capture import bundle_fingerprint, source_manifest
from lagline.sources.departures import read_departures_csv, read_departures_history
from lagline.sinks.builds import committed, verify_build
from lagline.sources.reports import read_reports
from tests.conftest import rows

HEADER = ["Row ID", "Stop Number", "Route Number", "Route Destination", "Day Type", "Scheduled Time", "Deviation", "Location"]


def line(ident, when, deviation="-120", iso=True):
    time = when.strftime("%Y-%m-%dT%H:%M:%S") if iso else when.strftime("%Y %b %d %I:%M:%S %p")
    kind = {5: "Saturday", 6: "Sunday"}.get(when.weekday(), "Weekday")
    return [ident, "1", "F8", "To Downtown", kind, time, deviation, "POINT (-97 49)"]


def text(lines, header=HEADER):
    return "\n".join(",".join(f'"{v}"' for v in row) for row in [header, *lines]) + "\n"


def weekdays(start, count):
    day = start
    while count:
        if day.weekday() < 5:
            yield day
            count -= 1
        day += timedelta(days=1)


@pytest.fixture()
def inputs(folder):
    july = [
        line(f"a{i}-{m}", d.replace(hour=13, minute=5 * m))
        for i, d in enumerate(weekdays(datetime(2025, 7, 1), 10)) for m in range(12)
    ]
    january = [
        line(f"b{i}-{m}", d.replace(hour=13, minute=5 * m))
        for i, d in enumerate(weekdays(datetime(2026, 1, 5), 6)) for m in range(6)
    ]
    extra = [
        line("early", datetime(2025, 6, 2, 13)), line("same-id", datetime(2025, 7, 2, 15), "-120"),
        line("same-id", datetime(2025, 7, 2, 15), "-240"), line("v1", datetime(2025, 7, 3, 15), "-120"),
        line("v2", datetime(2025, 7, 3, 15), "-240"), line("copy", datetime(2025, 7, 1, 13), "-120"),
    ]
    archive = f"{folder}/2025-07.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("july.csv", text(july + january + extra))
    recent = f"{folder}/recent.csv"
    first = line("a0-0", datetime(2025, 7, 1, 13), iso=False)
    with open(recent, "w") as f:
        f.write(text([first]))
    reports = f"{folder}/reports.csv"
    with open(reports, "w", encoding="utf-8-sig") as f:
        f.write("Pass-Up ID,Pass-Up Type,Time,Route Number,Route Name,Route Destination,Location\n")
        f.write("r1,Full Bus Pass-Up,07/01/2025 01:00:09 PM,F8,F8,Downtown,POINT (-97 49)\n")
        f.write("r2,Wheelchair User Pass-Up,07/01/2025 01:00:09 PM,F8,F8,Downtown,POINT (-97 49)\n")
    return archive, recent, reports


def test_history_build_refuses_unreadable_report_times(spark, folder, inputs):
    archive, recent, report_file = inputs
    with open(report_file, "a") as f:
        f.write("r9,Full Bus Pass-Up,13/45/2025,F8,F8,Downtown,POINT (-97 49)\n")
    with pytest.raises(ValueError, match="record 3"):
        build_history(spark, read_departures_history(spark, [archive, recent]), read_reports(spark, report_file), f"{folder}/work", f"{folder}/out")


def test_files_with_different_headers_are_refused(spark, folder):
    names = list(DEPARTURE_COLUMNS)
    for k, columns in enumerate((names, names[::-1])):
        with open(f"{folder}/{k}.csv", "w", encoding="utf-8-sig") as f:
            f.write(",".join(columns) + "\n" + ",".join(f"value of {c}" for c in columns) + "\n")
    one = read_departures_csv(spark, f"{folder}/1.csv").first()
    assert all(one[c] == f"value of {c}" for c in names)
    with pytest.raises(Exception, match="header"):
        read_departures_csv(spark, folder).collect()


def test_history_build(spark, folder, inputs):
    archive, recent, report_file = inputs
    raw = read_departures_history(spark, [archive, recent])
    audit = dict(rows(clean.clean_audit(raw)))
    assert audit["conflictingSourceIds"] == 1 and audit["conflictingVisitIdentities"] == 1
    assert audit["collapsedConsistentCopies"] == 1 and audit["retainedRecordedVisits"] == 156
    assert audit["beforeOverhaulRows"] == 1 and audit["distinctSourceRows"] == 161
    out = build_history(spark, raw, read_reports(spark, report_file), f"{folder}/work", f"{folder}/out", sources=[archive, recent])
    assert out["fingerprint"].first()["files"] == 2 and spark.read.json(f"{folder}/out/manifest").count() == 2
    (group,) = out["timing"].collect()
    assert [group[c] for c in clean.GROUP] == ["F8", "1", "downtown", "weekday", 12]
    assert (group["observations"], group["distinct_dates"], group["median_seconds"]) == (156, 16, 120)
    assert group["nearby_reports"] == 1
    assert dict(rows(out["report_audit"]))["matchedReports"] == 1
    stored = spark.read.json(f"{folder}/out/timing")
    assert stored.first()["group_key"] == '["F8","1","downtown","weekday",12]' and stored.first()["route"] == "F8"
    assert spark.read.json(f"{folder}/out/report_evidence").count() == 1
    stated = committed(spark, f"{folder}/out")
    assert (stated["eligibleGroups"], stated["reportGroups"], stated["routes"], stated["policy"]) == (1, 1, 1, asdict(RatioPolicy()))
    assert stated["coverage"] == {"start": "2025-07-01", "end": "2026-01-12"}
    assert rows(out["routes"]) == [("F8", 1, 1)]
    assert out["policy"].count() > 0 and rows(verify_build(spark, f"{folder}/out").where("not as_written")) == []


def test_archive_must_hold_one_csv(spark, folder):
    path = f"{folder}/two.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("a.csv", text([]))
        z.writestr("b.csv", text([]))
    with pytest.raises(Exception, match="exactly one CSV"):
        read_departures_history(spark, [path]).count()


def test_record_numbers_follow_the_file(spark, folder):
    path = f"{folder}/all.csv"
    lines = [[str(i), "06001", "BLUE" if i % 3 else "66", "BLUE", " ", "Weekday", "2026 Aug 10 08:00:00 AM", str(i), "POINT (-97 49)"] for i in range(5000)]
    with open(path, "w") as f:
        f.write(text(lines, DEPARTURE_COLUMNS))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        frame = read_departures_csv(spark, path, route="BLUE")
        found = {int(r["Row ID"]): (r["source_record_number"], r["Route Destination"], r["Stop Number"]) for r in frame.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {i: (i + 1, None, "06001") for i in range(5000) if i % 3}


def test_unexpected_header_is_an_error(spark, folder):
    path = f"{folder}/bad.csv"
    with open(path, "w") as f:
        f.write(text([], HEADER))
    with pytest.raises(ValueError, match="are needed"):
        read_departures_csv(spark, path)


def test_manifest(spark, folder):
    path = f"{folder}/abc.txt"
    with open(path, "w") as f:
        f.write("abc")
    manifest = source_manifest(spark, path)
    assert rows(manifest) == [("abc.txt", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", 3)]
    assert len(bundle_fingerprint(manifest, "2025-06-29").first()["sha256"]) == 64


def test_conflict_counts_nulls_as_values(spark):
    base = ("i", "r", "s", "d", datetime(2026, 1, 5, 8), 1, "Weekday", 1.0, 1.0)
    other = (*base[:6], None, 1.0, 1.0)
    raw = spark.createDataFrame([base, other], "id string, route string, stop string, dest string, scheduled timestamp_ntz, delay bigint, service string, lon double, lat double")
    assert rows(clean.conflicting_ids(clean.usable_rows(raw))) == [("i",)]
    assert clean.clean_visits(raw).count() == 0
