"""The full history job: raw departures and reports to timing, evidence and policy tables."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from lagline.operators import clean, policy, profile, spatial, timing
from lagline.sinks.builds import Build
from lagline.sinks.exports import with_key_text
from lagline.sinks.tables import write_table
from lagline.sources.capture import bundle_fingerprint, source_manifest
from lagline.sources.reports import require_times


def build_history(
    spark: SparkSession,
    raw: DataFrame,
    reports: DataFrame,
    work: str,
    output: str,
    cutoff: str = clean.CUTOFF,
    min_observations: int = timing.MIN_OBSERVATIONS,
    min_dates: int = timing.MIN_DATES,
    rules: policy.RatioPolicy = policy.RatioPolicy(),
    sources: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Clean once into a stored visits table, then derive every result from it.

    All routes are summarised in one pass; only the write splits by route. `sources`
    names the input files, whose sizes and digests then join the source report. The output is
    a committed build: its tables count once the file that states routes, groups, coverage,
    rules and sources stands beside them. Results are returned as stored.
    """
    require_times(reports.where(F.col("type") == spatial.FULL_BUS))
    write_table(clean.clean_visits(raw, cutoff), f"{work}/visits", partition_by=["day"])
    visits = spark.read.parquet(f"{work}/visits")
    coverage = profile.daily_coverage(visits).where("rows > 0")
    screened = spatial.screen_reports(reports, coverage)
    matched = spatial.matched_reports(screened.where("reject_reason is null"), visits)
    profiles = spatial.report_profiles(matched)
    evidence = policy.classify(policy.report_evidence(timing.reference_exposure(visits), profiles), rules)
    groups = timing.timing_groups(
        visits, min_observations=min_observations, min_dates=min_dates, reports=profiles
    )
    build = Build(spark, output)
    stored = {
        "timing": build.write("timing", with_key_text(groups), "json", ["route"]),
        "evidence": build.write("report_evidence", with_key_text(evidence), "json", ["route"]),
    }
    counted = [
        stored[name].groupBy("route").agg(F.count(F.lit(1)).alias(f"{name}_groups")) for name in ("timing", "evidence")
    ]
    results = {
        "audit": clean.clean_audit(raw, cutoff), "coverage": coverage,
        "report_audit": spatial.match_audit(screened, matched), "policy": policy.summarize_policy(stored["evidence"]),
        "routes": counted[0].join(counted[1], "route", "full_outer").na.fill(0),
    }
    if sources:
        results["manifest"] = source_manifest(spark, sources)
        results["fingerprint"] = bundle_fingerprint(results["manifest"], cutoff)
    range_of = {"start": F.min("day"), "end": F.max("day")}
    for name, frame in results.items():
        stored[name] = build.write(name, frame, "json", facts=range_of if name == "coverage" else None)
    build.commit(
        grouping=clean.GROUP, cutoff=cutoff, minObservations=min_observations, minDates=min_dates, policy=asdict(rules),
        eligibleGroups=build.tables["timing"]["rows"], reportGroups=build.tables["report_evidence"]["rows"],
        routes=build.tables["routes"]["rows"], coverage=build.tables["coverage"]["facts"],
    )
    return {**stored, "visits": visits, "matched": matched}
