"""Report evidence per group and the report-to-departure ratio categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lagline.operators.clean import GROUP, as_metrics
from lagline.operators.spatial import PROFILES

LABELS = ["low", "medium", "high", "unknown"]


@dataclass(frozen=True)
class RatioPolicy:
    minimum_departures: int = 60
    minimum_departure_dates: int = 10
    zero_report_minimum_departures: int = 120
    medium_ratio: float = 0.01
    high_ratio: float = 0.025
    medium_report_dates: int = 2
    high_report_dates: int = 3


def report_evidence(references: DataFrame, reports: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Union of reference groups and report groups; the absent side counts zero.

    Report groups of a route without any visit are left out, as the reference
    routes define the scope.
    """
    routes = references.select("route").distinct()
    counts = [f"{kind}_{name}" for name in PROFILES for kind in ("reports", "dates")]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return (
        references.join(reports.join(routes, "route", "left_semi"), keys, "full_outer")
        .select(
            *keys, zero("recorded_departures"), zero("departure_dates"), "reference_start", "reference_end",
            *[zero(c) for c in counts], "coverage_start", "coverage_end",
        )
        .withColumns({"report_count": F.col("reports_150m"), "report_dates": F.col("dates_150m")})
    )


def classify(evidence: DataFrame, policy: RatioPolicy = RatioPolicy()) -> DataFrame:
    """Add `label` and `reason`; the rules apply in this order."""
    reports, dates = F.col("report_count"), F.col("report_dates")
    departures = F.col("recorded_departures")
    ratio = reports / F.nullif(departures, F.lit(0))
    thin = (departures < policy.minimum_departures) | (
        F.col("departure_dates") < policy.minimum_departure_dates
    )
    reason = (
        F.when(thin, F.lit("insufficient_reference_history"))
        .when(reports > departures, F.lit("reports_exceed_recorded_visits"))
        .when(
            (reports == 0) & (departures < policy.zero_report_minimum_departures),
            F.lit("insufficient_zero_report_history"),
        )
        .when((ratio >= policy.high_ratio) & (dates < policy.high_report_dates), F.lit("insufficient_reporting_dates"))
        .when(
            (ratio >= policy.medium_ratio) & (ratio < policy.high_ratio) & (dates < policy.medium_report_dates),
            F.lit("insufficient_reporting_dates"),
        )
        .otherwise(F.lit("report_to_recorded_visit_ratio"))
    )
    label = (
        F.when(F.col("reason") != "report_to_recorded_visit_ratio", F.lit("unknown"))
        .when(ratio >= policy.high_ratio, F.lit("high"))
        .when(ratio >= policy.medium_ratio, F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    return evidence.withColumn("reason", reason).withColumn("label", label)


def summarize_policy(classified: DataFrame) -> DataFrame:
    """Labels, unknown reasons and group totals as (metric, value) rows."""
    reasons = [
        "insufficient_reference_history", "insufficient_reporting_dates", "insufficient_zero_report_history",
        "reports_exceed_recorded_visits",
    ]
    unknown = F.col("label") == "unknown"
    return as_metrics(
        classified.agg(
            F.count(F.lit(1)).alias("groups"),
            F.count_if(F.col("report_count") > 0).alias("groupsWithReports"),
            *[F.count_if(F.col("label") == name).alias(f"label_{name}") for name in LABELS],
            *[F.count_if(unknown & (F.col("reason") == name)).alias(name) for name in reasons],
            F.count_if((F.col("report_count") > 0) & (F.col("recorded_departures") == 0)).alias(
                "groupsWithReportsWithoutReferenceDepartures"
            ),
        )
    )
