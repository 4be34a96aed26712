"""Chronological folds, candidate ranking and the untouched holdout."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Fold:
    validation_start: str
    validation_end_exclusive: str


@dataclass(frozen=True)
class Plan:
    train_start: str
    final_training_end_exclusive: str
    holdout_start: str
    holdout_end_exclusive: str
    folds: list[Fold]
    candidates: list[dict] = field(default_factory=list)

    def __post_init__(self):
        at = datetime.fromisoformat
        start, end = at(self.train_start), at(self.final_training_end_exclusive)
        if not start < end <= at(self.holdout_start) < at(self.holdout_end_exclusive):
            raise ValueError("training has to end before the holdout starts")
        previous = start
        for fold in self.folds:
            a, b = at(fold.validation_start), at(fold.validation_end_exclusive)
            if not start < a < b <= end or a < previous:
                raise ValueError("folds have to follow each other without overlap and end before the holdout")
            previous = b
        names = [c["name"] for c in self.candidates]
        if len(names) != len(set(names)) or (names and "reference" not in names):
            raise ValueError("candidates need names of their own, one of them reference")


TIME = "scheduled_time_local"


def between(rows: DataFrame, start: str, end: str) -> DataFrame:
    at = lambda v: F.lit(v).cast("timestamp_ntz")
    return rows.where((F.col(TIME) >= at(start)) & (F.col(TIME) < at(end)))


def fold_rows(development: DataFrame, plan: Plan, fold: Fold) -> tuple[DataFrame, DataFrame]:
    """Eligible rows before the window, and valid rows inside it."""
    train = between(development, plan.train_start, fold.validation_start).where("baseline_eligible")
    validation = between(development, fold.validation_start, fold.validation_end_exclusive).where(
        "valid_required_fields"
    )
    return train, validation


def final_training(rows: DataFrame, plan: Plan) -> DataFrame:
    return between(rows, plan.train_start, plan.final_training_end_exclusive).where("baseline_eligible")


def holdout_rows(rows: DataFrame, plan: Plan) -> DataFrame:
    return between(rows, plan.holdout_start, plan.holdout_end_exclusive).where("valid_required_fields")


def rank_candidates(records: DataFrame) -> DataFrame:
    """Mean fold error and median size per candidate, best first.

    `records`: candidate, fold, mae_seconds, tree_count - one row per fit.
    """
    return (
        records.groupBy("candidate")
        .agg(
            F.avg("mae_seconds").alias("mean_validation_mae_seconds"),
            F.floor(F.median("tree_count")).cast("bigint").alias("final_tree_count"),
            F.count(F.lit(1)).alias("folds"),
        )
        .orderBy("mean_validation_mae_seconds", "final_tree_count", "candidate")
    )


def best_candidate(
    scores: DataFrame, name: str = "candidate", score: str = "mae_seconds", by: list[str] | None = None
) -> DataFrame:
    """The lowest score and its candidate, of equal ones the first by name; one row for each value of `by`."""
    return scores.groupBy(*by or []).agg(F.min_by(name, F.struct(score, name)).alias(name), F.min(score).alias(score))
