"""Writing and checking stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lagline.operators.metrics import finite
from lagline.operators.prepare import review_subset
from lagline.operators.sets import same_rows


def write_table(frame: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> str:
    """Compressed Parquet. Partitioned output is rebalanced first, so a hot partition
    value is written by several tasks and a small one by a single task."""
    if partition_by:
        frame = frame.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = frame.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_prepared(prepared: DataFrame, root: str) -> dict[str, str]:
    """Prepared departures and the subset that needs review."""
    paths = {"prepared": write_table(prepared, f"{root}/prepared")}
    stored = prepared.sparkSession.read.parquet(paths["prepared"])
    paths["review"] = write_table(review_subset(stored), f"{root}/review")
    return paths


def write_lookup(model: DataFrame, path: str) -> str:
    """A fitted lookup: one row per level and key tuple, the global median among them."""
    return write_table(model, path)


def verify_stored(frame: DataFrame, path: str) -> None:
    """The stored table holds exactly the rows of the frame."""
    if not same_rows(frame, frame.sparkSession.read.parquet(path)):
        raise ValueError(f"Stored rows at {path} differ from the written frame.")


def verify_metric(path_frame: DataFrame, actual: str, predicted: str, expected_mae: float, tolerance: float = 1e-9) -> None:
    """The error of stored predictions is the error that was reported."""
    found = path_frame.agg(F.avg(F.abs(finite(F.col(predicted)) - finite(F.col(actual))))).first()[0]
    if found is None or expected_mae is None or abs(found - expected_mae) > tolerance:
        raise ValueError(f"Stored predictions give {found}, reported {expected_mae}.")
