"""Computing costly columns exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_columns_once(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row generator.

    The optimizer merges projections and pushes filters down, which copies a parse into
    every place that reads it. It does neither across a generator, so what is parsed
    here is parsed once; the generator itself emits one row per row.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [c for c in frame.columns if c not in columns]
    return frame.select(*kept, F.inline(F.array(row)))


def let(value: Column, body) -> Column:
    """`body` over a value that is computed once, for expressions inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
