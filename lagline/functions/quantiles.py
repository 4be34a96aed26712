"""Exact, linearly interpolated quantiles.

Delays are whole seconds inside a bounded range, so a group's value counts stay small
and the built-in `percentile` merges them map-side. Continuous values have no such
bound: `exact_quantiles` narrows the interval that holds a wanted rank by repeated equal
splitting until few enough rows are left in it to sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lagline.staging import staged

SPLITS = 1024  # parts of an interval in one round; a window never sees more rows than this,
ENOUGH = 65_536  # or than these, which is when an interval is sorted


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """One row per key with a column per wanted quantile of `value`, exact for any spread.

    Every wanted rank has an interval, at first from the key's least to its largest value. A
    round counts the interval's values in SPLITS equal parts, map-side, and keeps the part with
    the rank, cut to the values in it; the least and the largest value always part, so equal
    values however many end a search and all others go on until at most ENOUGH rows are left.
    No group is ever gathered whole, with or without keys. Nulls do not count.
    """
    values = staged(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), "values")
    ranks = F.explode(F.array(*[
        F.struct(F.lit(name).alias("q"), F.lit(side).alias("side"), F.lit(float(p)).alias("p")) for name, p in quantiles.items() for side in (0, 1)
    ]))
    whole = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    at = F.col("_rank.p") * (F.col("_n") - 1)
    active = staged(
        whole.withColumn("_rank", ranks).withColumn("_at", at).select(
            *keys, F.col("_rank.q").alias("_q"), F.col("_rank.side").alias("_side"), (F.col("_at") - F.floor("_at")).alias("_frac"),
            F.when(F.col("_rank.side") == 0, F.floor("_at")).otherwise(F.ceil("_at")).alias("_k"), "_lo", "_hi", "_n",
        ), "ranks")
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_n") > ENOUGH)
    # Halves first, as the difference of two finite values need not be finite.
    part = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * SPLITS), F.lit(SPLITS - 1))
    place = [*keys, "_lo", "_hi"]
    while not active.where(wide).isEmpty():
        counted = _inside(values, active.where(wide), keys).groupBy(*place, part.alias("_part")).agg(
            F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_from"), F.max("_v").alias("_upto"))
        upto = F.sum("_m").over(W.partitionBy(*place).orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow))
        narrower = _with_rank(active.where(wide), counted.withColumn("_to", upto), place).select(
            *keys, "_q", "_side", "_frac", (F.col("_k") - F.col("_to") + F.col("_m")).alias("_k"),
            F.col("_from").alias("_lo"), F.col("_upto").alias("_hi"), F.col("_m").alias("_n"))
        active = staged(active.where(~wide).unionByName(narrower), "ranks")
    few = active.where("_lo < _hi")
    held = _inside(values, few, keys).groupBy(*place, "_v").agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(W.partitionBy(*place).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = _with_rank(few, held.withColumn("_to", upto), place).select(*keys, "_q", "_side", "_frac", "_v")
    found = found.unionByName(active.where("_lo = _hi").select(*keys, "_q", "_side", "_frac", F.col("_lo").alias("_v")))

    def value_at(name: str, side: int):
        return F.max(F.when((F.col("_q") == name) & (F.col("_side") == side), F.col("_v")))

    columns = []
    for name in quantiles:
        frac = F.max(F.when(F.col("_q") == name, F.col("_frac")))
        columns.append((value_at(name, 0) + (value_at(name, 1) - value_at(name, 0)) * frac).alias(name))
    return found.groupBy(*keys).agg(*columns)


def _inside(values: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _lo, _hi, _v): the values of each interval that some rank needs."""
    intervals = ranks.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_lo", "_hi").distinct()
    if not keys:
        intervals = F.broadcast(intervals)  # two ranks per quantile at most
    condition = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    for k in keys:
        condition = condition & values[k].eqNullSafe(F.col(f"_r_{k}"))
    return values.join(intervals, condition).drop(*[f"_r_{k}" for k in keys])


def _with_rank(ranks: DataFrame, counted: DataFrame, place: list[str]) -> DataFrame:
    """Each rank with the counted row that holds it; `_to` counts the values up to that row's end."""
    named = counted.withColumnsRenamed({c: f"_r{c}" for c in place})
    condition = (F.col("_k") < F.col("_to")) & (F.col("_k") >= F.col("_to") - F.col("_m"))
    for c in place:
        condition = condition & ranks[c].eqNullSafe(F.col(f"_r{c}"))
    return ranks.join(named, condition)
