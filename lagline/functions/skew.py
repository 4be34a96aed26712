"""Joining one-row-per-key facts back to rows when a key may own much of the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# A key is hot from this many rows on. At most (rows / HOT_ROWS) keys can be hot, so
# the broadcast below is bounded by counting: a table of 10^12 rows has at most
# 200,000 hot keys.
HOT_ROWS = 5_000_000
SPREAD = 1024


def attach_by_key(
    rows: DataFrame,
    facts: DataFrame,
    keys: list[str],
    weight: str,
    hot_rows: int = HOT_ROWS,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Left join `facts` (unique per `keys`; nulls match nulls) to `rows`.

    `weight` is the column of `facts` that counts the key's rows. Hot keys get their
    facts by broadcast; in the ordinary join that follows, their rows are already
    answered and spread over many partitions by a hash of `spread_by` (by default the
    whole row), which repeats exactly when a task is retried.
    """
    values = [c for c in facts.columns if c not in keys and c != weight]
    packed = facts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(weight).alias("_w"), F.struct(*values).alias("_v")
    )
    hot = packed.where(F.col("_w") >= hot_rows).select(*[f"_k_{k}" for k in keys], F.col("_v").alias("_hot"))
    cold = packed.where(F.col("_w") < hot_rows).select(
        *[F.col(f"_k_{k}").alias(f"_c_{k}") for k in keys], F.col("_v").alias("_cold"), F.lit(0).alias("_home")
    )
    names = spread_by or [f.name for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
    slot = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*names), F.lit(SPREAD)) + 1).otherwise(0)
    joined = (
        rows.join(F.broadcast(hot), _same("_k_", keys), "left")
        .withColumn("_slot", slot.cast("int"))
        .join(cold, _same("_c_", keys) & (F.col("_slot") == F.col("_home")), "left")
    )
    answer = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[answer[v].alias(v) for v in values])


def _same(prefix: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])
