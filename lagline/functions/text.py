"""Column expressions for identifiers, numbers and destination names held as text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Fixed value: digits with an optional sign, either plain or grouped in thousands.
GROUPED_INTEGER = r"^[+-]?(?:\d+|\d{1,3}(?:,\d{3})+)$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank_to_null(text: Column) -> Column:
    return F.when(F.regexp_replace(text, r"\s", "") != "", text)


def strict_integer(text: Column) -> Column:
    """Whole seconds; thousands commas only where they group correctly, else null."""
    clean = stripped(text)
    return F.when(clean.rlike(GROUPED_INTEGER), F.regexp_replace(clean, ",", "").try_cast("bigint"))


def lenient_integer(text: Column) -> Column:
    """Drop every comma, then round what still reads as a number."""
    plain = F.regexp_replace(text, ",", "").try_cast("decimal(38,6)")
    return F.round(plain, 0).try_cast("bigint")


def destination_name(text: Column) -> Column:
    """Trimmed lower case without a leading 'to '."""
    return F.regexp_replace(F.lower(F.trim(text)), r"^to\s+", "")


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(
        lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split())
    )


def destination_match_key(text: Column, unicode_aware: bool = True) -> Column:
    """Presentation-free name for exact linkage: compatibility form, case fold, single spaces.

    Compatibility normalisation has no SQL built-in. ASCII text takes the JVM
    expression and reaches the Arrow function only as null.
    """
    value = F.coalesce(text, F.lit(""))
    native = F.trim(F.regexp_replace(F.lower(value), r"[\s\x1c-\x1f]+", " "))
    if not unicode_aware:
        return native
    ascii_only = value.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, native).otherwise(_folded(F.when(~ascii_only, value)))


def lenient_boolean(text: Column) -> Column:
    lowered = F.lower(text)
    return F.when(lowered.isin("true", "1"), F.lit(True)).when(lowered.isin("false", "0"), F.lit(False))


def group_key_json(route: Column, stop: Column, dest: Column, daytype: Column, hour: Column) -> Column:
    """Timing-group key as compact JSON text, rendered only at export."""
    names = F.regexp_replace(F.to_json(F.array(route, stop, dest, daytype)), r"\]$", "")
    return F.concat(names, F.lit(","), hour.cast("string"), F.lit("]"))
