"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a column expression over the words and lines of a text. On a bounded sample
the cascade times each rule and counts what it rejects, and then evaluates the rules by
rejections per second: a document leaves at the first rule that it fails, and dearer rules
after it are not evaluated for it. The order changes the reason reported, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lagline.functions.once import with_columns_once

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SAMPLE_ROWS = 2000


def let(value: Column, body) -> Column:
    """`body` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(text) - F.regexp_count(text, F.lit(SPACE))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def repeat_words(tokens: Column) -> Column:
    """Words inside three-word windows that stand twice or more in the text.

    Windows are 64-bit hashes. Each is sorted with its place; neighbours in that order that
    agree give the repeated places, and consecutive places tell how many words they cover.
    """
    hashes = F.transform(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )

    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda a: F.filter(a, lambda x, k: (
            x["h"].eqNullSafe(F.get(a, k - 1)["h"]) | x["h"].eqNullSafe(F.get(a, k + 1)["h"]))))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    # Most texts repeat no window, which a hash set tells sooner than the sort.
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        let(places(h), covered)))


@dataclass(frozen=True)
class Rule:
    """`failed` maps the statistics to a boolean; `needs` names the statistics it reads."""

    name: str
    needs: tuple[str, ...]
    failed: object
    base: bool = False


#: Base rules as the contract states them, and bounds that running prose keeps to with a wide margin.
RULES = (
    Rule("few_words", ("n_words",), lambda s: s["n_words"] < 50, True),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda s: 100 * s["n_repeat_words"] > 50 * s["n_words"], True),
    Rule("symbols", ("n_words", "n_symbols"), lambda s: 10 * s["n_symbols"] > s["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 25 * s["n_words"])),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda s: 2 * s["n_dup_lines"] > s["n_lines"]),
)


def statistics(text: Column, tokens: Column) -> dict[str, Column]:
    """The statistics by name, as bigint. `tokens` are the words of `text`, computed once."""
    made = {
        "n_words": F.size(tokens),
        "word_chars": word_chars(text),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": dup_lines(text),
        "n_repeat_words": repeat_words(tokens),
        "n_lines": F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))),
    }
    return {k: v.cast("bigint") for k, v in made.items()}


@dataclass
class Cascade:
    """Rules in evaluation order, with what the sample showed."""

    rules: tuple[Rule, ...]
    measured: dict[str, dict[str, float]] = field(default_factory=dict)


def _tokens(documents: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return with_columns_once(documents.withColumn("__text", whole), {"__words": words(F.col("__text"))})


def plan_cascade(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Cascade:
    """Order rules by rejections per second over at most `sample_rows` rows.

    The sample decides the order of evaluation only. Rules that read the same statistics
    pay for them again, as they would when an earlier rule did not need them.
    """
    share = documents.select(text).limit(sample_rows)
    sample = _tokens(share, text).select("__text", "__words").persist()
    try:
        total = sample.count()
        if not total:
            return Cascade(tuple(rules))
        stats = statistics(F.col("__text"), F.col("__words"))
        found: dict[str, dict[str, float]] = {}
        for rule in rules:
            started = time.perf_counter()
            failed = sample.select(rule.failed(stats).alias("f")).agg(F.count_if("f")).first()[0]
            seconds = time.perf_counter() - started
            found[rule.name] = {"cost": seconds / total, "rejects": failed / total}
        rate = lambda r: found[r.name]["rejects"] / max(found[r.name]["cost"], 1e-9)
        return Cascade(tuple(sorted(rules, key=lambda r: (-rate(r), found[r.name]["cost"], r.name))), found)
    finally:
        sample.unpersist()


def apply_cascade(documents: DataFrame, cascade: Cascade, text: str = "text", with_statistics: bool = False) -> DataFrame:
    """Add rejected_by (null for a kept document) and kept, with the statistics on request.

    Each rule's expressions stand in its own branch, so a branch that is not reached costs
    nothing. A null text counts as empty and is rejected for its few words. Rows are judged
    one by one: repeated rows get equal verdicts. Columns with the added names are replaced.
    """
    names = [k for k in statistics(F.lit(""), F.array()) if k != "n_lines"]
    documents = documents.drop("rejected_by", "kept", *(names if with_statistics else []))
    columns = documents.columns
    rows = _tokens(documents, text)
    stats = statistics(F.col("__text"), F.col("__words"))
    if with_statistics:
        rows = with_columns_once(rows, {f"__{k}": v for k, v in stats.items()})
        stats = {k: F.col(f"__{k}") for k in stats}
    verdict = F.coalesce(*[F.when(rule.failed(stats), F.lit(rule.name)) for rule in cascade.rules]) if cascade.rules else F.lit(None).cast("string")
    rows = with_columns_once(rows, {"rejected_by": verdict})
    return rows.select(
        *columns, *([stats[k].alias(k) for k in names] if with_statistics else []),
        "rejected_by", F.col("rejected_by").isNull().alias("kept"),
    )
