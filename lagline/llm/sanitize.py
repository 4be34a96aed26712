"""Personal data: fixed forms, and terms that give a protected entity away.

Fixed forms (e-mail, IPv4, card, phone) are entities. From the whole corpus come counts of
entities, of words and of texts that hold both; the pointwise mutual information of a word
and an entity, as a share of the entity's own information, says how much of the entity the
word discloses. In texts with the entity, words above a threshold are generalised to their
form, and words that disclose nearly all of it are removed, wherever they stand.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lagline.llm.kit import map_rows
from lagline.staging import staged

KINDS = ("email", "ip", "card", "phone", "term")
NEAR = 8  # words on either side of an entity that make its surroundings
SUPPORT = 3  # different surroundings of the entity in texts with the word
GENERALISE, REMOVE = 0.6, 0.9  # disclosed share of an entity's information

# The base forms. Possessive digits only save retries that cannot match.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches. The local part before an @ is the run of its characters after the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base form, by start and kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """One name for an entity however it is written."""
    start, kind, end = span
    value = text[start:end]
    return KINDS[kind] + ":" + (value.lower() if kind < 2 else re.sub(r"\D", "", value))


def words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of each word that overlaps no base span, in order; `spans` are sorted."""
    k = end = 0  # end: the furthest one of the spans before k
    for m in WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            end = max(end, spans[k][2])
            k += 1
        if end <= m.start():
            yield m.start(), m.end()


def places(text: str, spans: list[tuple[int, int, int]]) -> dict[str, int]:
    """Each entity with a fingerprint of the words within NEAR words of it, words inside spans left out."""
    ends = list(accumulate((e for _, _, e in spans), max))
    starts = [s for s, _, _ in spans]
    around: dict[str, list[str]] = {}
    for span in spans:
        found = around.setdefault(entity(text, span), [])
        # A window of text that holds NEAR words unless they are extremely long; then it grows.
        for start, end in (*_left(text, span[0]), *_right(text, span[2])):
            before = bisect_left(starts, end)  # spans that start before the word ends
            if not before or ends[before - 1] <= start:
                found.append(text[start:end].lower())
    return {name: _fingerprint(" ".join(found)) for name, found in around.items()}


def _right(text: str, at: int) -> list[tuple[int, int]]:
    out = []
    for m in WORD.finditer(text, at):
        out.append((m.start(), m.end()))
        if len(out) == NEAR:
            break
    return out


def _left(text: str, at: int) -> list[tuple[int, int]]:
    width = 32 * NEAR
    while True:
        low = max(0, at - width)
        out = [(m.start(), m.end()) for m in WORD.finditer(text, low, at)]
        if low and out and out[0][0] == low:
            out = out[1:]  # it may begin before the window
        if not low or len(out) >= NEAR:
            return out[-NEAR:]
        width *= 2


def vocabulary(text: str) -> set[str]:
    """The distinct words in lower case, each lowered by itself as `words` are."""
    if "\u0130" in text or "\u03a3" in text:  # their lower case differs by place
        return {w.lower() for w in WORD.findall(text)}
    return set(WORD.findall(text.lower()))


def _counts(documents: DataFrame, text: str) -> DataFrame:
    """Rows of three kinds, summed within a batch: (term, n); (entity, key, place, n); (key, body) of a text with entities.

    n counts documents, key is the md5 of the text, place the fingerprint of an entity's surroundings in it.
    """
    schema = pa.schema([("entity", pa.string()), ("term", pa.string()), ("key", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("body", pa.string())])

    def rows(**columns):
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * size), f.type) for f in schema], schema=schema)

    def run(batches):
        for batch in batches:
            terms: Counter = Counter()
            held: Counter = Counter()
            bodies: dict[str, str] = {}
            for value in batch.column(0):
                body = value.as_py() or ""
                terms.update(vocabulary(body))
                spans = base_spans(body)
                if not spans:
                    continue
                key = hashlib.md5(body.encode()).hexdigest()
                bodies[key] = body
                held.update((name, key, place) for name, place in places(body, spans).items())
            if terms:
                yield rows(term=list(terms), n=list(terms.values()))
            if bodies:
                name, key, place = zip(*held)
                yield rows(entity=name, key=key, place=place, n=list(held.values()))
                yield rows(key=list(bodies), body=list(bodies.values()))

    return documents.select(text).mapInArrow(run, "entity string, term string, key string, place bigint, n bigint, body string")


def _fingerprint(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _spread(batches):
    """(key, term) of every distinct word outside base spans."""
    for batch in batches:
        for key, body in zip(batch.column(0), batch.column(1)):
            body = body.as_py()
            terms = list({body[s:e].lower() for s, e in words(body, base_spans(body))})
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(terms)), pa.array(terms)], ["key", "term"])


def _meetings(documents: DataFrame, text: str, support: int, least: float) -> DataFrame:
    """(key, entity, term, place, n, n_entity, n_term, n_all): what meets in a text, wherever in it.

    Left out is what cannot be told: entities with fewer than `support` surroundings, and words in so
    many documents that a share of `least` is out of reach even if all the entity's documents held them.
    """
    counted = staged(_counts(documents, text), "counts")
    held = staged(counted.where("entity is not null").groupBy("entity", "key", "place").agg(F.sum("n").alias("n")), "held")
    total = documents.agg(F.count(F.lit(1)).alias("n_all"))  # one row
    often = staged(
        held.groupBy("entity", "place").agg(F.sum("n").alias("n"))
        .groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("places"))
        .where(F.col("places") >= support).drop("places")
        .join(F.broadcast(total), F.lit(True)).where(F.col("n_entity") < F.col("n_all")), "often")
    known = staged(held.join(often, "entity"), "known")
    bodies = (
        counted.where("body is not null").select("key", "body")
        .join(known.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    )
    terms = (
        counted.where("term is not null").groupBy("term").agg(F.sum("n").alias("n_term"))
        .where(F.col("n_term") >= support)
    )
    spread = bodies.mapInArrow(_spread, "key string, term string").join(terms, "term")
    most = F.pow("n_all", F.lit(1 - least)) * F.pow("n_entity", F.lit(least)) * (1 + 1e-9)
    return staged(known.join(spread, "key").where(F.col("n_term") <= most), "meetings")


def _told(meetings: DataFrame, support: int, least: float) -> DataFrame:
    counts = ["n_entity", "n_term", "n_all"]
    share = F.log(F.col("n_both") * F.col("n_all") / (F.col("n_term") * F.col("n_entity"))) / F.log(F.col("n_all") / F.col("n_entity"))
    return (
        meetings.groupBy("entity", "term", *counts, "place").agg(F.sum("n").alias("n"))
        .groupBy("entity", "term", *counts).agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("places"))
        .where(F.col("places") >= support)
        .select("entity", "term", share.alias("share")).where(F.col("share") >= least)
    )


def disclosures(documents: DataFrame, text: str = "text", support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(entity, term, share): words that disclose at least `least` of an entity whose documents they stand in.

    share = PMI(term, entity) / information(entity), over document counts of all rows and whole texts.
    A pair counts only if it meets while the entity has `support` different surroundings, so copies of
    one text prove nothing.
    """
    return _told(_meetings(documents, text, support, least), support, least)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())]))
ALL_SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("removed", T.BooleanType()),
]))


def find(documents: DataFrame, text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Add `base` and `spans`: (start, kind, end, removed) of base forms and disclosing terms, in order.

    A null or empty text has no spans. Places are code points, ends exclusive. Spans belong to
    a text, so repeated rows agree, whatever their ids. A term that an entity of the text discloses
    is a span wherever it stands in that text; one that two entities disclose is one span. Terms
    never overlap base spans. Columns called base or spans are replaced.
    """
    documents = documents.drop("base", "spans")
    meetings = _meetings(documents, text, support, generalise)
    told = staged(_told(meetings, support, generalise), "told")
    terms = staged(
        meetings.join(told, ["entity", "term"]).groupBy("key", "term").agg(F.max("share").alias("share"))
        .groupBy(F.col("key").alias("__key"))
        .agg(F.collect_list(F.struct("term", (F.col("share") >= remove).alias("removed"))).alias("__terms")), "terms")
    keyed = documents.withColumn("__key", F.md5(F.coalesce(text, F.lit("")))).join(terms, "__key", "left")
    at, terms_at = keyed.columns.index(text), keyed.columns.index("__terms")
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("removed", pa.bool_())])

    def run(chunk):
        out = []
        for value, disclosing in zip(chunk.column(at), chunk.column(terms_at)):
            body = value.as_py() or ""
            base = base_spans(body)
            spans = [(*s, False) for s in base]
            removed = {t["term"]: t["removed"] for t in disclosing.as_py() or ()}
            if removed:
                for start, end in words(body, base):
                    if (term := body[start:end].lower()) in removed:
                        spans.append((start, len(KINDS) - 1, end, removed[term]))
                spans.sort()
            out.append([dict(zip(("start", "kind", "end", "removed"), s)) for s in spans])
        return [pa.array(out, pa.list_(span))]

    found = map_rows(keyed, run, [("spans", ALL_SPANS)], text)
    base = F.transform(F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(*documents.columns, base.cast(SPAN).alias("base"), "spans")


def mask(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace spans in the text: base forms and generalised terms by their form, removed terms by nothing.

    Overlapping spans of different kinds are replaced once, by the first. A null text stays null.
    """
    at, spans_at = found.columns.index(text), found.columns.index("spans")

    def run(chunk):
        out = []
        for value, spans in zip(chunk.column(at), chunk.column(spans_at)):
            body = value.as_py()
            done, parts = 0, []
            for span in _apart(spans.as_py() or []) if body else ():
                parts += body[done:span["start"]], _form(body[span["start"]:span["end"]], span)
                done = span["end"]
            out.append("".join(parts) + body[done:] if parts else body)
        return [pa.array(out, pa.string())]

    kept = found.columns
    return map_rows(found, run, [("__masked", T.StringType())], text).select(
        *[F.col("__masked").alias(text) if c == text else c for c in kept])


def _apart(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for span in spans:
        if out and span["start"] < out[-1]["end"]:
            out[-1] = out[-1] | {"end": max(out[-1]["end"], span["end"])}
        else:
            out.append(span)
    return out


def _form(value: str, span: dict) -> str:
    if span["removed"]:
        return ""
    if span["kind"] < len(KINDS) - 1:
        return f"[{KINDS[span['kind']].upper()}]"
    return "[NUMBER]" if value.isdigit() else "[NAME]" if value[:1].isupper() else "[TERM]"


def spans_text(spans, kinds=KINDS):
    """kind:start:end of every span, comma-joined in order."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
