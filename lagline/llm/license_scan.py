"""Licence scan with a positional index of rare words.

Counts over the whole corpus say how rare each licence word is. The index posts, for every
template, the places of its rarest words. A text looks up those of its words that are
posted; postings that agree on a relative position (text place minus template place) place
a template, and the template counts only where its mandatory phrases stand there too.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lagline.llm.kit import map_rows

POSTED_WORDS = 12  # rarest distinct words of a template that are posted
SLACK = 6  # words that a copy may have gained or lost before a place
AGREE = 0.5  # share of the posted words that must agree on a place


@dataclass(frozen=True)
class Template:
    """A licence text. A phrase (`exact`) must stand word for word; a long text needs its `keys`."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def exact(self) -> bool:
        return not self.keys


# The base phrases and their labels.
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)
# Public licence phrases and notices.
TEMPLATES = BASE + (
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl-3", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("mpl-2", "mozilla public license v 2"),
    Template("bsd-3", "bsd 3 clause license"),
    Template("bsd-2", "bsd 2 clause license"),
    Template("isc", "under the isc license"),
    Template("epl-2", "eclipse public license version 2"),
    Template("unlicense", "free and unencumbered software released into the public domain"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "cc0 1 0 universal"),
    Template("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so""",
        ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee
        is hereby granted provided that the above copyright notice and this permission notice appear in all copies""",
        ("permission to use copy modify", "appear in all copies")),
    Template("bsd", """redistribution and use in source and binary forms with or without modification are permitted
        provided that the following conditions are met redistributions of source code must retain the above copyright
        notice this list of conditions and the following disclaimer""",
        ("redistribution and use in source and binary forms", "retain the above copyright notice")),
    Template("apache-2", """you may not use this file except in compliance with the license you may obtain a copy of the
        license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of
        any kind either express or implied""",
        ("except in compliance with the license", "apache org licenses license 2 0")),
    Template("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation either version""",
        ("this program is free software", "gnu general public license")),
    Template("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the
        mpl was not distributed with this file you can obtain one at""",
        ("this source code form is subject to the terms", "if a copy of the mpl was not distributed")),
    Template("zlib", """this software is provided as is without any express or implied warranty in no event will the
        authors be held liable for any damages arising from the use of this software""",
        ("this software is provided as is", "in no event will the authors be held liable")),
)

# Lower case for A-Z, and a space for every ASCII character outside a-z and 0-9.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def vocabulary(templates=TEMPLATES) -> frozenset[bytes]:
    return frozenset(w for t in templates for w in words_of(t.text))


def rarity(documents: DataFrame, text: str = "text", templates=TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequency of every licence word over all rows.

    Counts are summed in tasks first; one number per licence word reaches the driver.
    """
    known = vocabulary(templates)

    def count(batches):
        found, rows = defaultdict(int), 0
        for batch in batches:
            for value in batch.column(0):
                rows += 1
                for w in known.intersection(words_of(value.as_py())):
                    found[w] += 1
        found[b""] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["w", "n"])

    sums = documents.select(text).mapInArrow(count, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["w"]): r["n"] for r in sums}
    total = df.pop(b"", 0)
    return {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in known}


class Index:
    """Postings of the rarest words: word -> (template, place)."""

    def __init__(self, idf: dict[bytes, float], templates=TEMPLATES, posted: int = POSTED_WORDS):
        self.templates = templates
        self.words = [words_of(t.text) for t in templates]
        self.keys = [[words_of(k) for k in t.keys] for t in templates]
        self.at: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for number, (template, words) in enumerate(zip(templates, self.words)):
            rare = sorted(set(words), key=lambda w: (-idf[w], w))[:1 if template.exact else posted]
            self.needed.append(1 if template.exact else math.ceil(AGREE * len(rare)))
            for place, word in enumerate(words):
                if word in rare:
                    self.at[word].append((number, place))
        self.at = dict(self.at)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Verified places (template, first word, share of the template found), each template and place once."""
        votes: dict[int, dict[int, set[bytes]]] = defaultdict(lambda: defaultdict(set))
        at = self.at
        for i, word in enumerate(words):
            if word in at:
                for template, place in at[word]:
                    votes[template][i - place].add(word)
        found = []
        for template, shifts in votes.items():
            body = self.words[template]
            if self.templates[template].exact:
                found += [(template, s, 1.0) for s in sorted(shifts) if s >= 0 and words[s:s + len(body)] == body]
                continue
            last = None
            for shift in sorted(shifts):
                if last is not None and shift - last <= SLACK:
                    continue  # another part of the copy that has been placed
                window = [s for s in range(shift, shift + SLACK + 1) if s in shifts]
                if len(set().union(*(shifts[s] for s in window))) < self.needed[template]:
                    continue
                place = max(window, key=lambda s: (len(shifts[s]), -s))
                region = words[max(0, place - SLACK):place + len(body) + 2 * SLACK]
                if all(_stands(region, k) for k in self.keys[template]):
                    share = sum(w in words[max(0, place + p - SLACK):place + p + 2 * SLACK] for p, w in enumerate(body)) / len(body)
                    found.append((template, max(0, place), share))
                    last = shift
        return found


def _stands(words: list[bytes], phrase: list[bytes]) -> bool:
    n = len(phrase)
    return any(words[i] == phrase[0] and words[i:i + n] == phrase for i in range(len(words) - n + 1))


def scan(documents: DataFrame, text: str = "text", templates=TEMPLATES, idf: dict[bytes, float] | None = None) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and places.

    Words are counted from 0. `places` lists (label, first word, score) of every verified
    place. Without a base phrase first_word and last_word are null; without a label the score
    is 0. Null and empty texts have no words. Rows are judged alone, so repeated rows agree.
    Columns with these names are replaced; all others stay.
    """
    index = Index(idf if idf is not None else rarity(documents, text, templates), templates)
    at = documents.columns.index(text)
    place = pa.struct([("label", pa.string()), ("word", pa.int64()), ("score", pa.float64())])

    def run(chunk):
        rows = []
        for value in chunk.column(at):
            words = words_of(value.as_py())
            found = index.scan(words)
            base = [s for t, s, _ in found if templates[t].base]
            rows.append((
                len(words), len(base), min(base, default=None), max(base, default=None),
                ",".join(sorted({templates[t].label for t, _, _ in found if templates[t].base})),
                ",".join(sorted({templates[t].label for t, _, _ in found})),
                max((x for _, _, x in found), default=0.0),
                [{"label": templates[t].label, "word": s, "score": x} for t, s, x in sorted(found, key=lambda f: (f[1], f[0]))],
            ))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(place)]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    long, string = T.LongType(), T.StringType()
    placed = T.ArrayType(T.StructType([T.StructField("label", string), T.StructField("word", long), T.StructField("score", T.DoubleType())]))
    return map_rows(documents, run, [
        ("n_words", long), ("n_base", long), ("first_word", long), ("last_word", long), ("base_labels", string),
        ("labels", string), ("score", T.DoubleType()), ("places", placed),
    ], text)
