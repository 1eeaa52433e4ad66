"""License scans: fuzzy search for short notices.

A notice is a sequence of words with a budget of edits. It is cut into one
piece more than the budget, so wherever it stands with at most that many edits
one piece stands unchanged (the pigeonhole principle). One automaton over all
pieces finds those seeds in a single pass; around each seed the ``regex``
library matches the notice within its budget and so verifies the edits and
reports the span. Spans begin and end at words.

Texts are compared as words: letters A-Z in lower case, every other ASCII
character than letters and digits as a space. A base notice has no edits to
spare and its one piece is itself. Scanning is one pass over each text, without
a shuffle.

Defined results: a null text is the empty text and holds nothing; texts of any
length are scanned whole, and what is held beside a text is linear in it;
matches of one notice don't overlap, the leftmost counts, those of different
notices may; matches that tie are listed by place, then in the order of the
notices; repeated rows and repeated ids get one row each; a null id stands in
its row; an empty table gives an empty table. Extra columns are kept, but for
those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitwright.llm.common import AS_WORDS, batch

#: Characters of a notice for each edit it may have, and the most edits of one.
SPARE, MOST_EDITS = 10, 4


@dataclass(frozen=True)
class Notice:
    """A text to look for, the label it stands for, and the edits (characters put in, left out or changed) allowed in its words."""

    label: str
    text: str
    edits: int

    def pieces(self) -> list[tuple[int, str]]:
        """``edits + 1`` stretches of the text with the places where they begin, as equal as can be."""
        cuts = [len(self.text) * k // (self.edits + 1) for k in range(self.edits + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def notice(label: str, text: str) -> Notice:
    """A notice with an edit for every ``SPARE`` characters, ``MOST_EDITS`` at most."""
    return Notice(label, text, min(MOST_EDITS, len(text) // SPARE))


# The base phrases and their labels.
BASE = (Notice("mit", "mit license", 0), Notice("apache", "apache license", 0), Notice("gpl", "general public license", 0))

# Wordings of public licenses, as words in lower case, and their labels.
NOTICES = (
    notice("mit", "mit license"),
    notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    notice("apache", "apache license"),
    notice("apache", "licensed under the apache license version 2 0"),
    notice("gpl", "general public license"),
    notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    notice("lgpl", "gnu lesser general public license"),
    notice("agpl", "gnu affero general public license"),
    notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    notice("mpl", "this source code form is subject to the terms of the mozilla public license"),
    notice("epl", "eclipse public license"),
    notice("bsl", "boost software license version 1 0"),
    notice("unlicense", "this is free and unencumbered software released into the public domain"),
    notice("cc", "creative commons attribution"),
    notice("cc", "licensed under cc by"),
)

FOUND = "array<struct<label:string,notice:int,base:boolean,edits:int,first_word:long,last_word:long,span_start:long,span_end:long>>"


class Search:
    """The seeds of all notices in one automaton, and a pattern for each notice."""

    def __init__(self, base: tuple[Notice, ...], notices: tuple[Notice, ...]):
        self.base, self.notices = len(base), (*base, *notices)
        self.seeds = ahocorasick.Automaton()
        named: dict[str, list[tuple[int, int]]] = {}
        for number, one in enumerate(self.notices):
            for offset, piece in one.pieces():
                named.setdefault(piece, []).append((number, offset + len(piece)))
        for piece, places in named.items():
            self.seeds.add_word(piece, places)
        if named:
            self.seeds.make_automaton()
        edge = r"(?:%s)%s(?![^ ])"
        self.patterns = [regex.compile(edge % (regex.escape(n.text), f"{{e<={n.edits}}}" if n.edits else ""), regex.ENHANCEMATCH if n.edits else 0) for n in self.notices]

    def stretches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(notice, start, end) of the stretches that hold a seed's candidates, neighbours as one, in order of place for each notice."""
        opened: dict[int, tuple[int, int]] = {}
        if not len(self.seeds):
            return
        for last, places in self.seeds.iter(text):
            for number, end in places:
                one = self.notices[number]
                start = last + 1 - end - one.edits
                stop = start + len(one.text) + 2 * one.edits
                before = opened.get(number)
                if before is None:
                    opened[number] = (start, stop)
                elif start <= before[1]:
                    opened[number] = (min(start, before[0]), max(stop, before[1]))
                else:
                    yield number, *before
                    opened[number] = (start, stop)
        for number, place in opened.items():
            yield number, *place

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of every match in ``text``, which is words with a space between them."""
        free: dict[int, int] = {}  # where the last match of a notice ended
        for number, start, stop in self.stretches(text):
            pattern, longest = self.patterns[number], len(self.notices[number].text) + self.notices[number].edits
            at = max(text.rfind(" ", 0, max(start, 0)) + 1, free.get(number, 0))  # the first word of the stretch
            while at < min(stop, len(text)):
                end = text.find(" ", at + longest)  # of a word, as a match ends where nothing or a space follows
                if found := pattern.match(text, at, end if end >= 0 else len(text)):
                    yield found.start(), found.end(), number, sum(found.fuzzy_counts)
                    free[number] = found.end()
                at = text.find(" ", found.end() if found else at) + 1 or len(text)


def scanned(data: bytes, search: Search) -> tuple[int, list[tuple]]:
    """The number of words, and (label, notice, base, edits, first word, last word, start, end) of each match by place; spans in code points of the text."""
    mapped = data.translate(AS_WORDS)
    words = mapped.split()
    text = b" ".join(words).decode("utf-8", "replace")
    matches = sorted(search.matches(text))
    if not matches:
        return len(words), []
    flat = np.frombuffer(mapped, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flat, [False]))))  # a word's start and end, in bytes
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
    # Code points before each byte: bytes that begin one.
    points = np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, dtype=np.int32))
    places = np.searchsorted(spaces, np.array([m[:2] for m in matches]) - [0, 1], "right").tolist()
    out = []
    for (_, _, number, edits), (first, last) in zip(matches, places, strict=True):
        one = search.notices[number]
        out.append((one.label, number, number < search.base, edits, first, last, int(points[edges[2 * first]]), int(points[edges[2 * last + 1]])))
    return len(words), out


def scan(docs: DataFrame, base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES, text_column: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_words`` and ``found``: every match with its label, edits, words and span.

    ``found.base`` marks the matches of ``base``, which are as they stand.
    """
    kept = [c for c in docs.columns if c not in (text_column, "n_words", "found")]
    picked = docs.select(*kept, F.col(text_column).alias("_text_to_scan"))
    out = f"{picked.drop('_text_to_scan').schema.simpleString().removeprefix('struct<').removesuffix('>')}{',' if kept else ''}n_words:bigint,found:{FOUND}"
    schema = pa.struct([("label", pa.string()), ("notice", pa.int32()), ("base", pa.bool_()), ("edits", pa.int32()), *[(c, pa.int64()) for c in ("first_word", "last_word", "span_start", "span_end")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(base, notices)
        names = [f.name for f in schema]
        for b in batches:
            counts, found = [], []
            for text in b.column(len(kept)):
                n, matches = scanned((text.as_py() or "").encode("utf-8"), search)
                counts.append(n)
                found.append([dict(zip(names, m, strict=True)) for m in matches])
            whole = pa.schema([*(b.schema.field(i) for i in range(len(kept))), ("n_words", pa.int64()), ("found", pa.list_(schema))])
            yield batch(whole, [*(b.column(i) for i in range(len(kept))), counts, found])

    return picked.mapInArrow(run, out)


def report(docs: DataFrame, base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES, text_column: str = "text") -> DataFrame:
    """:func:`scan` summed up for each document.

    ``n_base`` counts the matches of ``base``, ``first_word`` and ``last_word``
    are the first words of the first and the last of them, ``base_labels`` and
    ``labels`` (of all notices) are distinct, sorted and comma-joined, and
    ``score`` is the best match's share of characters without an edit.
    """
    lengths = F.array(*[F.lit(len(n.text)) for n in (*base, *notices)])
    found = scan(docs, base, notices, text_column)
    exact = F.filter("found", lambda x: x["base"])
    starts = F.transform(exact, lambda x: x["first_word"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
    shares = F.transform("found", lambda x: F.lit(1.0) - x["edits"] / F.get(lengths, x["notice"]))
    mine = {
        "n_base": F.size(exact).cast("long"), "first_word": F.array_min(starts), "last_word": F.array_max(starts),
        "base_labels": labels(exact), "labels": labels(F.col("found")), "score": F.coalesce(F.array_max(shares), F.lit(0.0)),
    }
    return found.select(*[c for c in found.columns if c not in mine], *[column.alias(name) for name, column in mine.items()])
