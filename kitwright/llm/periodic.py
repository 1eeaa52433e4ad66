"""Periodic runs of words, by Lyndon roots.

A run is a stretch of words with smallest period q that no neighbour extends.
Each run holds a Lyndon root: a stretch of q words that is, under some order of
the words or its reverse, the longest Lyndon word from where it begins. So the
Lyndon arrays under both orders name every (place, period) that can be a run,
and two searches for the longest common extension, to the right and to the
left, turn each into the run around it.

The Lyndon arrays come from the first phase of Baier's suffix sorter: groups of
suffixes that share a prefix are taken from the highest to the lowest, each
lengthens the prefix of the lower suffixes right before its members, and when
all have been taken every suffix is in the group of its longest Lyndon prefix.
Common extensions are looked up in names of the stretches of 1, 2, 4, ... words,
equal where the words are equal, so they are exact.

Only runs of ``repeats`` periods or more are looked for, and the sorter sees the
parts of a text where these can be: in a run of period q all words but the last
q return within q words, so a stretch whose words return later than its length
allows holds none (:func:`regions`). Documents are taken one by one, without a
shuffle; what is held beside a text grows with its longest such part.

Defined results: a null or empty text has no words and no run; texts of any
length are taken whole; of runs of one length the one that begins first counts
as longest, then the one of the smaller period; repeated rows and repeated ids
get one row each; a null id stands in its row; an empty table gives an empty
table. Extra columns are kept, but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitwright.llm.common import batch

#: Least number of periods and of words of a run.
REPEATS, LEAST = 4, 6
#: Times that :func:`regions` cuts at most; more would only leave less to look at.
CUTS = 16
#: Words of texts that are read together, about.
CHUNK_WORDS = 1 << 17


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word from each place of ``ranks`` (numbers from 0)."""
    n = len(ranks)
    members = sorted(range(n), key=ranks.__getitem__)  # by group, from the lowest; a group's number is where it begins
    place = [0] * n
    begin, end = [0] * n, [0] * (n + 1)  # of each suffix its group, of each group where it ends
    start = 0
    for k, i in enumerate(members):
        place[i] = k
        if ranks[i] != ranks[members[start]]:
            end[start], start = k, k
        begin[i] = start
    end[start] = n
    length, before = [1] * n, [-1] * n
    top = n
    while top:
        low = begin[members[top - 1]]
        group = sorted(members[low:top])
        own = length[group[0]]
        told: dict[int, int] = {}
        for i in group:
            # The nearest place before i in a lower group: places passed are in groups as high, now and later.
            p = i - 1
            while p >= 0 and begin[p] >= low:
                p = before[p]
            q = i - 1
            while q > p:
                before[q], q = p, before[q]
            before[i] = p
            if p >= 0:
                told[p] = told.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, times in told.items():
            by_times.setdefault(times, []).append(p)
        for times in sorted(by_times, reverse=True):
            ends: dict[int, int] = {}
            for p in by_times[times]:  # to the end of its group, which loses it
                g = begin[p]
                ends.setdefault(g, end[g])
                end[g] -= 1
                k, other = place[p], members[end[g]]
                members[k], members[end[g]] = other, p
                place[other], place[p] = k, end[g]
                length[p] += times * own
            for p in by_times[times]:
                g = begin[p]
                begin[p] = end[g]
            for g, last in ends.items():
                if end[g] != last and end[g] != g:
                    end[end[g]] = last
                elif end[g] == g:  # the whole group has moved, and keeps its place
                    end[g] = last
        top = low
    return length


def names(ranks: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words from each place, equal where the stretches are."""
    out = [ranks.astype(np.int64)]
    size = 1
    while 2 * size <= len(ranks):
        last = out[-1]
        pairs = last[: len(ranks) - 2 * size + 1] * (int(last.max()) + 1) + last[size : len(ranks) - size + 1]
        out.append(np.unique(pairs, return_inverse=True)[1])
        size *= 2
    return out


def extensions(named: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from places ``a`` and ``b`` (a < b) on are equal, or before them if ``back``."""
    n = len(named[0])
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
    for k in range(len(named) - 1, -1, -1):
        size, name = 1 << k, named[k]
        while True:  # once for each k, but for the largest
            low = a - size if back else a
            fits = (low >= 0) if back else (b + size <= n)
            x, y = (np.minimum(np.maximum(at, 0), len(name) - 1) for at in (low, low + b - a))
            same = fits & (name[x] == name[y])
            if not same.any():
                break
            step = np.where(same, size, 0)
            out += step
            a, b = (a - step, b - step) if back else (a + step, b + step)
            if k < len(named) - 1:
                break
    return out


def regions(ranks: np.ndarray, ends: np.ndarray, repeats: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of texts that hold all their runs of ``repeats`` periods or more.

    ``ranks``: the words of texts one after another, no two texts with a number
    in common; ``ends``: where each text ends. In a run of period q every word but those of its last period returns within
    q. These stand in one stretch of words that return at all, whose length T is
    (repeats - 1) q or more. So words that return after more than
    T / (repeats - 1) are cut out, and what is left is cut again.
    """
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    gap = np.full(n, n + 1)
    same = ranks[order[1:]] == ranks[order[:-1]]
    gap[order[:-1][same]] = np.diff(order)[same]
    inside = gap <= n
    for _ in range(CUTS):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
        size = np.repeat(edges[1::2] - edges[::2], edges[1::2] - edges[::2])
        places = np.flatnonzero(inside)
        gone = places[gap[places] * (repeats - 1) > size]
        if not len(gone):
            break
        inside[gone] = False
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    out: list[tuple[int, int]] = []
    # The last word of a text doesn't return, so no stretch goes on into the next.
    last = ends[np.searchsorted(ends, edges[::2], "right")]
    for a, b in zip(edges[::2].tolist(), np.minimum(last, edges[1::2] + (edges[1::2] - edges[::2]) // (repeats - 1)).tolist(), strict=True):
        if out and a < out[-1][1]:  # a run that both touch is whole in their union
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs(ranks: np.ndarray, ends: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run of ``repeats`` periods and ``least`` words or more, by start, then period, in the texts of :func:`regions`."""
    parts = regions(ranks, ends, repeats)
    if not parts:
        return np.empty((0, 3), np.int64)
    # The parts one after another, each with a number of its own behind it, which no run can hold twice.
    apart = int(ranks.max()) + 1
    at = np.concatenate([np.arange(a, b + 1) for a, b in parts])
    numbers = np.concatenate([np.append(ranks[a:b], apart + k) for k, (a, b) in enumerate(parts)])
    numbers = np.unique(numbers, return_inverse=True)[1]
    named, here, found = names(numbers), np.arange(len(numbers)), []
    for order in (numbers, numbers.max() - numbers):
        period = np.array(lyndon_lengths(order.tolist()), dtype=np.int64)
        some = here + period < len(numbers)
        a, q = here[some], period[some]
        right, left = extensions(named, a, a + q), extensions(named, a, a + q, back=True)
        size = left + q + right
        whole = (size >= repeats * q) & (size >= least)
        found.append(np.stack([at[(a - left)[whole]], size[whole], q[whole]], axis=1))
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(found):
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, found[:, 0] + found[:, 2], 1)
    np.add.at(step, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def _chunks(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of the texts, some texts at a time."""
    held, size = [], 0
    for text in texts:
        held.append((text.as_py() or "").encode("utf-8").split())  # on bytes: \\x20\\x09-\\x0D
        size += len(held[-1])
        if size >= CHUNK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


RUNS = "array<struct<start:long,length:long,period:long>>"


def find(docs: DataFrame, repeats: int = REPEATS, least: int = LEAST, text_column: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period) and, in place of the text, the words that are kept, with a space between them.

    A run is a stretch of words set apart by white space, of ``repeats`` periods
    and ``least`` words or more. Words that a run holds after its first period
    are not kept.
    """
    kept = [c for c in docs.columns if c not in (text_column, "n_words", "runs")]
    picked = docs.select(*kept, F.col(text_column).alias("_text_to_read"))
    fields = picked.drop("_text_to_read").schema.simpleString().removeprefix("struct<").removesuffix(">")
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, listed, texts = [], [], []
            for split in _chunks(b.column(len(kept))):
                ends = np.cumsum([len(words) for words in split])
                ranks = np.concatenate([np.fromiter(map({}.setdefault, words, count(int(end) - len(words))), np.int64, len(words)) for words, end in zip(split, ends, strict=True)])
                found = runs(ranks, ends, repeats, least)
                owner = np.searchsorted(ends, found[:, 0], "right")
                cuts = np.searchsorted(owner, np.arange(len(split) + 1))
                for k, words in enumerate(split):
                    own = found[cuts[k] : cuts[k + 1]] - [int(ends[k]) - len(words), 0, 0]
                    sizes.append(len(words))
                    listed.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()])
                    texts.append(b" ".join(collapsed(words, own)))
            schema = pa.schema([*(b.schema.field(i) for i in range(len(kept))), ("n_words", pa.int64()), ("runs", pa.list_(one)), (text_column, pa.string())])
            yield batch(schema, [*(b.column(i) for i in range(len(kept))), sizes, listed, pa.array(texts, type=pa.binary()).cast(pa.string())])

    return picked.mapInArrow(run, f"{fields}{',' if kept else ''}n_words:bigint,runs:{RUNS},`{text_column}`:string")


def summary(found: DataFrame) -> DataFrame:
    """:func:`find` with ``n_runs`` and the ``start``, ``length``, ``period`` and ``exponent_milli`` of the longest run, null where there is none."""
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    names = ("n_runs", "start", "length", "period", "exponent_milli")
    rows = found.select(*[c for c in found.columns if c not in names], F.size("runs").cast("long").alias("n_runs"), first.alias("_longest_run"))
    at = F.col("_longest_run")
    return rows.select(
        *[c for c in rows.columns if c != "_longest_run"], (-at["start"]).alias("start"), at["length"].alias("length"), (-at["period"]).alias("period"),
        F.expr("1000 * _longest_run.length div -_longest_run.period").alias("exponent_milli"),
    )
