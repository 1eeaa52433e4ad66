"""Benchmark decontamination by the q-gram lemma.

A text region within k edits of an item of m bytes shares at least
m - q + 1 - k q of its q-grams, all on diagonals at most k apart. So matching
q-grams are counted in diagonal bands 2 k wide that overlap by half, regions
whose count reaches the bound are kept, and only these are verified, by an
alignment within the band. Texts and items are compared in lower case with
runs of other characters than letters and digits as one space.

The items are read in parts of at most ``PART_BYTES`` (one, unless the
benchmark is larger), each shared with the executors, one after another; the
texts are never shuffled. Hits are counted a bounded number at a time, whatever
a text repeats.

Defined results: ``n_edits`` is the least number of edits between the item and
any stretch of the text. Null or empty texts hold nothing; texts of any length
are taken whole; a null id stands in its rows; items of under ``Q`` bytes are
found as whole words; where a tenth of an item's bytes is more edits than leave
a q-gram, the budget is the most that do; null or empty items, and those with
a null id, are left out. Repeated rows and repeated ids are taken one by one; an
empty table on either side gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitwright.llm.common import batch, materialize

#: Bytes of a q-gram, edits allowed for each byte of an item, bytes of items shared at once, and of texts looked at together.
Q, EDIT_RATE, PART_BYTES, CHUNK_BYTES = 8, 0.1, 4_000_000, 4_000_000
#: Bytes of texts whose q-grams are held at once, hits counted at once, and diagonals aligned at once.
BLOCK_BYTES, EXPANDED, WIDTH = 1 << 20, 1 << 20, 1 << 16
OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> bytes:
    return OTHER.sub(" ", (text or "").lower()).strip().encode("utf-8")


def grams(text: bytes) -> np.ndarray:
    """The 8-byte q-gram at each position, as a number."""
    if len(text) < Q:
        return np.empty(0, np.uint64)
    return np.ndarray((len(text) - Q + 1,), "<u8", text, strides=(1,)).copy()


def _slot(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


class Items:
    """The q-gram index of a part of the benchmark.

    An entry is a q-gram, an item and a stretch of the item's positions where
    it stands, each at most half a band from the one before: an item that
    repeats one q-gram has few entries, however long it is.
    """

    def __init__(self, items: list[tuple[int, str]]):
        kept = [(i, t) for i, text in items if (t := normal(text))]
        self.ids, self.texts = [i for i, _ in kept], [t for _, t in kept]
        self.lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        # The largest number of edits that leaves one q-gram, at most.
        self.budgets = np.clip((self.lengths * EDIT_RATE).astype(np.int64), 0, np.maximum(self.lengths - Q, 0) // Q)
        self.bound = self.lengths - Q + 1 - self.budgets * Q
        self.half = np.maximum(self.budgets, 1)
        each = [grams(t) for t in self.texts]
        codes = np.concatenate([*each, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(each)), [len(g) for g in each])
        at = np.concatenate([*(np.arange(len(g)) for g in each), np.empty(0, np.int64)])
        order = np.lexsort((at, item, codes))
        codes, item, at = codes[order], item[order], at[order]
        first = np.ones(len(codes), dtype=bool)
        first[1:] = (codes[1:] != codes[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > self.half[item[1:]])
        begin = np.flatnonzero(first)
        self.codes, self.item, self.low = codes[begin], item[begin], at[begin]
        self.high = at[np.append(begin[1:], len(at)) - 1] if len(begin) else at
        # Bands that an entry's hit can be in, summed up to each entry.
        self.reach = np.append(0, np.cumsum((self.high - self.low) // self.half[self.item] + 2))
        self.bits = min(26, max(16, int(len(codes) * 64).bit_length()))  # 64 MB at most
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[_slot(self.codes, self.bits)] = True
        self.short = [k for k, n in enumerate(self.lengths) if n < Q]

    def _counted(self, where: np.ndarray, owner: np.ndarray, starts: np.ndarray, low: np.ndarray, times: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Hits for each (text, item, band): keys and counts."""
        entry = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item = self.item[entry]
        after = np.repeat(where - starts[owner], times) + self.lengths[item]  # so that no diagonal is negative
        one, last = (after - self.high[entry]) // self.half[item], (after - self.low[entry]) // self.half[item]
        each = last - one + 1
        band = np.repeat(one, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        return np.unique(np.repeat(np.repeat(owner, times) * len(self.ids) + item, each) * span + band, return_counts=True)

    def regions(self, text: bytes, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first diagonal, last diagonal) of the bands that reach the bound, neighbours as one.

        ``text``: texts set apart by zeros; ``starts``: theirs. Hits are counted
        a bounded number at a time; bands behind the place read are done.
        """
        span = len(text) + int(self.lengths.max(initial=0)) + 3
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for start in range(0, max(len(text) - Q + 1, 0), BLOCK_BYTES):
            codes = grams(text[start : start + BLOCK_BYTES + Q - 1])
            hits = np.flatnonzero(self.seen[_slot(codes, self.bits)])
            low = np.searchsorted(self.codes, codes[hits], "left")
            high = np.searchsorted(self.codes, codes[hits], "right")
            load = np.cumsum(self.reach[high] - self.reach[low])
            at = 0
            while at < len(hits):
                end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + EXPANDED, "right")))
                where = hits[at:end] + start
                owner = np.searchsorted(starts, where, "right") - 1
                more, n = self._counted(where, owner, starts, low[at:end], (high - low)[at:end], span)
                keys, counts = _summed(np.concatenate((keys, more)), np.concatenate((counts, n)))
                # A hit on diagonal d (moved by the item's length) stands at most at d - Q: bands before that are complete.
                item, band = (keys // span) % len(self.ids), keys % span
                now, place = owner[-1], where[-1] - starts[owner[-1]]
                done = (keys // span // len(self.ids) < now) | ((band + 2) * self.half[item] - Q < place)
                yield from self._full(keys, counts, done, span)
                keep = ~done
                keys, counts = keys[keep], counts[keep]
                at = end
        yield from self._full(keys, counts, np.ones(len(keys), dtype=bool), span)

    def _full(self, keys: np.ndarray, counts: np.ndarray, done: np.ndarray, span: int) -> Iterator[tuple[int, int, int, int]]:
        # The window of bands b and b + 1; where b is without hits b + 1 stands for it.
        follows = np.append(keys[1:] == keys[:-1] + 1, False)
        double = counts + np.where(follows, np.append(counts[1:], 0), 0)
        item = (keys // span) % max(1, len(self.ids))
        found = np.flatnonzero(done & (double >= self.bound[item]))
        if not len(found):
            return
        widest = np.maximum(1, WIDTH // self.half[item[found]])
        breaks = np.append(True, keys[found][1:] != keys[found][:-1] + 1)
        # Runs of neighbours, cut where they get wider than WIDTH diagonals.
        place = np.arange(len(found)) - np.maximum.accumulate(np.where(breaks, np.arange(len(found)), 0))
        begin = np.flatnonzero(breaks | (place % widest == 0))
        for a, b in zip(begin, np.append(begin[1:], len(found)) - 1, strict=True):
            i, half = int(item[found[a]]), int(self.half[item[found[a]]])
            first, last = (int(keys[found[k]] % span) * half - int(self.lengths[i]) for k in (a, b))
            yield int(keys[found[a]] // span // len(self.ids)), i, first - half, last + 3 * half


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(keys) else counts


def edits(item: bytes, text: bytes, low: int, high: int, budget: int) -> int | None:
    """The least edits between ``item`` and a stretch of ``text`` on diagonals ``low`` to ``high``, if within ``budget``."""
    if text.find(item, max(0, low), max(0, high + len(item))) >= 0:
        return 0
    if not budget:
        return None
    # cost[d]: least edits of the item's prefix against a stretch that ends at diagonal low + d.
    width = high - low + 1
    padded = np.zeros(width + len(item), dtype=np.uint8)
    a, b = max(low, 0), min(high + len(item), len(text))
    if a < b:
        padded[a - low : b - low] = np.frombuffer(text[a:b], dtype=np.uint8)
    ramp = np.arange(width)
    cost = np.zeros(width, dtype=np.int64)
    for i, byte in enumerate(item):
        step = cost + (padded[i : i + width] != byte)
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)  # a byte of the item left out
        cost = np.minimum.accumulate(step - ramp) + ramp  # bytes of the text left out
        if cost.min() > budget:
            return None
    return int(cost.min())


def found(items: Items, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(text, item, edits) for the items that each (normal) text holds."""
    starts = np.cumsum([0] + [len(t) + Q for t in texts[:-1]]) if texts else np.empty(0, np.int64)
    best: dict[tuple[int, int], int] = {}
    if len(items.codes):
        for t, i, low, high in items.regions((b"\0" * Q).join(texts), starts):
            if best.get((t, i)) != 0:
                n = edits(items.texts[i], texts[t], low, high, int(items.budgets[i]))
                if n is not None:
                    best[t, i] = min(n, best.get((t, i), n))
    for i in items.short:
        for t, text in enumerate(texts):
            if b" " + items.texts[i] + b" " in b" " + text + b" ":
                best[t, i] = 0
    yield from ((t, i, e) for (t, i), e in sorted(best.items()))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each text and item it holds: ``doc_id``, ``item_id``, ``n_edits``."""
    wanted = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text is not null and item_id is not null")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES))
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    out = None
    for part in range(parts):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])  # PART_BYTES, or the parts' share of it
        one = _against(picked, shared)
        if parts > 1:  # one part after another, so that one is held at a time
            one = materialize(one)
            shared.unpersist()
        out = one if out is None else out.unionByName(one)
    return out


def _against(picked: DataFrame, shared: Broadcast) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value)
        for b in batches:
            ids, texts, out, start = b.column(0).to_pylist(), b.column(1).to_pylist(), [], 0
            while start < len(texts):
                chunk, size = [], 0
                while start + len(chunk) < len(texts) and size < CHUNK_BYTES:
                    chunk.append(normal(texts[start + len(chunk)]))
                    size += len(chunk[-1]) + Q
                out += [(ids[start + t], items.ids[i], e) for t, i, e in found(items, chunk)]
                start += len(chunk)
            yield batch(schema, list(zip(*out, strict=True)) if out else [[], [], []])

    return picked.mapInArrow(run, "doc_id long, item_id long, n_edits int")
