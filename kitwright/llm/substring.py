"""Substring deduplication by recompression.

Words are named by hashes. Rounds of recompression then name runs (a symbol
repeated) and pairs (a symbol of the left class followed by one of the right
class) by hashes of what they consist of, so a name means the same everywhere
and no table of names is needed. Whether neighbours merge depends on them
alone, so a passage that two documents share is parsed alike in its interior;
only what lies within ``MARGIN`` words of its ends can differ. Within every
window of 50 shared words at least 40 are interior, and among the symbols there
the one with the smallest name is picked in both documents. It is extended to
the 14 words around its start, which still lie inside the window.

Shared names of these extended symbols reveal the documents and places that
may hold repeats; only there are 50-word windows named (128 bits) and the
first document of each found, which decides exactly what is removed.

Documents of equal word sequences are one class: the smallest id takes part,
in the others every window is a repeat.

Defined results: a null text has no words; documents under 50 words lose
nothing; all judgements are made on the input, whatever is removed; texts of
any length are taken whole. Each row gets one row: rows that repeat an id are
judged by their own texts and take nothing from each other, as neither id is
smaller; a row with a null id loses nothing and takes nothing from others. An
empty table gives an empty table; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kitwright.llm.common import batch, materialize

#: Words of a window; of each round, the longest run and the longest pair that merge (1: none).
WINDOW, ROUNDS = 50, ((1, 2), (2, 4))


def _margin() -> tuple[int, int]:
    """Words at an end of a passage whose parse can depend on what is beyond, and the longest symbol.

    A step of runs can lose a run up to its bound (longer ones don't merge on
    either side), a step of pairs one symbol of the length before it.
    """
    lost, longest = 0, 1
    for run, pair in ROUNDS:
        longest = max(longest, run)
        lost += (run if run > 1 else 0) + longest
        longest = pair
    return lost, longest


MARGIN, LONGEST = _margin()
#: Starts among which a symbol is picked, so that it lies inside the interior; the words around its start in its extended name.
PICK = WINDOW - 2 * MARGIN - (LONGEST - 1)
BEFORE, AFTER = MARGIN, WINDOW - MARGIN - PICK + 1
#: Odd bases of the window hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MAX = np.uint64(2**64 - 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()  # on bytes: \\x20\\x09-\\x0D


def named(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), dtype=np.uint64, count=len(words))


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    b = np.asarray(b)[None] if np.ndim(b) == 0 else b  # arrays wrap silently, scalars warn
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def recompress(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a word sequence after the rounds: (names, first words)."""
    starts = np.arange(len(names))
    lengths = np.ones(len(names), dtype=np.int64)
    for longest_run, longest_pair in ROUNDS:
        first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        times = np.diff(np.append(first, len(names)))
        whole = (times > 1) & (times * lengths[first] <= longest_run)
        if whole.any():
            keep = np.ones(len(names), dtype=bool)
            inside = np.repeat(whole, times)
            inside[first] = False
            keep[inside] = False
            at = first[whole]
            names, lengths = names.copy(), lengths.copy()
            names[at] = _mix(names[at], times[whole].astype(np.uint64))
            lengths[at] *= times[whole]
            names, starts, lengths = names[keep], starts[keep], lengths[keep]
        right = (_mix(names, np.uint64(longest_pair)) & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(~right[:-1] & right[1:] & (lengths[:-1] + lengths[1:] <= longest_pair))
        if len(pair):
            names, lengths = names.copy(), lengths.copy()
            names[pair] = _mix(names[pair], names[pair + 1])
            lengths[pair] += lengths[pair + 1]
            keep = np.ones(len(names), dtype=bool)
            keep[pair + 1] = False
            names, starts, lengths = names[keep], starts[keep], lengths[keep]
    return names, starts


def _sliding(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = of(values[:-done], values[done:])
        done *= 2
    return of(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


class Rolling:
    """Hashes of word ranges: sums of names times powers of an odd base, divided by the power of the start."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, names: np.ndarray, base: int):
        have = self.powers.get(base)
        if have is None or len(have[0]) < len(names) + 1:
            size = max(1 << 16, 2 * len(names))
            inverse = pow(base, -1, 2**64)
            have = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, x, dtype=np.uint64)))) for x in (base, inverse))
            self.powers[base] = have
        self.inverse = have[1]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * have[0][: len(names)])))

    def __call__(self, starts: np.ndarray, width: int) -> np.ndarray:
        x = (self.sums[starts + width] - self.sums[starts]) * self.inverse[starts]
        return x ^ (x >> np.uint64(31))


def anchors(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The extended symbols picked in a document: (names, first words of the symbols)."""
    if len(names) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    symbols, starts = recompress(names)
    value = np.full(len(names), MAX)
    value[starts] = symbols
    least = _sliding(value, PICK, np.minimum)
    padded = np.concatenate((np.zeros(PICK - 1, np.uint64), least, np.zeros(PICK - 1, np.uint64)))
    picked = starts[_sliding(padded, PICK, np.maximum)[starts] == symbols]
    picked = picked[(picked >= BEFORE) & (picked + AFTER <= len(names))]
    return Rolling(names, BASES[0])(picked - BEFORE, BEFORE + AFTER), picked


def _parsed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_words``, ``sequence`` (digest of the words) and the picked symbols: ``keys``, ``at``."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("sequence", pa.binary()), ("keys", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(2).to_pylist():
                words = words_of(text)
                keys, at = anchors(named(words)) if len(words) >= WINDOW else (np.empty(0, np.uint64), np.empty(0))
                rows.append((len(words), hashlib.sha256(b" ".join(words)).digest(), keys.view(np.int64), at.astype(np.int32)))
            yield batch(schema, [b.column(0), b.column(1), *(map(list, zip(*rows, strict=True)) if rows else [[]] * 4)])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_words long, sequence binary, keys array<long>, at array<int>")


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``packed``, the compressed text: what crosses the network where texts must."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield batch(schema, [b.column(0), b.column(1), [pack((t or "").encode("utf-8")) for t in b.column(2).to_pylist()]])

    return docs.mapInArrow(run, "doc_id long, text_hash long, packed binary")


def _unpacked(column: pa.Array) -> list[list[bytes]]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(p).split() for p in column.to_pylist()]


def _windows(suspects: DataFrame) -> DataFrame:
    """The 50-word windows around the shared symbols of each document: ``h1``, ``h2``, ``doc_id``, ``version``, ``q``."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int32()), ("q", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, version, words, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _unpacked(b.column(2)), b.column(3).to_pylist(), strict=True):
                names = named(words)
                # The windows that could have picked the symbol: it starts BEFORE to BEFORE + PICK - 1 words into them.
                q = np.unique(np.asarray(at)[:, None] - np.arange(BEFORE, BEFORE + PICK)[None, :])
                q = q[(q >= 0) & (q + WINDOW <= len(names))]
                h1, h2 = (Rolling(names, base)(q, WINDOW).view(np.int64) for base in BASES)
                yield batch(schema, [h1, h2, np.full(len(q), doc), np.full(len(q), version, dtype=np.int32), q.astype(np.int32)])

    return suspects.select("doc_id", "version", "packed", "at").mapInArrow(run, "h1 long, h2 long, doc_id long, version int, q int")


def _cut(suspects: DataFrame) -> DataFrame:
    """Each document without the words of its ``repeats``: ``doc_id``, ``sequence``, ``n_removed``, ``kept`` (the words left, by one space)."""
    schema = pa.schema([("doc_id", pa.int64()), ("sequence", pa.binary()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, sequence, words, repeats in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _unpacked(b.column(2)), b.column(3).to_pylist(), strict=True):
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edges, np.asarray(repeats), 1)
                np.add.at(edges, np.asarray(repeats) + WINDOW, -1)
                gone = np.cumsum(edges)[:-1] > 0
                rows.append((doc, sequence, int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode("utf-8")))
            yield batch(schema, list(zip(*rows, strict=True)) if rows else [[]] * 4)

    return suspects.select("doc_id", "sequence", "packed", "repeats").mapInArrow(run, "doc_id long, sequence binary, n_removed long, kept string")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What is left of each document: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` and ``kept_sha256``.

    ``kept`` is null where nothing was removed: the text's words, unchanged.
    """
    picked = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"xxhash64(`{text_column}`) as text_hash", f"`{text_column}` as text")
    parsed = materialize(_parsed(picked))
    # The document that stands for a word sequence; ``version`` tells those of one id apart.
    firsts = parsed.filter("doc_id is not null").groupBy("sequence").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n"))
    firsts = firsts.select("sequence", "first.*", "n")
    first = firsts.withColumn("version", F.row_number().over(Window.partitionBy("doc_id").orderBy("sequence"))).drop("n")
    symbols = parsed.filter("doc_id is not null").select("doc_id", F.xxhash64("sequence").alias("sequence"), F.explode(F.arrays_zip("keys", "at")).alias("s"))
    symbols = symbols.select("doc_id", "sequence", F.col("s.keys").alias("key"), F.col("s.at").alias("at"))
    # Copies have one sequence, so what only they share is not counted as shared. Written, as are the
    # repeated windows below, so that a symbol of very many documents can be split where it is joined.
    shared = materialize(symbols.groupBy("key").agg(F.min("sequence").alias("a"), F.max("sequence").alias("b")).filter("a < b").select("key"))
    places = (
        symbols.select("doc_id", "key", "at")
        .join(shared, "key", "left_semi")
        .groupBy("doc_id")
        .agg(F.collect_list("at").alias("at"))  # bounded by a text; of a repeated id, places of all its texts
        .join(first, "doc_id")
    )
    # A repeated row is taken once: both have the same id and text.
    suspects = materialize(_packed(picked).join(places, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]))
    windows = _windows(suspects)
    repeated = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    repeats = windows.join(materialize(repeated), ["h1", "h2"]).filter("doc_id > first").groupBy("doc_id", "version").agg(F.collect_list("q").alias("repeats"))
    cut = _cut(suspects.select("doc_id", "version", "sequence", "packed").join(repeats, ["doc_id", "version"]))

    copied = materialize(firsts.filter("n > 1").select("sequence", F.col("doc_id").alias("first")))
    rows = parsed.select("doc_id", "n_words", "sequence").join(copied, "sequence", "left").join(cut, ["doc_id", "sequence"], "left")
    gone = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    return rows.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        F.when(gone, F.sha2(F.lit(""), 256)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.lower(F.hex("sequence"))).alias("kept_sha256"),
    )
