"""Line deduplication with a log-template tree.

A line's way down the tree is its token count, then its two first tokens; a
token with a digit is a variable field. A node has a child for each token that
``least_texts`` documents have there, and one wildcard child for all others, so
fields in front are fields too. At the leaf, tokens are counted by position over
the documents. A token that ``least_texts`` documents
have at its position is part of a template, any other is a field; and a
position with that many such or other tokens varies. Each line has at most two
templates: one of all its frequent tokens, and one that leaves the varying
positions open too. So "Posted by Alice in News" and "Posted by Bob in News"
share a template, wherever and however many the fields are. A template keeps
at least half of the line's tokens as words; if one of the first two is a wildcard,
three quarters and all but one of those behind them. So half of what is behind is
all words: under wildcards only lines that share such a half (their key) with
``least_texts`` texts of their leaf are counted. A line of one token has the
template that it is.

Which children a node has is known by a bitmap of ``BITMAP`` bits for each of
the two levels, a bounded broadcast. A rare token that shares its bit with a
frequent one gets a child of its own instead of the wildcard: with k frequent
nodes so does one rare token in BITMAP / k. Only lines with a key, the leaf or a
half, that enough documents share are counted token by token. They are known by
two further bitmaps, of keys and of lines: where keys share a bit, more lines are
counted than need be (from some BITMAP shared keys on, all are).

A template recurs if it stands in ``LEAST_TEXTS`` or more unrelated documents,
however many copies of them there are. Documents are unrelated if their sketches
differ. Lines with a template in ``LEAST_TEXTS`` documents are candidates; where
over ``OWN_SHARE`` of a document's tokens stand in other lines, the sketch is
the smallest hash of these, so shared boilerplate does not make documents alike.
The others are copies and near copies, which share nearly all their lines: their
sketch is the smallest hash of the candidate templates, so what a near copy
alone holds does not set it apart (a large group has a few sketches, about the
logarithm of its size). They are left to document deduplication.

Of a recurring template the first line (smallest id, then position) stays, the
others are dropped.

Defined results: null or empty texts have no lines that can be dropped, nor have
lines without a token; in those with more variable than fixed tokens no token is
masked as a field; a text whose lines are all dropped becomes ''; lines repeated
in a text count once for it, and all of them but the first of the template go;
texts of any length are taken whole; rows with a null id lose
nothing; rows that repeat an id are one document and lose the lines that any of
them loses at that position; an empty table gives an empty table. Extra columns
are kept, but for those named like the counts; no name of theirs is reserved.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitwright.llm.common import batch, materialize

LEAST_TEXTS = 8
#: Bits of the maps of nodes and leaves that enough documents share: 8 MB each at any size.
BITMAP = 1 << 26
#: Share of a document's tokens in lines of its own beyond which it is no near copy.
OWN_SHARE = 0.2
FIELD = "<*>"
DIGIT = re.compile(r"\d").search


def _signed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def masked(line: str) -> list[str]:
    """The tokens of a line, with ``FIELD`` for those with a digit unless most have one."""
    raw = line.split()
    if not DIGIT(line):
        return raw
    tokens = [FIELD if DIGIT(t) else t for t in raw]
    return raw if 2 * tokens.count(FIELD) > len(raw) else tokens


#: Odd constants that mix two hashes: multiples of the golden ratio's 64-bit fraction.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0x3C6EF372FE94F82B))
#: Stands for all rare tokens of a node.
WILDCARD = np.array([_signed(FIELD)])
#: What the tree needs of a line: its number of tokens, the hashes of the first two, of all behind these, and of both halves of that.
HEAD = ("tokens", "first", "second", "rest", "front", "back")


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, for arrays of them."""
    x = a.astype(np.int64).view(np.uint64) * MIX[0] + b.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h % BITMAP
    return (bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)


def heads(tokens: list[str]) -> tuple[int, ...]:
    """``HEAD`` of a line; 0 for tokens it doesn't have."""
    rest = tokens[2:]
    half = len(rest) // 2
    parts = (rest, rest[:half], rest[half:])
    return (len(tokens), _signed(tokens[0]), _signed(tokens[1]) if len(tokens) > 1 else 0, *(_signed(" ".join(p)) for p in parts))


class Tree:
    """The children of the nodes of both levels, as bitmaps. All methods take arrays, a line an element."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None = None):
        self.first, self.second = first, second

    def below_count(self, many: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node below the token count, that of the first token or the wildcard's, and whether it is the wildcard's."""
        own = mixed(many, first)
        wild = ~_has(self.first, own)
        return np.where(wild, mixed(many, WILDCARD), own), wild

    def leaves(self, many: np.ndarray, first: np.ndarray, second: np.ndarray, rest: np.ndarray, front: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The leaf, how many words a template needs there, and two keys (the same twice if there is one) by which lines with one are known; for lines that can have none 0 words."""
        node, wild = self.below_count(many, first)
        own = mixed(node, second)
        other = ~_has(self.second, own)
        leaf = np.where(other, mixed(node, WILDCARD), own)
        wilds = wild.astype(np.int64) + other
        spare = np.minimum(1, many // 4 - wilds)  # further fields of a template
        least = np.where(wilds == 0, (many + 1) // 2, np.where(spare < 0, 0, many - wilds - spare))
        one = np.where(wilds == 0, leaf, mixed(leaf, np.where(spare > 0, front, rest)))
        two = np.where((wilds == 0) | (spare <= 0), one, mixed(mixed(leaf, leaf), back))
        return leaf, least, one, two


def _parsed(docs: DataFrame) -> DataFrame:
    """One row for each line with a token: ``id``, ``own`` (its hash), ``line`` (its position) and ``HEAD``."""
    schema = pa.schema([("id", pa.int64()), ("own", pa.int64()), ("line", pa.int32()), ("tokens", pa.int32()), *[(c, pa.int64()) for c in HEAD[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, line in enumerate((text or "").split("\n")):
                    if tokens := masked(line):
                        out.append((id_, _signed(line), k, *heads(tokens)))
            yield batch(schema, list(zip(*out, strict=True)) if out else [[]] * 9)

    return docs.mapInArrow(run, f"id long, own long, line int, tokens int, {', '.join(f'{c} long' for c in HEAD[1:])}")


def _nodes(parsed: DataFrame, of_task: Callable[[], Callable[..., list[np.ndarray]]], kept: str = "id") -> DataFrame:
    """``kept`` and ``node`` for what ``of_task`` makes of ``HEAD``: arrays of nodes, or of (nodes, which lines have them)."""
    schema = pa.schema([(kept, pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = of_task()
        for b in batches:
            own, *line = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(1 + len(HEAD)))
            for node, has in nodes(*line):
                rows = np.unique(np.stack([own[has], node[has]]), axis=1) if has.any() else np.empty((2, 0), np.int64)
                yield batch(schema, list(rows))

    return parsed.select(kept, *HEAD).mapInArrow(run, f"{kept} long, node long")


def _bits(nodes: DataFrame) -> np.ndarray:
    """``BITMAP`` bits, of which each ``node`` sets one."""
    bits = nodes.select((F.pmod("node", F.lit(BITMAP)) + 1).alias("bit"))
    parts = bits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    for r in parts:  # at most BITMAP / 32,768 rows of 4 kB
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _shared(nodes: DataFrame, least_texts: int) -> np.ndarray:
    """The bits of the nodes that ``least_texts`` texts have."""
    return _bits(nodes.distinct().groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= least_texts))


def _grown(parsed: DataFrame, least_texts: int) -> tuple[np.ndarray, ...]:
    """Bitmaps of the tree's two levels, of its keys, and of the lines that have such a key (by ``own``), each counted with the ones before."""
    context = parsed.sparkSession.sparkContext
    every = lambda nodes: [(nodes, np.ones(len(nodes), dtype=bool))]
    first = _shared(_nodes(parsed, lambda: lambda many, first, *_: every(mixed(many, first))), least_texts)
    one = context.broadcast(first)  # BITMAP bits, as the next

    def second_level() -> Callable[..., list]:
        tree = Tree(one.value)
        return lambda many, first, second, *_: every(mixed(tree.below_count(many, first)[0], second))

    second = _shared(_nodes(parsed, second_level), least_texts)
    two = context.broadcast(second)

    def keys() -> Callable[..., list]:
        tree = Tree(one.value, two.value)

        def of(*line: np.ndarray) -> list:
            _, least, a, b = tree.leaves(*line)
            return [(a, least > 0), (b, (least > 0) & (a != b))]

        return of

    often = _shared(_nodes(parsed, keys), least_texts)
    three = context.broadcast(often)

    def counted() -> Callable[..., list]:
        tree = Tree(one.value, two.value)

        def of(*line: np.ndarray) -> list:
            leaf, least, a, b = tree.leaves(*line)
            return [(leaf, (least > 0) & (_has(three.value, a) | _has(three.value, b)))]

        return of

    return first, second, often, _bits(_nodes(parsed, counted, "own").select(F.col("own").alias("node")))


def _cells(docs: DataFrame, maps: tuple[np.ndarray, ...]) -> DataFrame:
    """The lines with a key that enough texts share: ``id``, ``line``, ``leaf``, ``least`` (words of a template), ``cells`` (a hash for each token), ``fresh`` (those that no earlier line of the text has at the leaf and position)."""
    schema = pa.schema([("id", pa.int64()), ("line", pa.int32()), ("leaf", pa.int64()), ("least", pa.int32()), ("cells", pa.list_(pa.int64())), ("fresh", pa.list_(pa.bool_()))])
    shared = docs.sparkSession.sparkContext.broadcast(maps)  # four times BITMAP bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, often, own = shared.value
        tree, lines = Tree(first, second), memoryview(own)
        for b in batches:
            found = []
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, line in enumerate((text or "").split("\n")):
                    at = _signed(line) % BITMAP
                    if lines[at >> 3] >> (at & 7) & 1 and (tokens := masked(line)):
                        found.append((id_, k, tokens))
            if not found:
                yield batch(schema, [[]] * 6)
                continue
            leaf, least, one, two = tree.leaves(*(np.array(c, dtype=np.int64) for c in zip(*(heads(t) for *_, t in found), strict=True)))
            counted = (least > 0) & (_has(often, one) | _has(often, two))
            out, last, seen = [], None, set()
            for (id_, k, tokens), at, words, counts in zip(found, leaf.tolist(), least.tolist(), counted.tolist(), strict=True):
                if k == 0 or last is None or k <= last[1] or id_ != last[0]:  # the next text
                    seen = set()
                last = id_, k
                if counts:
                    cells = list(map(_signed, tokens))
                    places = [(at, p, c) for p, c in enumerate(cells)]
                    out.append((id_, k, at, words, cells, [p not in seen for p in places]))
                    seen.update(places)
            yield batch(schema, list(zip(*out, strict=True)) if out else [[]] * 6)

    return docs.mapInArrow(run, "id long, line int, leaf long, least int, cells array<long>, fresh array<boolean>")


def _keys(cells: DataFrame, least_texts: int) -> DataFrame:
    """``id``, ``line``, ``open``, ``key``: the lines' templates, 0 that of all frequent tokens, 1 the open one."""
    spread = cells.select("id", "line", "leaf", "least", F.posexplode(F.arrays_zip("cells", "fresh")).alias("at", "c"))
    spread = spread.select("id", "line", "leaf", "least", "at", F.col("c.cells").alias("cell"), F.col("c.fresh").alias("fresh"))
    counts = spread.filter("fresh").groupBy("leaf", "at", "cell").agg(F.count("*").alias("texts"))
    varying = counts.groupBy("leaf", "at").agg((F.count("*") >= least_texts).alias("varies"))
    # Written, so that the lines of a leaf that very many documents share can be split where they are joined.
    frequent = materialize(counts.filter(F.col("texts") >= least_texts).join(varying, ["leaf", "at"]).select("leaf", "at", "cell", "varies"))
    mark, word = F.xxhash64("at", "cell"), F.when(F.col("cell") != _signed(FIELD), 1)
    stays = ~F.col("varies")
    shapes = (
        spread.join(frequent, ["leaf", "at", "cell"])
        .groupBy("id", "line", "leaf", "least")
        .agg(
            F.bit_xor(mark).alias("full"),
            F.count(word).alias("words"),
            F.bit_xor(F.when(stays, mark)).alias("open"),
            F.count(F.when(stays, word)).alias("open_words"),
        )
    )
    full = F.when(F.col("words") >= F.col("least"), F.xxhash64("leaf", "full"))
    opened = F.when(F.col("open_words") >= F.col("least"), F.xxhash64("leaf", "open"))
    return shapes.select("id", "line", F.posexplode(F.array_distinct(F.array_compact(F.array(full, opened)))).alias("open", "key"))


def dropped_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_texts: int = LEAST_TEXTS) -> DataFrame:
    """``id`` and ``lines``, the positions of the lines that go, for each text that loses some."""
    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).filter("id is not null")
    parsed = materialize(_parsed(picked))
    lines = materialize(_keys(materialize(_cells(picked, _grown(parsed, least_texts))), least_texts))
    often = lines.select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least_texts).select("key")
    candidates = materialize(lines.join(materialize(often), "key", "left_semi"))
    shared = candidates.groupBy("id", "line").agg(F.max_by(F.xxhash64("key"), "open").alias("shared"))  # near copies agree in the open one
    sketches = (
        parsed.select("id", "line", "tokens", "own")
        .join(shared, ["id", "line"], "left")
        .groupBy("id")
        .agg(
            F.sum("tokens").alias("tokens"),
            F.sum(F.when(F.col("shared").isNull(), F.col("tokens")).otherwise(0)).alias("own_tokens"),
            F.min(F.when(F.col("shared").isNull(), F.col("own"))).alias("own"),
            F.min("shared").alias("shared"),
        )
        .filter("shared is not null")
        .select("id", F.when(F.col("own_tokens") > OWN_SHARE * F.col("tokens"), F.col("own")).otherwise(F.col("shared")).alias("sketch"))
    )
    # From documents to sketches to templates: each step sums before it shuffles.
    recurring = (
        candidates.join(sketches, "id")
        .groupBy("key", "sketch")
        .agg(F.min(F.struct("id", "line")).alias("first"))
        .groupBy("key")
        .agg(F.count("*").alias("unrelated"), F.min("first").alias("first"))
        .filter(F.col("unrelated") >= least_texts)
        .select("key", "first")
    )
    return (
        candidates.join(materialize(recurring), "key")
        .filter((F.col("id") != F.col("first.id")) | (F.col("line") != F.col("first.line")))
        .groupBy("id")
        .agg(F.collect_set("line").alias("lines"))  # bounded by a text's lines
    )


def drop_templates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_texts: int = LEAST_TEXTS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` without the lines of recurring templates, with the columns ``counts`` (in place of any of those names): the lines before, and those dropped."""
    gone = dropped_lines(docs, id_column, text_column, least_texts)
    free = "_".join(["gone", *docs.columns])  # longer than any column
    gone = gone.select(F.col("id").alias(f"id {free}"), F.col("lines").alias(f"lines {free}"))
    went = F.col(f"lines {free}")
    rows = docs.join(gone, F.col(id_column).cast("long") == F.col(f"id {free}"), "left")
    every = F.split(F.col(text_column), "\n", -1)
    kept = F.array_join(F.filter(every, lambda _, k: ~F.array_contains(went, k)), "\n")
    return rows.select(
        *[F.when(went.isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_column else F.col(c) for c in docs.columns if c not in counts],
        F.coalesce(F.size(every), F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size(went), F.lit(0)).cast("long").alias(counts[1]),
    )
