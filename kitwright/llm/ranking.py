"""Ranked lexical search by dual trees.

Every item is a bag of terms, every document a vector with a contribution for
each term (an integer form of BM25), and the score is their product. Both sides
form hierarchies whose nodes hold the maximum of each coordinate below them, so
the product of two nodes bounds every score between them. A pair of nodes is
gone into only if its bound reaches the weakest k-th score among the node's
items; what is left are exact scores, so nothing is lost.

Documents are read once, each becoming its counts of the items' terms, which
stay in the partition where they were read. A task forms hierarchies over
blocks of its documents, alike ones next to each other. A first round over a
part of the documents (``FIRST``) gives each item a k-th score to start from,
which is a bound that all documents together can only raise; the second round
goes over all of them. Each task returns its best documents of each item, and
the best of these are ranked. The items are read in parts of at most
``PART_BYTES`` (one, unless they are larger), which bounds what is shared.

Defined results: documents that are null or empty, or have no term, are in no
count and no result; so are items, and documents without a term of an item are
not in its list. Texts of any length are taken whole. Equal scores go by
ascending id, a null id last; rows that repeat a document's id or an item's id
are taken one by one, and items with a null id too. An empty table on either
side gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kitwright.llm.common import AS_WORDS, batch, materialize

#: Bytes of items shared at once, counts of a block of documents, documents of a leaf, children of a node of documents and of items.
PART_BYTES, BLOCK_COUNTS, LEAF, FAN, ITEM_FAN = 4_000_000, 1 << 20, 16, 16, 8
#: One in so many documents is looked at in the first round.
FIRST = 32
#: Stands for a null id where ids are ordered.
NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(AS_WORDS).split()


def counted(docs: DataFrame, vocabulary: Broadcast, id_column: str, text_column: str) -> DataFrame:
    """``doc_id``, ``n`` (all terms), and ``term`` and ``tf``, the numbers and counts of the terms in ``vocabulary``, for documents with terms."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: k for k, term in enumerate(vocabulary.value)}.get
        for b in batches:
            ids, sizes, which, times = [], [], [], []
            for id_, text in zip(b.column(0), b.column(1), strict=True):
                words = terms(text.as_py())
                if words:
                    known = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                    term, tf = np.unique(known[known >= 0], return_counts=True)
                    ids.append(id_.as_py())
                    sizes.append(len(words))
                    which.append(term)
                    times.append(tf)
            yield batch(schema, [ids, sizes, which, times])

    return docs.selectExpr(f"cast(`{id_column}` as long)", f"`{text_column}`").mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


class Level:
    """The nodes of one level of a hierarchy: for node i the ``term`` and ``value`` from ``at[i]`` to ``at[i + 1]``, by term."""

    def __init__(self, at: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.at, self.term, self.value = at, term, value

    def __len__(self) -> int:
        return len(self.at) - 1

    def above(self, fan: int) -> Level:
        """Each ``fan`` neighbours as one node, with the maximum of each coordinate."""
        node = np.repeat(np.arange(len(self)) // fan, np.diff(self.at))
        order = np.lexsort((self.term, node))
        node, term, value = node[order], self.term[order], self.value[order]
        first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (term[1:] != term[:-1]))) if len(node) else node
        many = -(-len(self) // fan)
        return Level(np.searchsorted(node[first], np.arange(many + 1)), term[first], np.maximum.reduceat(value, first) if len(first) else value)

    def picked(self, rows: np.ndarray) -> Level:
        """The nodes ``rows``, in that order."""
        size = (self.at[1:] - self.at[:-1])[rows]
        at = np.append(0, np.cumsum(size))
        place = np.arange(at[-1]) + np.repeat(self.at[rows] - at[:-1], size)
        return Level(at, self.term[place], self.value[place])

    def products(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The product of each of ``rows`` with ``weights``, a number for each term."""
        some = self if len(rows) == len(self) else self.picked(rows)
        sums = np.append(0, np.cumsum(weights[some.term] * some.value))
        return sums[some.at[1:]] - sums[some.at[:-1]]


def alike(level: Level) -> np.ndarray:
    """An order of the nodes that brings those with the same greatest coordinates together."""
    node = np.repeat(np.arange(len(level)), np.diff(level.at))
    by_value = np.lexsort((level.term, -level.value, node))
    ranked = level.term[by_value]
    heads = [np.where(np.diff(level.at) > k, ranked[np.minimum(level.at[:-1] + k, max(len(ranked) - 1, 0))] if len(ranked) else 0, -1) for k in range(3)]
    return np.lexsort(heads[::-1])


class Items:
    """The hierarchy over the items of a part: level 0 are the items, in an order that puts alike ones together."""

    def __init__(self, bags: list[dict[int, int]], weight: np.ndarray):
        at = np.append(0, np.cumsum([len(b) for b in bags], dtype=np.int64))
        term = np.array([t for b in bags for t in sorted(b)], dtype=np.int64)
        times = np.array([b[t] for b in bags for t in sorted(b)], dtype=np.int64)
        self.order = alike(Level(at, term, times * weight[term]))
        self.levels = [Level(at, term, times).picked(self.order)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].above(ITEM_FAN))


class Best:
    """The best documents of each item (by its place in ``items.order``) among those seen, and the score to reach."""

    def __init__(self, items: Items, vocabulary: int, floor: np.ndarray, k: int):
        self.items, self.k, self.weights = items, k, np.zeros(vocabulary, dtype=np.int64)
        self.least = floor.copy()
        self.scores = [np.empty(0, np.int64)] * len(floor)
        self.ids = [np.empty(0, np.int64)] * len(floor)

    def add(self, ids: np.ndarray, docs: Level) -> None:
        if not self.ids:
            return
        order = alike(docs)
        self.now, self.levels = ids[order], [docs.picked(order)]
        for fan in (LEAF, FAN):
            self.levels.append(self.levels[-1].above(fan))
        self._visit(len(self.items.levels) - 1, 0, len(self.levels) - 1, np.arange(len(self.levels[-1])))

    def _visit(self, height: int, node: int, level: int, rows: np.ndarray) -> None:
        """Goes on with the pairs of an item node and document nodes whose bound reaches the weakest of the items' scores."""
        own = self.items.levels[height]
        a, b = own.at[node : node + 2]
        self.weights[own.term[a:b]] = own.value[a:b]
        bound = self.levels[level].products(rows, self.weights)
        self.weights[own.term[a:b]] = 0
        span = ITEM_FAN**height
        keep = (bound > 0) & (bound >= self.least[node * span : (node + 1) * span].min())
        rows = rows[keep]
        if not len(rows):
            return
        if not height and not level:
            self._take(node, bound[keep], self.now[rows])
            return
        if level:
            fan = (LEAF, FAN)[level - 1]
            rows = (rows[:, None] * fan + np.arange(fan)).ravel()
            rows = rows[rows < len(self.levels[level - 1])]
        below = range(node * ITEM_FAN, min((node + 1) * ITEM_FAN, len(self.items.levels[height - 1]))) if height else (node,)
        for child in below:
            self._visit(max(height - 1, 0), child, max(level - 1, 0), rows)

    def _take(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores[item], scores), np.append(self.ids[item], ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], int(scores[order[-1]]))


def contributions(n: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term of that count and weight adds to the score of a document of ``n`` terms, in whole numbers."""
    m = 25 + (75 * n * documents) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def _best(counts: DataFrame, shared: Broadcast, k: int) -> DataFrame:
    """``item`` (its place), ``doc_id`` and ``score`` of each task's best documents of each item."""
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, documents, length, floor = shared.value
        best = Best(items, len(weight), floor, k)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def go() -> None:
            ids, n, many, term, tf = map(np.concatenate, zip(*held, strict=True))
            term = term.astype(np.int64)
            value = contributions(np.repeat(n, many), tf.astype(np.int64), weight[term], documents, length)
            best.add(ids, Level(np.append(0, np.cumsum(many, dtype=np.int64)), term, value))
            held.clear()

        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                ids = part.column(0).fill_null(int(NO_ID)).to_numpy()
                term, tf = part.column(2), part.column(3)
                held.append((ids, part.column(1).to_numpy(), term.value_lengths().to_numpy(), term.flatten().to_numpy(), tf.flatten().to_numpy()))
                size += len(held[-1][3])
                if size >= BLOCK_COUNTS:
                    go()
                    size = 0
        if held:
            go()
        many = [len(s) for s in best.scores]
        ids = np.concatenate([*best.ids, np.empty(0, np.int64)])
        yield batch(schema, [np.repeat(np.arange(len(many)), many), pa.array(ids, mask=ids == NO_ID), np.concatenate([*best.scores, np.empty(0, np.int64)])])

    return counts.filter("size(term) > 0").mapInArrow(run, "item int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``."""
    wanted = items.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // PART_BYTES))
    out = None
    for part in range(parts):
        # Of PART_BYTES, or the parts' share of it.
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        bags = [(r.item_id, terms(r.text)) for r in rows]
        one = _of_part(docs, [(i, words) for i, words in bags if words], k, id_column, text_column)
        if parts > 1:  # one part after another, so that one is held at a time
            one = materialize(one)
        out = one if out is None else out.unionByName(one)
    return out


def _of_part(docs: DataFrame, bags: list[tuple[int | None, list[bytes]]], k: int, id_column: str, text_column: str) -> DataFrame:
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    number: dict[bytes, int] = {}
    numbered = []
    for _, words in bags:
        bag: dict[int, int] = {}
        for w in words:
            t = number.setdefault(w, len(number))
            bag[t] = bag.get(t, 0) + 1
        numbered.append(bag)
    vocabulary = context.broadcast(list(number))
    counts = materialize(counted(docs, vocabulary, id_column, text_column))
    documents, length = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Rows of the vocabulary of a part.
    holding = dict(map(tuple, counts.select(F.explode("term").alias("term")).groupBy("term").count().collect()))
    weight = weights(np.array([holding.get(t, 0) for t in range(len(number))], dtype=np.int64), documents)
    tree = Items(numbered, weight)
    shared = lambda floor: context.broadcast((tree, weight, documents, max(length, 1), floor))
    floor = np.zeros(len(bags), dtype=np.int64)
    first = counts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST)) == 0)
    for r in _ranked(_best(first, shared(floor), k), k).filter(F.col("rank") == k).select("item", "score").collect():  # one row an item of the part
        floor[r["item"]] = r["score"]
    best = _ranked(_best(counts, shared(floor), k), k)
    named = spark.createDataFrame([(place, bags[i][0]) for place, i in enumerate(tree.order.tolist())], "item int, item_id long")
    return best.join(named, "item").select("item_id", "rank", "doc_id", "score")


def oracle(k: int = 10) -> str:
    """DuckDB SQL for :func:`search` of ``benchmark`` in ``documents``."""
    words = lambda text: f"list_transform(regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
    return f"""WITH asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({words("text")}) AS term FROM benchmark) GROUP BY ALL),
told AS (SELECT doc_id, unnest({words("text")}) AS term FROM documents),
long AS (SELECT doc_id, count(*) AS n FROM told GROUP BY doc_id),
whole AS (SELECT count(*) AS documents, sum(n)::BIGINT AS length FROM long),
counts AS (SELECT doc_id, term, count(*) AS tf FROM told WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), whole),
scores AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // length))))::BIGINT AS score
  FROM counts JOIN asked USING (term) JOIN weights USING (term) JOIN long USING (doc_id), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
