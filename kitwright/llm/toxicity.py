"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and word beginnings is trained in numpy from
confirmed toxic texts (positives) and unlabelled texts. Unlabelled texts hold
the class prior's share of toxic ones, so the risk of calling a text clean is
measured on them and the positives' part of it, prior times the positives'
mean, is taken off. Where that estimate turns negative, which only overfitting
can do, the step goes the other way instead (the non-negative correction).

What is learned from is bounded: at most ``POSITIVES`` confirmed and
``UNLABELLED`` further texts, chosen by a hash of their ids, and ``FEATURES``
features. Scoring takes every whole text.

Defined results: a null or empty text has no features and gets the score of the
bias alone; with no confirmed positive, or no feature that tells them apart, there is nothing
to learn and every score is next to 0. Texts of any length are scored whole, by
their distinct words; repeated rows and repeated ids are scored one by one; an
empty table gives an empty table, and without labels nothing is rejected. Extra
columns are ignored by scores and kept by :func:`keep_clean`. Labels of held-out
ids are never read; language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitwright.llm.common import batch, materialize
from kitwright.llm.simhash import shingle_hashes

POSITIVES, UNLABELLED, FEATURES = 3000, 12000, 2000
#: A feature is used if it stands in at least ``LEAST`` of the texts learned from, and its share among positives exceeds
#: that among the unlabelled by ``LIFT`` of what a feature of toxic texts alone would show (1 / prior) and by ``ERRORS`` standard errors.
LEAST, LIFT, ERRORS = 3, 0.4, 4.0
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct words in lower case, and distinct beginnings of longer words (marked by a trailing ``-``)."""
    words = set(LETTERS.findall((text or "").lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update({w[:n] + "-" for w in words if len(w) > n})
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        known = self.weights
        words = set(LETTERS.findall((text or "").lower()))
        z = self.bias + sum([known[w] for w in words & known.keys()])
        for n in BEGINNINGS:
            z += sum([known[w] for w in {w[:n] + "-" for w in words if len(w) > n} & known.keys()])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def nnpu(rows: list[np.ndarray], positive: np.ndarray, width: int, prior: float, epochs: int = 60, rate: float = 0.05, decay: float = 1e-4, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias minimising the non-negative risk with the sigmoid loss, by Adam.

    ``rows``: the features of each text; ``positive``: which of them are
    confirmed, the others are unlabelled.
    """
    rng = np.random.default_rng(seed)
    w, moment, second, step = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1), 0
    w[width] = np.log(prior / (1 - prior))
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    rounds = max(1, len(unl) // 500)

    def forward(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate([rows[i] for i in at]) if len(at) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(at)), [len(rows[i]) for i in at])
        z = np.bincount(owner, weights=w[flat], minlength=len(at)) + w[width]
        return flat, owner, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for _ in range(epochs):
        for p_at, u_at in zip(np.array_split(rng.permutation(pos), rounds), np.array_split(rng.permutation(unl), rounds), strict=True):
            if not len(p_at) or not len(u_at):
                continue
            p_flat, p_owner, p = forward(p_at)
            u_flat, u_owner, u = forward(u_at)
            # Losses: 1 - s for calling a positive clean, s for calling a clean text toxic.
            negative_risk = u.mean() - prior * p.mean()
            slope_p, slope_u = p * (1 - p) / len(p), u * (1 - u) / len(u)
            if negative_risk >= 0:
                g_p, g_u = -2 * prior * slope_p, slope_u
            else:
                g_p, g_u = prior * slope_p, -slope_u
            grad = np.zeros(width + 1)
            grad += np.bincount(p_flat, weights=g_p[p_owner], minlength=width + 1)
            grad += np.bincount(u_flat, weights=g_u[u_owner], minlength=width + 1)
            grad[width] += g_p.sum() + g_u.sum()
            grad[:width] += decay * w[:width]
            step += 1
            moment = 0.9 * moment + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            w -= rate * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:width], float(w[width])


def _bounded(rows: DataFrame, at_most: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(at_most)


def train(docs: DataFrame, labels: DataFrame, learnable: F.Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """A model from the confirmed toxic rows of ``labels`` where ``learnable`` holds, and from unlabelled texts.

    The class prior is the toxic share of the labelled rows that may be learned from.
    """
    marks = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("toxic")).filter(learnable & F.col("toxic").isNotNull())
    n, n_toxic = marks.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    if not n_toxic:
        return Model({}, -30.0)
    prior = n_toxic / (n + 1)  # below 1 even if all are toxic
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    ids = texts.select("doc_id").filter("doc_id is not null")
    confirmed = marks.filter("toxic = 1").select("doc_id").distinct().join(ids, "doc_id", "left_semi")
    chosen = _bounded(confirmed, POSITIVES).withColumn("positive", F.lit(True)).unionByName(_bounded(ids, UNLABELLED).withColumn("positive", F.lit(False)))
    schema = pa.schema([("doc_id", pa.int64()), ("positive", pa.bool_()), ("found", pa.list_(pa.string())), ("sketch", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(2).to_pylist()
            sketches = [int(h.min().view(np.int64)) if len(h := shingle_hashes(t, 5)) else 0 for t in rows]
            yield batch(schema, [b.column(0), b.column(1), [sorted(features(t)) for t in rows], sketches])

    # The chosen ids are bounded, so their texts are found by a broadcast. Of copies and near copies (equal sketches) one is learned from.
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", "text").mapInArrow(run, "doc_id long, positive boolean, found array<string>, sketch long")
    sample = materialize(sample.groupBy("positive", "sketch").agg(F.min_by("found", F.struct("doc_id", "found")).alias("found")).select("positive", "found"))
    n_pos, n_unl = sample.agg(F.count(F.when(F.col("positive"), 1)), F.count(F.when(~F.col("positive"), 1))).first()
    if not n_pos or not n_unl:
        return Model({}, -30.0)
    # Features by how far their share among positives is above that among the unlabelled, in standard errors.
    counts = sample.select("positive", F.explode("found").alias("f")).groupBy("f").agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("u"))
    of_p, of_u, mean = F.col("p") / n_pos, F.col("u") / n_unl, (F.col("p") + F.col("u")) / (n_pos + n_unl)
    errors = (of_p - of_u) / F.sqrt(mean * (1 / n_pos + 1 / n_unl))
    top = counts.filter((F.col("p") >= LEAST) & (of_p >= of_u * LIFT / prior) & (errors >= ERRORS)).orderBy(errors.desc(), "f").limit(FEATURES)
    vocabulary = [r[0] for r in top.select("f").collect()]
    if not vocabulary:  # nothing tells the positives apart
        return Model({}, -30.0)
    place = {f: i for i, f in enumerate(vocabulary)}
    indexed = pa.schema([("positive", pa.bool_()), ("at", pa.list_(pa.int32()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(indexed, [b.column(0), [sorted(place[f] for f in found if f in place) for found in b.column(1).to_pylist()]])

    rows = sample.mapInArrow(index, "positive boolean, at array<int>").toArrow()
    at = [np.asarray(x.values, dtype=np.int64) for x in rows.column("at").combine_chunks()]
    positive = np.asarray(rows.column("positive"))
    order = sorted(range(len(at)), key=lambda i: (positive[i], at[i].tobytes()))  # whatever order the rows came in
    weights, bias = nnpu([at[i] for i in order], positive[order], len(vocabulary), prior)
    return Model({f: float(x) for f, x in zip(vocabulary, weights, strict=True) if abs(x) > 1e-6}, bias)


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) for every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for b in batches:
            yield batch(schema, [b.column(0), [score(t) for t in b.column(1).to_pylist()]])

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_column)).to_pylist()
            yield b.filter(pa.array([score(t) < threshold for t in texts], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
