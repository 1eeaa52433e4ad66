"""Language identification by a bidirectional gated recurrent network over bytes.

The whole text is cut into windows of ``WINDOW`` bytes. In each, one gated
recurrent layer reads forwards and one backwards, and every position gets
probabilities of the languages from both; a document's are the mean over its
positions. The network is trained here, in numpy, by backpropagation through
time: the language of a document is the label of all positions of its windows.

Gates use the piecewise-linear sigmoid clip(x + 1/2, 0, 1). A byte's input
weights are one row of a table, so reading a byte is a lookup.

What is learned from is bounded: about ``TEXTS`` texts of each language, chosen
by a hash of their ids, and ``WINDOWS`` windows of each text. Every language of
the labels is learned; the driver gets one count and the sample of each, so
fitting takes as many times longer as there are more languages. Predictions take
every whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if there is nothing to learn from. Texts of any length are
read whole. Of languages that tie the first in the alphabet is predicted;
repeated rows and repeated ids are predicted one by one; an empty table gives an
empty table; extra columns are ignored. Language, source and id are no inputs
of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitwright.llm.common import batch

TEXTS, WINDOWS = 500, 4
WINDOW, HIDDEN, ROWS = 64, 8, 4096


@dataclass
class Network:
    """Axis 0 of all but ``out`` and ``bias`` is the direction. Columns of ``table`` and ``inner``: update, reset, candidate."""

    languages: list[str]
    table: np.ndarray  # (2, 256, 3 h): a byte's input
    inner: np.ndarray  # (2, h, 3 h)
    out: np.ndarray  # (2, h, languages)
    bias: np.ndarray  # (languages,)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.out, self.bias]


def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    f = np.float32
    return Network(
        languages,
        rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(f),
        rng.normal(0, 0.3, (2, hidden, 3 * hidden)).astype(f),
        rng.normal(0, 0.3, (2, hidden, len(languages))).astype(f),
        np.zeros(len(languages), dtype=f),
    )


def _both(windows: np.ndarray) -> np.ndarray:
    """Bytes by direction and step: (2, steps, rows); the second direction starts at the end."""
    steps = windows.T
    return np.stack((steps, steps[::-1]))


def states(net: Network, windows: np.ndarray) -> np.ndarray:
    """The hidden state at each position: (2, steps, rows, h), each direction in its own order."""
    steps, h = _both(windows), net.inner.shape[1]
    n = windows.shape[0]
    out = np.empty((2, steps.shape[1], n, h), dtype=np.float32)
    state = np.zeros((2, n, h), dtype=np.float32)
    x, g = np.empty((2, n, 3 * h), dtype=np.float32), np.empty((2, n, 3 * h), dtype=np.float32)
    for t in range(steps.shape[1]):
        for d in (0, 1):
            np.take(net.table[d], steps[d, t], axis=0, out=x[d])
        np.matmul(state, net.inner, out=g)
        gates = x[..., : 2 * h] + g[..., : 2 * h]
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        candidate = g[..., 2 * h :] * gates[..., h:]
        candidate += x[..., 2 * h :]
        np.tanh(candidate, out=candidate)
        candidate -= state
        candidate *= gates[..., :h]
        state = state + candidate
        out[:, t] = state
    return out


def position_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """(steps, rows, languages)."""
    hidden = states(net, windows)
    logits = hidden[0] @ net.out[0]
    logits += hidden[1, ::-1] @ net.out[1]
    logits += net.bias
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def gradients(net: Network, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the positions within ``lengths``, and its gradients, by backpropagation through time."""
    steps, h = _both(windows), net.inner.shape[1]
    n, length = windows.shape
    hidden = states(net, windows)
    p = position_probabilities(net, windows)
    real = (np.arange(length)[:, None] < lengths[None, :]).astype(np.float32)
    total = real.sum()
    at = p[:, np.arange(n), labels]
    loss = float(-(np.log(at + 1e-9) * real).sum() / total)
    d_logit = p
    d_logit[:, np.arange(n), labels] -= 1
    d_logit *= (real / total)[..., None]
    g_bias = d_logit.sum(axis=(0, 1))
    d_by_direction = np.stack((d_logit, d_logit[::-1]))
    g_out = np.einsum("dtnh,dtnk->dhk", hidden, d_by_direction, optimize=True)
    d_hidden = np.matmul(d_by_direction, net.out.transpose(0, 2, 1)[:, None])
    g_table, g_inner = np.zeros_like(net.table), np.zeros_like(net.inner)
    carry = np.zeros((2, n, h), dtype=np.float32)
    for t in range(length - 1, -1, -1):
        before = hidden[:, t - 1] if t else np.zeros((2, n, h), dtype=np.float32)
        x = np.stack([net.table[d][steps[d, t]] for d in (0, 1)])
        g = before @ net.inner
        raw = x[..., : 2 * h] + g[..., : 2 * h] + 0.5
        gates = np.clip(raw, 0, 1)
        slope = ((raw > 0) & (raw < 1)).astype(np.float32)
        update, reset = gates[..., :h], gates[..., h:]
        candidate = np.tanh(x[..., 2 * h :] + reset * g[..., 2 * h :])
        d = d_hidden[:, t] + carry
        d_candidate = d * update * (1 - candidate**2)
        d_gates = np.concatenate((d * (candidate - before), d_candidate * g[..., 2 * h :]), axis=2) * slope
        d_x = np.concatenate((d_gates, d_candidate), axis=2)
        d_g = np.concatenate((d_gates, d_candidate * reset), axis=2)
        for k in (0, 1):
            np.add.at(g_table[k], steps[k, t], d_x[k])
        g_inner += before.transpose(0, 2, 1) @ d_g
        carry = d * (1 - update) + d_g @ net.inner.transpose(0, 2, 1)
    return loss, [g_table, g_inner, g_out, g_bias]


def fit(texts: list[bytes], labels: list[str], epochs: int = 6, rows: int = 128, rate: float = 0.02, seed: int = 3) -> Network:
    """A network from windows of text and their languages, by Adam on clipped gradients."""
    languages = sorted(set(labels))
    net = fresh(languages, seed=seed)
    windows, lengths = windowed(texts)
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    step, planned = 0, epochs * max(1, len(y) // rows)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // rows)):
            _, grads = gradients(net, windows[at], lengths[at], y[at])
            norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
            step += 1
            for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
                g = g * min(1, 1 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (1 - step / (planned + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def windowed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts of up to ``WINDOW`` bytes as rows padded with zeros, and their lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    joined = b"".join(t.ljust(WINDOW, b"\0") for t in texts)
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(texts), WINDOW), lengths


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """The mean probabilities of each (non-empty) text, over all its bytes: (texts, languages)."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts])
    joined = np.frombuffer(b"".join(t.ljust(c * WINDOW, b"\0") for t, c in zip(texts, counts, strict=True)), dtype=np.uint8).reshape(-1, WINDOW)
    lengths = np.full(len(joined), WINDOW)
    ends = np.cumsum(counts)
    lengths[ends - 1] = [len(t) - (c - 1) * WINDOW for t, c in zip(texts, counts, strict=True)]
    sums = np.empty((len(joined), len(net.languages)), dtype=np.float64)
    for start in range(0, len(joined), ROWS):
        part = slice(start, start + ROWS)
        p = position_probabilities(net, joined[part])
        p *= (np.arange(WINDOW)[:, None] < lengths[None, part])[..., None]
        sums[part] = p.sum(axis=0)
    return np.add.reduceat(sums, ends - counts, axis=0) / np.array([len(t) for t in texts])[:, None]


def train(docs: DataFrame, learnable: F.Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Network | None:
    """A network from the texts with a language where ``learnable`` holds, or None if there are none."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    rows = rows.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.5 * TEXTS / r["count"]))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * 1_000_000
    schema = pa.schema([("lang", pa.string()), ("windows", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = []
            for text in b.column(1).to_pylist():
                whole = text.encode("utf-8")
                starts = np.unique(np.linspace(0, max(0, len(whole) - WINDOW), WINDOWS).astype(int))
                cut.append([whole[s : s + WINDOW] for s in starts.tolist() if whole])
            yield batch(schema, [b.column(0), cut])

    sample = rows.filter(drawn).select("lang", "text").mapInArrow(run, "lang string, windows array<binary>").orderBy("lang", F.xxhash64("windows")).collect()
    texts, labels, taken = [], [], dict.fromkeys([r["lang"] for r in counts], 0)
    for r in sample:
        if taken[r["lang"]] < TEXTS:
            taken[r["lang"]] += 1
            texts += [bytes(w) for w in r["windows"]]
            labels += [r["lang"]] * len(r["windows"])
    return fit(texts, labels) if texts else None


def predict(docs: DataFrame, net: Network | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if own is not None and t and any(map(str.isalpha, t))]
            # Bounded memory: a few megabytes of text at a time, whole texts each.
            start = 0
            while start < len(known):
                end, size = start, 0
                while end < len(known) and size < 4_000_000:
                    size += len(texts[known[end]])
                    end += 1
                p = pooled(own, [texts[i].encode("utf-8") for i in known[start:end]])
                for i, best, top in zip(known[start:end], p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    lang[i], score[i] = own.languages[best], min(1.0, top)
                start = end
            yield batch(schema, [b.column(0), lang, score])

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")
