"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the largest coordinate with its sign, the nearest corner
of the cross-polytope. Each of ``tables`` tables concatenates two such hashes.
A vector is entered under its own code and, as probes, under the codes whose
corners come next. Rows that meet are compared by cosine in double precision,
in bounded blocks, so only links of the threshold or more are kept.

A pair that meets in several buckets is counted in the first of them: each row
knows all its codes, so this is decided where the pair is found, and what is
emitted is a count and a spanning link for each row, never the pairs.

Equal vectors of one label are one class. Its size counts in the links.

Defined results: rows whose label or vector is null, or whose vector is empty,
zero or has null or non-finite components link with nothing; vectors of
different lengths never link; an id is its own component where it has no links.
Each row gets one row; rows that repeat an id are vectors of their own, which
link if they are near (a repeated row links with its twin) and have the same
id as any other; a row with a null id links with nothing and has no component.
Cosines that tie with the threshold link. An empty table gives an empty table;
vectors of any length are taken whole. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitwright.llm.common import batch, materialize
from kitwright.llm.linking import block_pairs, components

#: Rows of a block of a bucket, and rows of it compared at a time.
BLOCK_ROWS, CHUNK = 1024, 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of the rows of ``x``, whose width is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return x


def codes(vectors: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """Codes of each row and table, the row's own first: shape (rows, tables, 1 + probes)."""
    n, d = vectors.shape
    width = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = vectors
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    each = min(3, 2 * width)
    for t in range(tables):
        corner, loss = [], []
        for k in range(2):
            rng = np.random.default_rng([seed, t, k])
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice((-1.0, 1.0), width)) / width**0.5
            both = np.concatenate((x, -x), axis=1)
            top = np.argpartition(-both, each - 1, axis=1)[:, :each]
            score = np.take_along_axis(both, top, axis=1)
            order = np.argsort(-score, axis=1, kind="stable")
            corner.append(np.take_along_axis(top, order, axis=1))
            score = np.take_along_axis(score, order, axis=1)
            loss.append((score[:, :1] - score) ** 2)
        pairs = (corner[0][:, :, None] * 2 * width + corner[1][:, None, :]).reshape(n, -1)
        cost = (loss[0][:, :, None] + loss[1][:, None, :]).reshape(n, -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        out[:, t] = np.take_along_axis(pairs, best, axis=1)
    return out


def _hashed(classes: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """Valid classes: ``id``, ``n``, ``label``, ``dims``, ``vector`` (unit length, bytes) and ``codes``."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("vector", pa.binary()), ("codes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_dims: dict[int, list[tuple]] = {}
            for id_, n, label, values in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                v = np.array(values.as_py(), dtype=np.float64) if values.is_valid else np.empty(0)
                if len(v) and np.isfinite(v).all() and (largest := np.abs(v).max()) > 0:
                    v /= largest
                    by_dims.setdefault(len(v), []).append((id_, n, label, v / np.sqrt(v @ v)))
            for dims, rows in by_dims.items():
                ids, ns, labels, vectors = zip(*rows, strict=True)
                found = codes(np.array(vectors), tables, probes, seed).reshape(len(rows), -1)
                yield batch(schema, [ids, ns, labels, [dims] * len(rows), [v.tobytes() for v in vectors], list(found)])

    return classes.select("id", "n", "label", "vector").mapInArrow(run, "id long, n long, label string, dims int, vector binary, codes array<long>")


def block_links(own: np.ndarray, block: np.ndarray, across: bool, vectors: np.ndarray, table: int, code: int, threshold: float, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of one job: how many vectors each links with that this job counts, and the first row of its component.

    ``own``: (rows, tables, 1 + probes) codes. ``block``: the block of each
    row; if ``across``, only pairs of two blocks are looked at.
    """
    counted, root = np.zeros(len(vectors), dtype=np.int64), np.arange(len(vectors))
    linked: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(vectors), CHUNK):
        part = slice(start, start + CHUNK)
        cosine = vectors[part] @ vectors.T
        i, j = np.nonzero(cosine >= threshold)
        i += start
        keep = (i < j) & ((block[i] != block[j]) if across else True)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        linked.append((i.astype(np.int32), j.astype(np.int32)))
        # Buckets in which two rows meet: one's own code that the other has too.
        first = own[i, :, 0]
        other = own[j, :, 0]
        a = np.where((first[:, :, None] == own[j]).any(axis=2), first, np.int64(2**62))
        b = np.where((other[:, :, None] == own[i]).any(axis=2), other, np.int64(2**62))
        least = np.minimum(a, b)
        meets = least < 2**62
        first_table = meets.argmax(axis=1)
        here = meets.any(axis=1) & (first_table == table) & (least[np.arange(len(i)), first_table] == code)
        np.add.at(counted, i[here], sizes[j[here]])
        np.add.at(counted, j[here], sizes[i[here]])
    if linked:
        i, j = (np.concatenate(x) for x in zip(*linked, strict=True))
        while not np.array_equal(root[i], root[j]):  # the smallest row of each component spreads
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            root = root[root]
    return counted, root


def _links(hashed: DataFrame, tables: int, probes: int, threshold: float) -> DataFrame:
    """For each class that links: ``id``, ``links`` (vectors of other classes, as counted by a job) and ``root``."""
    entries = hashed.select("id", "label", "dims", F.posexplode("codes").alias("place", "code")).select(
        "id", "label", "dims", F.expr(f"place div {1 + probes}").alias("tab"), "code", (F.col("place") % (1 + probes) == 0).alias("own")
    )
    keys = ["label", "dims", "tab", "code"]
    base = entries.filter("own").select(*keys, "id")
    met = entries.filter("not own").select(*keys, "id").join(base.select(*keys), keys, "left_semi")
    dealt = block_pairs(base.unionByName(met), keys, "id", BLOCK_ROWS).join(hashed.select("id", "n", "vector", "codes"), "id")
    # Two blocks of bounded size a group.
    jobs = dealt.groupBy(*keys, "block_a", "block_b").agg(F.collect_list(F.struct("id", "block", "n", "vector", "codes")).alias("m"))
    jobs = jobs.select("tab", "code", (F.col("block_a") != F.col("block_b")).alias("across"), "m.id", "m.block", "m.n", "m.vector", "m.codes")
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                table, code, across = (b.column(c)[k].as_py() for c in range(3))
                ids, block, sizes = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (3, 4, 5))
                vectors = np.array([np.frombuffer(v, dtype=np.float64) for v in b.column(6)[k].as_py()])
                own = b.column(7)[k].values.flatten().to_numpy().reshape(len(ids), tables, 1 + probes)
                order = np.lexsort((ids, block))
                counted, root = block_links(own[order], block[order], across, vectors[order], table, code, threshold, sizes[order])
                ids = ids[order]
                some = np.flatnonzero((counted > 0) | (root != np.arange(len(ids))))
                out += zip(ids[some], counted[some], ids[root[some]], strict=True)
            yield batch(schema, list(zip(*out, strict=True)) if out else [[], [], []])

    return jobs.mapInArrow(run, "id long, links long, root long")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, tables: int = 10, probes: int = 3, seed: int = 11,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """One row for each vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    rows = vectors.selectExpr(f"cast(`{id_column}` as long) as vec_id", f"cast(`{label_column}` as string) as label", f"`{vector_column}` as vector")
    usable = rows.filter("label is not null and vector is not null and vec_id is not null")
    # Classes are numbered, since ids may repeat. Written, so that a class of many rows can be split where it is joined.
    classes = materialize(usable.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))).withColumn("id", F.monotonically_increasing_id())
    hashed = materialize(_hashed(classes, tables, probes, seed))
    found = materialize(_links(hashed, tables, probes, threshold))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    nodes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    smallest = nodes.join(classes.select(F.col("id").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("smallest"))
    named = (
        hashed.select("id", "n")
        .join(counts, "id", "left")
        .join(nodes.join(smallest, "component").select(F.col("node").alias("id"), "smallest"), "id", "left")
        .select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "smallest")
    )
    known = materialize(classes.join(named, "id").select("label", "vector", "links", F.coalesce("smallest", "first").alias("component")))
    component = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("component")), F.col("vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.col("links"))
    return rows.join(known, ["label", "vector"], "left").select(
        "vec_id", F.coalesce(links, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept")
    )
