"""SimHash near-duplicates by multi-index hashing.

A text's shingles are hashed to 64 bits (and, for longer fingerprints, mixed to
further 64-bit words); a fingerprint bit is set if it is set in over half of
the hashes. Fingerprints are cut into segments. Two fingerprints within the
distance looked for agree up to ``radius`` bits in some segment, so every
fingerprint is entered in one table a segment, the Hamming ball of that radius
around each segment is enumerated as probes, and what meets in a table is
verified over the complete distance. Of two segments one bit apart only the one
that lacks the bit probes, which finds the pair and halves the probes.

Equal fingerprints are one class with one entry, so copies cost nothing more.
Near copies are joined to the smallest id they meet first, one comparison each;
what is left to compare in a bucket is dealt by :mod:`kitwright.llm.linking` in
bounded blocks, with output linear in their members.

Defined results: a null or empty text has no words and the fingerprint zero,
and is linked like any other; texts of fewer words than a shingle have one
shingle, the whole sequence; texts of any length are taken whole; rows with a
null id have the group of their fingerprint's other rows, or none; rows that
repeat an id are one document, linked by any of their texts; an empty table
gives an empty table. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitwright.llm.common import batch, materialize
from kitwright.llm.linking import components, group_pairs, tasks

#: Seed of a shingle's XXH64, rows of a block of a bucket, shingles of a block of sets, shingles counted at a time, and members beyond which a component is a crowd.
SEED, BLOCK_ROWS, BLOCK_SHINGLES, CHUNK, CROWD = 42, 2048, 1 << 18, 8192, 64
#: Texts whose sets of shingles one task writes, about.
SETS_A_TASK = 5_000
#: Texts of up to that many distinct shingles are also compared exactly wherever they share a rare enough shingle.
#: Pairs beyond have 33 shingles or more each, where the share of differing bits is at most ``EXCESS`` times the formula's.
SHORT, EXCESS = 40, 1.04
#: Cells that count the shingles of short texts, by which the rare ones go first.
CELLS = 1 << 18
#: Words of a fingerprint that a probe of :func:`jaccard_groups` carries to be compared where it meets another.
HEAD = 3
#: Odd constants that mix a hash to further words: multiples of the golden ratio's 64-bit fraction.
GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the text's ``size``-word shingles, repeats included; ASCII letters in lower case."""
    words = (text or "").encode("utf-8").lower().split()  # on bytes both mean ASCII: A-Z, and \\x20\\x09-\\x0D
    if len(words) > size:
        shingles = list(map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False)))
    else:
        shingles = [b" ".join(words)] if words else []
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(shingles))


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    if word == 0:
        return hashes
    x = hashes + np.uint64(GOLDEN * word % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(GOLDEN * (2 * word + 1) % 2**64 | 1)
    return x ^ (x >> np.uint64(31))


def fingerprint_bits(hashes: np.ndarray, words: int) -> np.ndarray:
    """The ``64 * words`` bits of a fingerprint, least significant first."""
    counts = np.zeros(64 * words, dtype=np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK]
        for w in range(words):
            one = np.ascontiguousarray(_mixed(part, w), dtype="<u8").view(np.uint8).reshape(-1, 8)
            counts[64 * w : 64 * w + 64] += np.unpackbits(one, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (2 * counts > len(hashes)).astype(np.uint8)


def fingerprints(docs: DataFrame, shingle: int, words: int, id_column: str = "doc_id", text_column: str = "text", distinct: bool = False, short: int = 0) -> DataFrame:
    """``doc_id``, ``fp`` (``words`` longs), of all or of ``distinct`` shingles, and ``few``: the sorted hashes of texts with ``short`` distinct shingles or fewer."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.list_(pa.int64())), ("few", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, few = [], []
            for text in b.column(1).to_pylist():
                hashes = shingle_hashes(text, shingle)
                own = np.unique(hashes.view(np.int64)) if distinct or len(hashes) <= short else hashes
                fps.append(np.packbits(fingerprint_bits(own.view(np.uint64) if distinct else hashes, words), bitorder="little").view("<i8"))
                few.append(own if short and len(own) <= short else None)
            yield batch(schema, [b.column(0), fps, few])

    picked = docs.selectExpr(f"cast(`{id_column}` as long) as doc_id", f"`{text_column}` as text")
    return picked.mapInArrow(run, "doc_id long, fp array<long>, few array<long>")


def buckets(segments: int, width: int) -> Column:
    """The bucket of ``fp`` in each table: the number of the segment, then its ``width`` bits."""
    out = []
    for seg in range(segments):
        word, offset = divmod(seg * width, 64)
        bits = F.shiftrightunsigned(F.get("fp", F.lit(word)), offset)
        if offset + width > 64:
            bits = bits.bitwiseOR(F.shiftleft(F.get("fp", F.lit(word + 1)), 64 - offset))
        out.append(bits.bitwiseAND(F.lit((1 << width) - 1).cast("long")).bitwiseOR(F.lit(seg << width).cast("long")))
    return F.array(*out)


def near(fps: np.ndarray, known: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Spanning links (root, member) of the graph of rows at most ``limit`` bits apart, where rows of one ``known`` group are linked already."""
    left = np.arange(len(fps))
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            one = frontier.pop()
            own = known[left] == known[one]
            close = own | (np.bitwise_count(fps[left] ^ fps[one]).sum(axis=1, dtype=np.int64) <= limit)
            if close.any():
                frontier.extend(left[close])
                yield from zip(repeat(root), left[close & ~own])
                left = left[~close]


def _bits_apart(a: str, b: str, words: int) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(words)])


def _leads(base: DataFrame, classes: DataFrame, limit: int, head: int, head_limit: int, files: int) -> DataFrame:
    """Links (a, b) of each class to the smallest id of a bucket, where they are at most ``limit`` bits apart."""
    leads = base.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("lead"), *[F.min_by(f"word{i}", "id").alias(f"lead{i}") for i in range(head)])
    # Written, so that a bucket of many members can be split where it is joined.
    met = base.join(materialize(leads.filter("n > 1").drop("n").coalesce(files)), "bucket").filter((F.col("id") != F.col("lead")) & (_bits_apart("word", "lead", head) <= head_limit))
    fps = classes.select("id", "fp")
    pairs = met.select("id", "lead").distinct().join(fps, "id").join(fps.toDF("lead", "lead_fp"), "lead")
    apart = F.aggregate(F.zip_with("fp", "lead_fp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return pairs.filter(apart <= limit).select(F.col("id").alias("a"), F.col("lead").alias("b"))


def links(classes: DataFrame, limit: int, segments: int, width: int, radius: int, head: int, head_limit: int) -> DataFrame:
    """Links (a, b) that join what is at most ``limit`` bits apart and meets in a table.

    ``classes`` has ``id`` and ``fp``. With (radius + 1) * segments over
    ``limit`` nothing is missed; with fewer a share that shrinks with the
    number of segments is.

    First the members of each bucket are compared with its smallest id. What
    that joins is one component, and no two of its members are looked at again:
    a probe goes on only if its bucket holds a fingerprint of another component
    whose first ``head`` words are at most ``head_limit`` bits from its own. So
    a dense group costs a comparison for each member and table, and what meets
    by chance costs a comparison and no row.
    """
    if radius not in (0, 1):
        raise ValueError("balls of radius 0 or 1 are enumerated")
    words = [F.col("fp")[i].alias(f"word{i}") for i in range(head)]
    base = classes.select(F.explode(buckets(segments, width)).alias("bucket"), "id", *words)
    # Few files for few rows, however many partitions a shuffle has.
    n = classes.count()
    of_classes, of_entries, of_probes = (tasks(n * each) for each in (1, segments, segments * (2 + width // 2)))
    star = materialize(_leads(base, classes, limit, head, head_limit, of_entries).coalesce(of_entries))
    known = components(star, files=of_entries).withColumnRenamed("node", "id")
    of_lead = [F.col("fp")[i].alias(f"center{i}") for i in range(head)]
    crowds = known.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).join(classes.select(F.col("id").alias("component"), *of_lead).dropDuplicates(["component"]), "component").drop("n")
    crowds = materialize(crowds.coalesce(of_classes))
    named = classes.join(known, "id", "left").select("id", "fp", F.coalesce("component", "id").alias("component"))
    classes = materialize(named.join(crowds, "component", "left").coalesce(of_classes))
    centers = [f"center{i}" for i in range(head)]
    base = classes.select(F.explode(buckets(segments, width)).alias("bucket"), "id", "component", *words, *centers)
    ball = F.explode(F.array(*[F.lit(b).cast("long") for b in (0, *[1 << i for i in range(width if radius else 0)])]))
    probing = lambda rows, *kept: rows.withColumn("bit", ball).filter("(bucket & bit) = 0").select(F.expr("bucket | bit").alias("bucket"), *kept)
    # A crowd stands in a table as one entry a bucket, and probes as one: its lead, and how far the members there are from that at most.
    entry = ["bucket", "component", *[f"word{i}" for i in range(head)]]
    alone, crowded = base.filter("center0 is null"), base.filter("center0 is not null")
    many = crowded.groupBy("bucket", "component", *centers).agg(F.max(_bits_apart("word", "center", head)).alias("around")).toDF(*entry, "around")
    table = alone.select(*entry, F.lit(0).alias("around")).unionByName(many).toDF(*[f"table_{c}" for c in entry], "table_around")
    other = (F.col("bucket") == F.col("table_bucket")) & (F.col("component") != F.col("table_component"))
    apart = _bits_apart("word", "table_word", head)
    of_crowds = probing(many, *entry[1:], "around").groupBy(*entry).agg(F.max("around").alias("around"))
    probes = probing(alone, "id", *entry[1:], F.lit(0).alias("around")).unionByName(of_crowds.withColumn("id", F.lit(None).cast("long")))
    hits = materialize(probes.join(table, other & (apart <= F.col("around") + F.col("table_around") + head_limit), "left_semi").coalesce(of_probes))
    if not crowds.isEmpty():  # now by each member
        met = hits.filter("id is null").select("bucket", "component")
        members = probing(crowded, "id", *entry[1:]).join(met, ["bucket", "component"], "left_semi")
        hits = hits.filter("id is not null").select("bucket", "id", *entry[1:]).unionByName(members)
        hits = materialize(hits.join(base.select(*entry).toDF(*[f"table_{c}" for c in entry]), other & (apart <= head_limit), "left_semi").coalesce(of_probes))
    hits = hits.select("bucket", "id", "component")
    entries = materialize(base.select("bucket", "id", "component").join(hits.select("bucket").distinct(), "bucket", "left_semi").union(hits).distinct().withColumn("one", F.lit(1)).coalesce(of_entries))
    dealt = group_pairs(entries, ["bucket"], "id", "component", "one", BLOCK_ROWS, of_entries).join(classes.select("id", "fp"), "id")
    # Two blocks of bounded size a group.
    jobs = dealt.groupBy("bucket", "block_a", "block_b").agg(F.collect_list(F.struct("id", "component", "fp")).alias("m")).select("m.id", "m.component", "m.fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fps = b.column(0), b.column(2)
            starts = ids.offsets.to_numpy()
            flat, group = (b.column(c).values.to_numpy()[starts[0] : starts[-1]] for c in (0, 1))
            table = fps.flatten().flatten().to_numpy().view(np.uint64).reshape(len(flat), -1) if len(flat) else None
            starts = starts - starts[0]
            sizes = np.diff(starts)
            twos = starts[:-1][sizes == 2]
            out_a, out_b = [], []
            if len(twos):
                close = np.bitwise_count(table[twos] ^ table[twos + 1]).sum(axis=1, dtype=np.int64) <= limit
                out_a.append(flat[twos[close]])
                out_b.append(flat[twos[close] + 1])
            for k in np.flatnonzero(sizes > 2):
                # By id, so that the jobs of one group of copies mostly name the same roots.
                own = starts[k] + np.argsort(flat[starts[k] : starts[k + 1]], kind="stable")
                if found := list(near(table[own], group[own], limit)):
                    found = np.array(found)
                    out_a.append(flat[own][found[:, 0]])
                    out_b.append(flat[own][found[:, 1]])
            a, c = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b))
            yield batch(schema, [a, c])

    return star.unionByName(jobs.mapInArrow(run, "a long, b long"))


def groups(docs: DataFrame, shingle: int = 3, segments: int = 2, width: int = 32, radius: int = 1, limit: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """By 64-bit fingerprints: ``doc_id``, ``fp`` (an array of one long), ``component_id`` (smallest id reachable) for each document."""
    fps = materialize(fingerprints(docs, shingle, 1, id_column, text_column))
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).filter("id is not null"))
    found = components(links(classes, limit, segments, width, radius, 1, limit))
    named = classes.join(found, classes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def bit_share(similarity: float) -> float:
    """Share of bits in which two texts of that Jaccard similarity differ: their hashes' sums are at a cosine of 2 J / (1 + J)."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def tables(rows: int, similarity: float, recall: float) -> tuple[int, int]:
    """Number of segments and their width for ``rows`` fingerprints.

    The width keeps chance meetings to 16 a bucket at any size (16 bits do up
    to a million rows); the number of segments then follows from ``recall``,
    the share of pairs of exactly ``similarity`` that agree up to one bit in
    some segment, which is so the same at every size.
    """
    width = max(16, int(np.ceil(np.log2(max(rows, 1) / 16))))
    same = 1 - EXCESS * bit_share(similarity)
    meet = same**width + width * (1 - same) * same ** (width - 1)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - meet))), width


def jaccard_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.999, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Groups by the Jaccard similarity of shingle sets: ``doc_id``, ``component_id``.

    Fingerprints of the distinct shingles propose, exact similarities decide.
    The distance looked for is the share of bits in which pairs of that
    similarity differ plus four standard deviations. That share is higher and
    uneven for few shingles, so pairs of texts of up to ``SHORT`` shingles are
    found exactly besides: of two sets that similar, the first
    ``n - ceil(similarity * n) + 1`` hashes of each have one in common, in any
    order of the hashes; rare ones go first, so what many texts share is a key
    of few. Within
    the components of the former links, and among those who share such a hash,
    the shingle sets are compared exactly. Texts with equal fingerprints (320
    bits or more) share a class; those without words are one too. ``docs`` is
    also counted, which Parquet answers from its footers.
    """
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    n = picked.count()
    segments, width = tables(n, similarity, recall)
    # Few files for few rows, however many partitions a shuffle has.
    of_rows, of_links, of_sets = tasks(n), tasks(n * segments), tasks(n, SETS_A_TASK)
    words, share = -(-segments * width // 64), EXCESS * bit_share(similarity)
    limit, head_limit = (int(share * bits + sd * (bits * share * (1 - share)) ** 0.5) for bits, sd in ((64 * words, 4), (64 * HEAD, 4)))
    fps = materialize(fingerprints(picked, shingle, words, distinct=True, short=SHORT))
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).filter("id is not null").coalesce(of_rows))
    loose = components(links(classes, limit, segments, width, 1, HEAD, head_limit), files=of_links).withColumnRenamed("node", "doc_id")
    own = classes.select(F.col("id").alias("doc_id"), "fp")
    short = _short_keys(materialize(fps.filter("size(few) > 0").join(own, ["doc_id", "fp"], "left_semi").select(F.col("doc_id").alias("id"), "few").coalesce(of_rows)), similarity)
    exact = components(_compared(_sets(picked.join(loose, "doc_id"), shingle).unionByName(short), similarity, of_sets), files=of_sets)
    named = classes.join(exact, classes["id"] == exact["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "component_id")


def _short_keys(short: DataFrame, similarity: float) -> DataFrame:
    """``key``, ``id`` and ``shingles`` for each of the first hashes of each text, by how many texts have hashes of their cell, then by hash."""
    cells = short.select(F.explode("few").alias("h")).groupBy(F.pmod("h", F.lit(CELLS)).alias("cell")).count().collect()  # CELLS rows at most
    counts = np.zeros(CELLS, dtype=np.int64)
    for cell, n in cells:
        counts[cell] = n
    shared = short.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("id", pa.int64()), ("first", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            firsts = []
            for few in b.column(1):
                hashes = few.values.to_numpy()
                keep = len(hashes) - int(np.ceil(len(hashes) * similarity - 1e-9)) + 1
                firsts.append(hashes[np.lexsort((hashes, shared.value[hashes % CELLS]))[:keep]])
            yield batch(schema, [b.column(0), firsts, b.column(1)])

    keyed = short.mapInArrow(run, "id long, first array<long>, shingles array<long>")
    return keyed.select(F.explode("first").alias("key"), "id", "shingles")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``key`` (the component), ``id`` and ``shingles``, the sorted hashes of the distinct shingles."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, [b.column(0), b.column(1), [np.unique(shingle_hashes(t, shingle).view(np.int64)) for t in b.column(2).to_pylist()]])

    return docs.select("component", "doc_id", "text").mapInArrow(hashed, "key long, id long, shingles array<long>")


def _compared(sets: DataFrame, similarity: float, files: int) -> DataFrame:
    """Links (a, b) spanning, among the members of each ``key``, what is ``similarity`` or more alike.

    Each member is compared with the smallest id of its key first. Those it
    joins are one group; then only members of different groups are compared.
    What is written on the way is written by ``files`` tasks at most.
    """
    members = materialize(sets.coalesce(files))
    firsts = members.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n > 1").select("key", "id")
    first = members.join(firsts, ["key", "id"]).select("key", F.col("id").alias("first"), F.col("shingles").alias("of_first"))
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def with_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, (key, id_, other) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2)), strict=True)):
                if any(alike([np.asarray(b.column(c)[k].values) for c in (3, 4)], np.array([0, 1]), similarity)):
                    out.append((key, id_, other))
            yield batch(schema, list(zip(*out, strict=True)) if out else [[], [], []])

    star = members.join(first, "key").filter("id <> first").select("key", "id", "first", "shingles", "of_first")
    star = materialize(star.mapInArrow(with_first, "key long, a long, b long").distinct().coalesce(files))
    grouped = members.select("key", "id", F.size("shingles").alias("n")).join(star.select("key", F.col("a").alias("id"), "b"), ["key", "id"], "left")
    grouped = grouped.select("key", "id", "n", F.coalesce("b", "id").alias("known"))
    dealt = group_pairs(grouped, ["key"], "id", "known", "n", BLOCK_SHINGLES, files).drop("n").join(members, ["key", "id"])
    jobs = dealt.groupBy("key", "block_a", "block_b").agg(F.collect_list(F.struct("id", "known", "shingles")).alias("m")).select("m.id", "m.known", "m.shingles")
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                ids, known = (b.column(c)[k].values.to_numpy() for c in (0, 1))
                each = b.column(2)[k].values
                each = np.split(each.flatten().to_numpy(), np.cumsum(each.value_lengths().to_numpy())[:-1])
                out += [(ids[i], ids[j]) for i, j in alike(each, known, similarity)]
            yield batch(pairs, list(zip(*out, strict=True)) if out else [[], []])

    return star.select("a", "b").unionByName(jobs.mapInArrow(run, "a long, b long"))


def alike(sets: list[np.ndarray], known: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Spanning links (root, member) of the graph of sorted sets whose Jaccard similarity is ``similarity`` or more, where sets of one ``known`` group are linked already."""
    left = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            at = frontier.pop()
            one = sets[at]
            own = known[left] == known[at]
            frontier.extend(left[own])
            left = left[~own]
            # Sizes alone rule out most of the others.
            fits = left[(np.minimum(sizes[left], len(one)) >= similarity * np.maximum(sizes[left], len(one))) & (sizes[left] > 0)]
            if not len(fits) or not len(one):
                continue
            every = np.concatenate([sets[i] for i in fits])
            place = np.minimum(np.searchsorted(one, every), len(one) - 1)
            shared = np.add.reduceat(one[place] == every, np.cumsum(sizes[fits]) - sizes[fits], dtype=np.int64)
            found = fits[shared >= similarity * (sizes[fits] + len(one) - shared)]
            if len(found):
                left = left[~np.isin(left, found)]
                frontier.extend(found)
                yield from zip(repeat(root), found)
