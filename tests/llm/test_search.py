"""License scans, ranked search and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kitwright.llm import licenses, periodic, queries, ranking

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def distances(pattern, text):
    """Least edits between ``pattern`` and each beginning of ``text``."""
    row = list(range(len(text) + 1))
    for i, c in enumerate(pattern, 1):
        before, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (c != d)))
    return row


def spoiled(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        i = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[i] = rng.choice("abcxyz")
        elif kind == 1:
            del text[i]
        else:
            text.insert(i, rng.choice("abcxyz"))
    return "".join(text)


@pytest.fixture(scope="module")
def licensed():
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["use", "license", "the", "of", "Straße", "free", "MIT", "ordinary", "general", "public", "gnu", "software"]) for _ in range(n))
    rows = [None, "", "MIT-License, mit license MIT License", "Permit license. permit licenses; the MIT licence", "ÄMIT License", "under the\tGNU  General\nPublic License", "mit licenses", "apache license " * 3]
    for one in licenses.NOTICES:
        for edits in (0, 1, one.edits, one.edits + 1, one.edits + 4):
            rows.append(f"{filler(rng.randrange(9))} {spoiled(rng, one.text, edits).capitalize()}. {filler(rng.randrange(9))}")
    rows.append(f"{filler(200)} {spoiled(rng, licenses.NOTICES[1].text, 3)} {filler(200)}")
    return list(enumerate(rows))


def test_notices_brute_force(spark, licensed):
    """A label is found exactly if some stretch of whole words is within the budget; spans hold what they say."""
    docs = spark.createDataFrame(licensed, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1))
    scanned = {r.doc_id: r for r in licenses.scan(docs).collect()}
    reported = {r.doc_id: r for r in licenses.report(docs).collect()}
    caught = 0
    for doc_id, text in licensed:
        own = words(text)
        labels = {"".join(found.label) for found in scanned[doc_id].found}
        want = set()
        joined = " ".join(own)
        starts = [m.start() for m in re.finditer(r"(?<![^ ])[^ ]", joined)]
        ends = {m.end() for m in re.finditer(r"[^ ](?![^ ])", joined)}
        for one in licenses.NOTICES:
            for a in starts:
                part = joined[a : a + len(one.text) + one.edits]
                if any(d <= one.edits and a + e in ends for e, d in enumerate(distances(one.text, part)) if e):
                    want.add(one.label)
                    break
        assert labels == want, text
        phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
        places = sorted((k, label) for phrase, label in phrases.items() for k in range(len(own)) if own[k : k + len(phrase.split())] == phrase.split())
        r = reported[doc_id]
        assert (r.n_words, r.n_base, r.kept) == (len(own), len(places), 1)
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and r.labels == ",".join(sorted(want))
        assert (r.score > 0) == bool(want) and r.score <= 1 and (not places or r.score == 1)
        for f in scanned[doc_id].found:
            span = " ".join(words(text[f.span_start : f.span_end]))
            assert span == " ".join(own[f.first_word : f.last_word + 1])
            notice = (*licenses.BASE, *licenses.NOTICES)[f.notice]
            assert distances(notice.text, span)[-1] <= f.edits <= notice.edits
            caught += f.edits > 0
    assert caught > 30


def test_a_text_of_one_seed(spark):
    rows = [(1, "general public licen " * 3000 + "general public license"), (2, "under the terms of the gnu " * 3000)]
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].labels, got[2].labels) == (1, "gpl", "")
    assert licenses.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plainly_ranked(docs, items, k):
    terms = {i: [w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")] for i, t in docs}
    terms = {i: ["".join(c.lower() if c.isascii() else c for c in w) for w in t] for i, t in terms.items()}
    told = {i: t for i, t in terms.items() if t}
    n_docs, length = len(told), sum(map(len, told.values()))
    holding = {}
    for t in told.values():
        for w in set(t):
            holding[w] = holding.get(w, 0) + 1
    out = []
    for item, text in items:
        asked = words(text)
        scores = []
        for i, t in told.items():
            m = 25 + (75 * len(t) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[w] + 1))) * ((1000000000 * t.count(w)) // (1000 * t.count(w) + 8 * m)) for w in asked if w in t)
            if score > 0:
                scores.append((-score, i))
        out += [(item, rank, i, -score) for rank, (score, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def ranked():
    rng = random.Random(8)
    word = lambda: f"W{min(int(rng.paretovariate(0.7)), 300)}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(600)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, " .. "), (2003, "Ünïcode w1")]
    items = [(i, ", ".join(word() for _ in range(rng.randrange(1, 25)))) for i in range(37)] + [(50, docs[7][1]), (51, None), (52, ""), (53, "nowhere"), (54, "ünïcode ÜNÏCODE Ünïcode")]
    return docs, items


def test_ranking_brute_force(spark, ranked, monkeypatch):
    docs, items = ranked
    monkeypatch.setattr(ranking, "FIRST", 4)
    monkeypatch.setattr(ranking, "BLOCK_COUNTS", 500)
    want = plainly_ranked(docs, items, 10)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    assert sorted(map(tuple, ranking.search(table, asked).collect())) == want
    monkeypatch.setattr(ranking, "PART_BYTES", 500)  # the items in parts
    assert sorted(map(tuple, ranking.search(table, asked).collect())) == want
    assert {r[0] for r in want} >= {50, 54} and len([r for r in want if r[0] == 50]) == 10


def test_node_bounds_prune(ranked):
    """Whole batches are left out, and what is left is exact."""
    docs, items = ranked
    number = {}
    count = lambda text: {number.setdefault(w, len(number)): words(text).count(w) for w in words(text)}
    bags, bodies = [count(t) for _, t in items if words(t)], [count(t) for _, t in docs if words(t)]
    weight = np.arange(len(number)) % 17 + 1
    level = ranking.Level(np.append(0, np.cumsum([len(b) for b in bodies])), np.array([t for b in bodies for t in sorted(b)]), np.array([b[t] for b in bodies for t in sorted(b)]))
    tree = ranking.Items(bags, weight)
    for one in tree.levels:
        assert all(np.all(np.diff(one.term[a:b]) > 0) for a, b in zip(one.at, one.at[1:], strict=False))
    exact = [[sum(n * body.get(t, 0) for t, n in bags[i].items()) for body in bodies] for i in tree.order]
    floor = np.array([sorted(e)[-10] for e in exact])
    best = ranking.Best(tree, len(number), floor, 10)
    looked = []
    take = best._take
    best._take = lambda item, scores, ids: (looked.append(len(ids)), take(item, scores, ids))
    best.add(np.arange(len(bodies)), level)
    for place, e in enumerate(exact):
        want = sorted(((-s, i) for i, s in enumerate(e) if s > 0))[:10]
        assert [(-int(s), int(i)) for s, i in zip(best.scores[place], best.ids[place], strict=True)] == want
    assert sum(looked) < 0.2 * len(bags) * len(bodies)


def test_ranking_odd_rows(spark):
    items = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "item_id long, text string")
    docs = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (9, "c")], "doc_id long, text string")
    got = sorted(((r.item_id is None, r.rank, r.doc_id) for r in ranking.search(docs, items).collect()), key=repr)
    assert got == sorted([(False, 1, 5), (False, 2, 5), (False, 3, None)] * 2 + [(True, 1, 5), (True, 2, 5), (True, 3, None)], key=repr)
    assert ranking.search(docs, items.limit(0)).collect() == ranking.search(docs.limit(0), items).collect() == []


def test_ranking_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{d}/{name}.parquet')")
    want = con.execute(queries.oracle_sql()["op12_dual_tree_search"])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, queries.op12_dual_tree_search(spark, d).select(columns).collect())) == sorted(want.fetchall())


def plain_lyndon(s):
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def plain_runs(s, repeats, least):
    found = set()
    for q in range(1, len(s) // repeats + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            size, w = j + q - i, s[i : j + q]
            if j > i and size >= max(least, repeats * q) and not any(w[r:] == w[:-r] for r in range(1, q)):
                found.add((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng, n):
    s = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), 1 + rng.randrange(6)
        s = [s[i] if i < a else s[min(n - 1, a + (i - a) % p)] for i in range(n)]
    return s


def test_lyndon_arrays():
    rng = random.Random(4)
    for _ in range(600):
        s = periodic_words(rng, rng.randrange(1, 24))
        assert periodic.lyndon_lengths(s) == plain_lyndon(s)


@pytest.mark.parametrize(("repeats", "least"), [(4, 6), (2, 2), (3, 5)])
def test_runs_brute_force(repeats, least):
    """Several texts read together have the runs of each."""
    rng = random.Random(repeats)
    for _ in range(500):
        split = [periodic_words(rng, rng.randrange(0, 40)) for _ in range(3)]
        ends = np.cumsum([len(s) for s in split])
        ranks = np.array([w + 100 * k for k, s in enumerate(split) for w in s], dtype=np.int64)
        want = [(a + int(end) - len(s), size, q) for s, end in zip(split, ends, strict=True) for a, size, q in plain_runs(s, repeats, least)]
        assert list(map(tuple, periodic.runs(ranks, ends, repeats, least).tolist())) == want


def test_periodic_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{x}" for x in periodic_words(rng, rng.randrange(0, 90)))) for i in range(160)]
    rows += [(200, None), (201, " \n"), (None, "a " * 20), (202, "x" * 50), (203, " ".join(f"w{x}" for x in range(30_000))), (204, "la\tla " * 9_000), (5, rows[5][1])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if doc_id == 203:
            runs = [r for r in [(a, n - a, p)] if r[1] >= max(6, 4 * p)] if h % 10 == 0 else []
        elif doc_id == 204:
            runs = [(0, 18_000, 1)]
        else:
            runs = plain_runs(w, 4, 6)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        longest = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(runs), *((*longest, 1000 * longest[1] // longest[2]) if longest else [None] * 4), sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert got == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in want) > 30


def test_periodic_texts_without_words(spark, tmp_path):
    """Also where the id asks for a repeated stretch."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = list(zip(ids, ["", " \n", None, "a"], strict=False))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_runs, r.start, r.collapsed_sha256) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(rows) == 4 and got == {i: (0, None, hashlib.sha256((t or "").strip().encode()).hexdigest()) for i, t in rows}


def test_periodic_empty_table(spark):
    found = periodic.find(spark.createDataFrame([], "doc_id long, text string, n_words string"))
    assert found.collect() == [] and periodic.summary(found).columns == ["doc_id", "n_words", "runs", "text", "n_runs", "start", "length", "period", "exponent_milli"]
    assert pa.types.is_string(pa.array([""]).type)
