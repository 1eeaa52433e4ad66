"""Nulls, empty and long texts, repeated rows, clashing extra columns and empty tables: every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kitwright.llm import bpe, decontam, embedding, langid, lines, queries, secrets, sharding, simhash, substring, toxicity

LONG = " ".join(f"w{i % 977}" for i in range(25_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, component string, key string, fp int, node int, a string, blob string, spans string, n_lines int, shard int, h1 int"
EXTRA = (1, "c", "k", 2, 3, "a", "b", "s", 4, 5, 6)
ROWS = [(1, None, None, None, None, *EXTRA), (2, "", "en", "s", 0, *EXTRA), (3, LONG, "en", "s", None, *EXTRA), (4, LONG, "de", "s", None, *EXTRA), (5, "Ein Satz. \n", "de", "", 9, *EXTRA), (5, "Ein Satz. \n", "de", "", 9, *EXTRA), (None, "no id", "en", "t", 5, *EXTRA), (7, " \t\n ", None, "t", 4, *EXTRA)]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two data folders: odd rows, and tables without rows."""
    out = {}
    for kind in ("rows", "empty"):
        d = str(tmp_path_factory.mktemp(kind))
        full = kind == "rows"
        spark.createDataFrame(ROWS if full else [], SCHEMA).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 1), (5, None, 0), (None, 1, 1)] if full else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "x"), (2, LONG[:300])] if full else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(1, None, 1), (None, [1.0], 1), (2, [1.0, 0.0], None), (3, [], 2)] if full else [], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
        out[kind] = d
    return out


@pytest.mark.parametrize("kind", ["rows", "empty"])
@pytest.mark.parametrize("name", sorted(n for n in queries.queries() if n != "pipeline"))
def test_queries(spark, tables, kind, name):
    got = queries.queries()[name](spark, tables[kind]).collect()
    if kind == "empty":
        assert got == []
    elif name == "op3_cross_polytope":
        assert len(got) == 4
    elif name == "op12_dual_tree_search":
        assert sorted((r.item_id, r.rank, r.doc_id) for r in got) == [(2, 1, 3), (2, 2, 4)]
    elif name != "op8_benchmark_qgrams":
        assert len({r.doc_id for r in got}) == 7 and len(got) == len(ROWS)


@pytest.mark.parametrize("kind", ["rows", "empty"])
def test_pipeline(spark, tables, kind):
    docs = spark.read.parquet(f"{tables[kind]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tables[kind]).collect(), SCHEMA)
        assert docs.columns == spark.read.parquet(f"{tables[kind]}/documents.parquet").columns
    left = [r.doc_id for r in corpus_pipeline.encode(spark, docs, tables[kind]).collect()]
    assert left.count(4) == 0 and (kind == "empty" or None in left)


def test_results_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert {r.component_id for r in simhash.groups(docs).filter("doc_id in (1, 2, 7)").collect()} == {1}
    assert {r.doc_id: r.component_id for r in simhash.jaccard_groups(docs).collect()}[4] == 3
    cut = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert (cut[3].n_removed, cut[4].n_removed, cut[1].n_words) == (0, 25_000, 0)
    assert {r.doc_id for r in decontam.contaminated(docs, spark.createDataFrame([(9, LONG[1000:1300])], "item_id long, text string")).collect()} == {3, 4}
    kept = lines.drop_templates(docs)
    assert kept.filter("doc_id = 1").first().text is None and "key" in kept.columns
    assert secrets.report(docs).filter("doc_id = 3").first().spans == ""
    assert sharding.interleave(docs, 3).agg(F.max("shard")).first()[0] == 2
    assert toxicity.scored(docs, toxicity.Model({}, -30.0)).agg(F.max("score")).first()[0] < 1e-9
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert embedding.near_vectors(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [2.0, 4.0], 1)], "vec_id long, embedding array<double>, label int")).agg(F.sum("n_links")).first()[0] == 6
    import public_tokenizers as P

    assert bpe.encode(docs.filter("doc_id = 1"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).first().token_ids == []


def test_sharding_equals_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    want = con.execute(queries.oracle_sql()["op1_stratified_shards"])
    columns = [c[0] for c in want.description]
    got = queries.op1_stratified_shards(spark, d).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
