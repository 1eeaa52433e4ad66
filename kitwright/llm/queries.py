"""The training-data queries: each operator with its production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kitwright.llm import bpe, decontam, embedding, langid, licenses, lines, periodic, ranking, secrets, sharding, simhash, substring, toxicity
from kitwright.llm.common import documents, id_bucket, materialize

SHARDS, SHARD_SEED = 40, "kitwright"


def op1_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = documents(spark, sf_dir).select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.interleave(sized, SHARDS, SHARD_SEED).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_templates(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(documents(spark, sf_dir), shingle=3, segments=2, width=32, radius=1, limit=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, id_bucket(F.col("doc_id"), 5) != 0)
    return toxicity.scored(docs, model).select(
        "doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_benchmark_qgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in two commits: the second scan leaves out the blobs that the first commit's ledger lists."""
    versions = documents(spark, sf_dir).select("doc_id", "text")
    later = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2)) == 1
    findings, ledger = map(materialize, secrets.update(versions.filter(~later)))
    findings, _ = secrets.update(versions.filter(later), ledger=ledger, findings=findings)
    found = secrets.at_paths(versions, findings)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def op10_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = langid.train(docs, id_bucket(F.col("doc_id"), 4) != 2)
    return langid.predict(docs, net).select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.report(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) where one text in ten, by its id, repeats a stretch of its words up to its end."""
    n, h = F.size("_words").cast("long"), F.crc32(F.col("doc_id").cast("string"))
    rows = docs.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    rows = rows.withColumn("_n", n).withColumn("_g", F.floor(F.col("_h") / 10)).withColumn("_a", F.expr("cast(_g % nullif(_n, 0) as int)"))
    rows = rows.withColumn("_p", F.expr("cast(1 + floor((_n - _a) / (3 + _g % 8)) as int)"))
    repeated = F.expr("array_join(transform(_words, (w, i) -> if(i >= _a, get(_words, _a + (i - _a) % _p), w)), ' ')")
    return rows.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.summary(periodic.find(with_repeats(documents(spark, sf_dir).select("doc_id", "text"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256")
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_stratified_shards, op2_line_templates, op3_cross_polytope, op4_simhash, op5_recompression,
        op6_toxicity_nnpu, op7_byte_bpe, op8_benchmark_qgrams, op9_secret_ledger, op10_language_gru,
        op11_license_notices, op12_dual_tree_search, op13_periodic_runs, pipeline,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_stratified_shards": sharding.oracle(SHARDS, SHARD_SEED), "op12_dual_tree_search": ranking.oracle(10)}
