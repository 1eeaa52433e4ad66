"""From raw documents to token ids: five stages over everything the one before kept.

toxicity      documents that the classifier rejects go
line_dedup    recurring line templates go from the texts; a text left blank by it goes
near_dedup    one document (the smallest id) of each near-duplicate group stays
decontaminate documents that hold a benchmark item go
encode        every text becomes byte-level BPE ids, and is decoded again

Nulls: a document with a null or empty text passes the filters like any other
(all such are one near-duplicate group) and encodes to no tokens. Texts of any
length are taken whole. Of the equal or tied documents of a group the smallest
id stays; rows that repeat an id stay or go together; rows with a null id pass
near-dup and decontamination as they are. An empty table passes as an empty
table. Extra columns are kept, as they are, up to the last stage; ``n_chars``
follows the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kitwright.llm import bpe, decontam, lines, simhash, toxicity
from kitwright.llm.common import documents, id_bucket, materialize, shared_folder
from kitwright.llm.linking import tasks

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents below 0.5 stay. Learns from labelled ids outside the held-out fold, as the query does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels, id_bucket(F.col("doc_id"), 5) != 0))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: ``n_chars``, where it stands, follows the text."""
    # Longer than any column of ``docs``, so that none of the same name is overwritten.
    free = "_".join(["", *docs.columns])
    kept = lines.drop_templates(docs, counts=(f"lines{free}", f"dropped{free}"))
    dropped = F.col(f"dropped{free}")
    kept = kept.filter((dropped == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(dropped > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: five-word shingles, similarity 0.8 or more. Rows with a null id stay."""
    found = simhash.jaccard_groups(docs, shingle=5, similarity=0.8)
    copies = materialize(found.filter("doc_id <> component_id").select("doc_id").coalesce(tasks(docs.count())))
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(materialize(found.select("doc_id").distinct()), "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: ``doc_id``, ``n_tokens`` and the digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: Neither a trained classifier nor BPE is expressible in SQL; toxicity is tested by its risk and held-out accuracy, the other stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
