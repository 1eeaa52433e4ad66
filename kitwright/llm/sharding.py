"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order, and the r-th of n gets a
fractional rank between (r - 1) / n and r / n, at a place that its seeded digest
draws. Sorted by that rank, every stretch of the whole table holds the sources
in their overall proportion, the many with a row or two included, so cutting
the order into equal stretches gives shards of the same mixture whose row counts
are at most one apart.

Exact ranks need no global sort. A row's place is (rows in earlier buckets) +
(its place within its bucket), with buckets cut along the sort key itself: the
leading hex digits of the row's seeded digest within a source, and the leading
part of the fractional rank over all sources. A source with a third of all
rows is thus spread over 4,096 buckets like any other, and so are a third of the
rows that are each the only one of their source, as their ranks are drawn.

Defined results: a null or empty source is one stratum; a null id is hashed as
''; equal ids of one source tie and take neighbouring places in either order;
an empty table gives an empty table. Further columns of the input are kept, but
``shard`` and ``slot`` are replaced; names starting with ``_shard_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of a source's order (three hex digits) and of the fractional ranks.
BUCKETS = 4096


def interleave(rows: DataFrame, shards: int, seed: str = "0", id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... within the shard)."""
    out_columns = [c for c in rows.columns if c not in ("shard", "slot")]
    dealt = rows.select(
        *out_columns,
        F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("_shard_source"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))).alias("_shard_digest"),
    ).withColumn("_shard_bucket", F.substring("_shard_digest", 1, 3))

    # Rows of a source in earlier buckets: at most 4,096 counts a source.
    by_source = W.partitionBy("_shard_source")
    before = (
        dealt.groupBy("_shard_source", "_shard_bucket")
        .agg(F.count("*").alias("_shard_count"))
        .select(
            "_shard_source",
            "_shard_bucket",
            (F.sum("_shard_count").over(by_source.orderBy("_shard_bucket")) - F.col("_shard_count")).alias("_shard_before"),
            F.sum("_shard_count").over(by_source).alias("_shard_of"),
        )
    )
    drawn = F.conv(F.substring("_shard_digest", 4, 8), 16, 10).cast("double") / 2**32
    place = F.row_number().over(W.partitionBy("_shard_source", "_shard_bucket").orderBy("_shard_digest", id_column))
    ranked = (
        dealt.withColumn("_shard_place", place)
        .join(before, ["_shard_source", "_shard_bucket"])
        .withColumn("_shard_rank", (F.col("_shard_before") + F.col("_shard_place") - 1 + drawn) / F.col("_shard_of"))
        .withColumn("_shard_part", F.least(F.lit(BUCKETS - 1), F.floor(F.col("_shard_rank") * BUCKETS)))
    )

    # Counted by each task first: BUCKETS rows, whatever the input.
    sizes = ranked.groupBy("_shard_part").agg(F.count("*").alias("_shard_rows"))
    earlier = sizes.select(
        "_shard_part", (F.sum("_shard_rows").over(W.orderBy("_shard_part")) - F.col("_shard_rows")).alias("_shard_earlier"), F.sum("_shard_rows").over(W.partitionBy()).alias("_shard_all")
    )
    within = F.row_number().over(W.partitionBy("_shard_part").orderBy("_shard_rank", "_shard_digest", "_shard_source"))
    return (
        ranked.withColumn("_shard_within", within)
        .join(F.broadcast(earlier), "_shard_part")  # BUCKETS rows, whatever the input
        .withColumn("_shard_at", F.col("_shard_earlier") + F.col("_shard_within") - 1)
        .withColumn("shard", F.expr(f"cast((_shard_at * {shards}) div _shard_all as int)"))
        .withColumn("slot", F.expr(f"_shard_at - (cast(shard as long) * _shard_all + {shards - 1}) div {shards}"))
        .select(*out_columns, "shard", "slot")
    )


def oracle(shards: int, seed: str) -> str:
    """The same rows in SQL over ``documents``."""
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), crcs AS (
  SELECT doc_id AS crc_id, xor(list_reduce(list_prepend(4294967295, list_transform(
      string_split(trim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g')), ' '),
      lambda h: CASE WHEN h = '' THEN NULL ELSE CAST('0x' || h AS BIGINT) END)),
    lambda a, b: CASE WHEN b IS NULL THEN a ELSE xor(a >> 8, t[xor(a, b) % 256 + 1]) END), 4294967295) AS text_crc32
  FROM documents, crc_table
), ranked AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 16 AS size, coalesce(source, '') AS src,
    md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
    row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS r,
    count(*) OVER (PARTITION BY coalesce(source, '')) AS n
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (ORDER BY ((r - 1)::DOUBLE + CAST('0x' || substr(digest, 4, 8) AS BIGINT)::DOUBLE / 4294967296::DOUBLE) / n::DOUBLE, digest, src) - 1 AS g, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST((g * {shards}) // total AS INTEGER) AS shard,
  CAST(g - (((g * {shards}) // total) * total + {shards - 1}) // {shards} AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM placed JOIN crcs ON crc_id = doc_id
"""
