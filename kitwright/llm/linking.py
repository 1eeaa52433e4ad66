"""Links within buckets, and the components that links form.

Near-duplicate search puts rows into buckets and looks for links within each.
Buckets may be as large as a third of the table, so none is handled whole: a
bucket is cut into blocks of bounded size and every pair of its blocks is one
task-sized job. What a job emits is linear in its rows, never its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kitwright.llm.common import materialize

#: Links that one task of :func:`components` takes, about.
LINKS_A_TASK = 200_000


def tasks(rows: int, each: int = LINKS_A_TASK) -> int:
    """How many tasks, and so files, so many rows are written by, ``each`` a task; few for small rows."""
    return max(1, -(-rows // each))


def block_pairs(members: DataFrame, keys: list[str], member: str, block_rows: int) -> DataFrame:
    """Deals the members of each bucket to jobs that together hold every two of them.

    ``members`` has the bucket's ``keys`` and a ``member`` id. Returns its rows
    with ``block_a`` and ``block_b`` (the job within the bucket) and ``block``
    (that of the row). A bucket of up to ``block_rows`` members is one job; one
    of n blocks is n (n + 1) / 2 jobs of two blocks each. Buckets with a single
    member hold no pairs and are left out.
    """
    sizes = members.groupBy(*keys).agg(F.count("*").alias("_members")).filter("_members > 1")
    return (
        members.join(sizes, keys)
        .withColumn("_blocks", F.ceil(F.col("_members") / block_rows).cast("int"))
        .withColumn("block", F.expr(f"cast(pmod(xxhash64({member}, 17L), _blocks) as int)"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("block_a", F.least("block", "_other"))
        .withColumn("block_b", F.greatest("block", "_other"))
        .drop("_members", "_blocks", "_other")
    )


def group_pairs(members: DataFrame, keys: list[str], member: str, group: str, weight: str, block_weight: int, files: int | None = None) -> DataFrame:
    """Deals the members of each bucket to jobs that together hold every two of different groups.

    ``members`` has the ``keys``, a ``member`` id, the ``group`` (a long) of
    members that are known to belong together, and a ``weight``. Buckets of one
    group are left out. A group above half of ``block_weight`` has blocks of its
    own, which are never paired with each other, so the members of one large
    group meet the few others of their bucket and are repeated once for each
    block of those. Returns the rows with ``block_a`` and ``block_b``. What is
    known of the buckets is written by ``files`` tasks.
    """
    own = F.when(F.col("_weight") > block_weight / 2, F.ceil(F.col("_weight") / block_weight)).otherwise(0).cast("int")
    sums = members.groupBy(*keys, group).agg(F.sum(weight).alias("_weight")).withColumn("_own", own)
    blocks = (  # of buckets with work
        sums.groupBy(*keys)
        .agg(
            F.count("*").alias("_groups"),
            F.ceil(F.sum(F.when(F.col("_own") == 0, F.col("_weight"))) / block_weight).cast("int").alias("_mixed"),
            F.collect_list(F.when(F.col("_own") > 0, F.struct(F.col(group).alias("g"), F.col("_own").alias("n")))).alias("_large"),  # 2 weights / block_weight at most
        )
        .filter("_groups > 1")
        .drop("_groups")
    )
    blocks = materialize(blocks.coalesce(files) if files else blocks)
    mine = F.get(F.filter("_large", lambda x: x["g"] == F.col(group)), F.lit(0))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    spread = lambda n: F.pmod(F.xxhash64(member, F.lit(17)), n)
    mixed = F.when(F.col("_mixed").isNull(), 0).otherwise(F.greatest("_mixed", F.lit(1)))  # none where all groups are large
    others = F.flatten(F.transform(F.filter("_large", lambda x: x["g"] != F.col(group)), lambda x: F.transform(numbers(x["n"]), lambda k: F.xxhash64(x["g"], k))))
    others = F.concat(others, F.transform(numbers(mixed), lambda k: k.cast("long")))
    return (
        members.join(blocks, keys)
        .withColumn("block", F.when(mine.isNotNull(), F.xxhash64(group, spread(mine["n"]).cast("int"))).otherwise(spread(mixed)))
        .withColumn("_other", F.explode(others))
        .withColumn("block_a", F.least("block", "_other"))
        .withColumn("block_b", F.greatest("block", "_other"))
        .drop("_mixed", "_large", "_other", "block")
    )


def components(links: DataFrame, rounds: int = 40, files: int | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (a, b): the smallest node it can reach.

    Alternates two local rules until nothing changes: every node hands its
    larger neighbours to its smallest neighbour (large star), then its smaller
    neighbours too (small star). Both keep the components and end in stars
    around their smallest nodes, in about log of the longest chain of rounds.
    Rows stay within the number of links; each round's links are checkpointed,
    the first of them by ``files`` tasks at most.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges.coalesce(files) if files else edges)
    many = edges.count()
    if not many:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    files = tasks(many)  # as many as the links need, however many partitions a shuffle has
    for _ in range(rounds):
        edges = edges.coalesce(files)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(files).distinct().coalesce(files)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.u", "e.v").filter("u <> v").coalesce(files).distinct().coalesce(files))
        # Ended when each node has one parent and no parent has one of its own: stars.
        rows, nodes = after.agg(F.count("*"), F.count_distinct("u")).first()
        if rows == nodes and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
