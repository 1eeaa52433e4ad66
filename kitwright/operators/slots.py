"""A slot for each key that is written by some events and read once by others.

A read takes what was written last, unless it has been read already or is older
than a time to live, and empties the slot. So a read finds something exactly if
the event before it, among the key's writes and reads, is a write that is young
enough. The event before each is found within stretches of time (``SLICE``), and
for the first of a stretch it is the last of the stretch before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a stretch of a key's events in one task.
SLICE = 600


def reads(events: DataFrame, writes: Column, reads: Column, seconds: float, key: str = "user_id", ts: str = "ts", number: str = "event_id") -> DataFrame:
    """For each event that ``reads``: ``key``, ``number``, and ``found``, the number of the event whose write it takes, or null.

    Events are taken in order of ``ts``, then ``number``; one with a null time
    or that neither writes nor reads is left out.
    """
    one = F.struct(F.col(ts).alias("ts"), F.col(number).alias("no"), F.coalesce(writes, F.lit(False)).alias("writes"))
    kept = events.filter((writes | reads) & F.col(ts).isNotNull()).select(key, one.alias("e"), F.coalesce(reads, F.lit(False)).alias("_reads"), F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (SLICE * 1_000_000)).alias("_slice"))
    within = W.partitionBy(key, "_slice").orderBy("e.ts", "e.no")
    last = kept.groupBy(key, "_slice").agg(F.max("e").alias("_last"))  # map-side first
    carried = last.select(key, "_slice", F.lag("_last").over(W.partitionBy(key).orderBy("_slice")).alias("_carried"))
    each = kept.withColumn("_before", F.lag("e").over(within)).join(carried, [key, "_slice"])
    before = F.coalesce("_before", "_carried")
    young = F.unix_micros(F.col("e.ts").cast("timestamp")) - F.unix_micros(before["ts"].cast("timestamp")) <= int(seconds * 1_000_000)
    return each.filter("_reads").select(key, F.col("e.no").alias(number), F.when(before["writes"] & young, before["no"]).alias("found"))
