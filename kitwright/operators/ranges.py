"""Joins of numbers with ranges that hold them, both sides large, as joins on equal keys.

A range of whole numbers is cut into the fewest blocks of the form
[k 2^l, (k + 1) 2^l), two a level at most, and a number lies in one block of each
level. So number and range meet in exactly one block if the range holds the
number, and nowhere else: what is joined are the pairs of the result, and no
pair is made to be thrown away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks_of_number(x: Column, bits: int) -> Column:
    """Of each level the block that holds ``x`` (0 to 2^bits - 1)."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", x.cast("long"), level).alias("block")))


def blocks_of_range(low: Column, high: Column, bits: int) -> Column:
    """The blocks whose union is ``low`` to ``high``, both inclusive, within 0 to 2^bits - 1; none if it is empty or an end is null."""
    first, end = F.greatest(low, F.lit(0)).cast("long"), F.least(high, F.lit(2**bits - 1)).cast("long") + 1

    def of_level(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        a, b = F.call_function("shiftright", first + size - 1, level), F.call_function("shiftright", end, level)
        odd = lambda n: n % 2 == 1
        left, right = F.when((a < b) & odd(a), a), F.when((a < b) & odd(b), b - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda block: F.struct(level.alias("level"), block.alias("block")))

    listed = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), of_level))
    return F.when(low.isNotNull() & high.isNotNull() & (low <= high), listed)


def range_join(numbers: DataFrame, ranges: DataFrame, number: Column, low: Column, high: Column, bits: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose ``number`` (of ``numbers``) is from ``low`` to ``high`` (of ``ranges``) and whose columns ``on`` are equal.

    The values are whole numbers from 0 to 2^bits - 1; a number outside is an
    error, a range is cut to it, and null on either side is in no pair. The
    columns of both sides must have names of their own, but for ``on``.
    """
    keys = [*(on or []), "_level", "_block"]
    outside = (number < 0) | (number >= 2**bits)
    checked = F.when(outside, F.raise_error(F.lit(f"numbers are from 0 to {2**bits - 1}")).cast("long")).otherwise(number)
    left = numbers.filter(number.isNotNull()).withColumn("_k", F.explode(blocks_of_number(checked, bits)))
    right = ranges.withColumn("_k", F.explode(blocks_of_range(low, high, bits)))
    deal = lambda df: df.withColumn("_level", F.col("_k.level")).withColumn("_block", F.col("_k.block")).drop("_k")
    return deal(left).join(deal(right), keys).drop("_level", "_block")
