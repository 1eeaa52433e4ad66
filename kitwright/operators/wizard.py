"""Runs through the questionnaire: any number of actions as one step that composes.

Every action moves the step by some and clamps it, and so do any number of
them after one another: ``(add, low, high)`` takes a step s to
min(high, max(low, s + add)). Two such in a row are one again, so a run is cut
into pieces by the numbers of its actions, the pieces are summed side by side,
and the sums joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The last step, where a suggestion stands, and the numbers of actions of a piece.
RESULT, PIECE = 4, 4096
#: ``told``: whether the suggestion was computed (true) or discarded (false) last.
MOVE = "struct<add:long,low:long,high:long,told:boolean>"
#: What each action adds, and the lowest and highest step after it.
ACTIONS = {"next": (1, 0, RESULT), "skip": (1, 0, RESULT), "back": (-1, 0, RESULT), "finish": (0, RESULT, RESULT), "over": (0, 0, 0)}


def move(action: Column) -> Column:
    """An action as a move; others leave the step as it is."""
    found = F.lit(None).cast(MOVE)
    for name, values in ACTIONS.items():
        told = F.lit({"finish": True, "over": False}.get(name))
        found = F.when(action == name, F.struct(*map(F.lit, values), told).cast(MOVE)).otherwise(found)
    return F.coalesce(found, stay())


def stay() -> Column:
    return F.struct(F.lit(0), F.lit(0), F.lit(RESULT), F.lit(None)).cast(MOVE)


def then(a: Column, b: Column) -> Column:
    """Two moves in a row as one."""
    clamp = lambda x: F.least(b["high"], F.greatest(b["low"], x + b["add"]))
    return F.struct(a["add"] + b["add"], clamp(a["low"]), clamp(a["high"]), F.coalesce(b["told"], a["told"])).cast(MOVE)


def runs(actions: DataFrame, run: str, turn: str, action: str = "action") -> DataFrame:
    """For each ``run`` the step after its actions in order of ``turn`` (whole numbers, no two alike in a run): ``n_actions``, ``last_step``, ``shows_result``.

    A run begins at step 0 without a suggestion. ``finish`` computes one and
    ``over`` discards it; one that was skipped isn't shown.
    """
    listed = lambda of: F.array_sort(F.collect_list(of))  # noqa: E731  of PIECE actions, and of the pieces
    total = lambda moves: F.aggregate(moves, stay(), lambda a, x: then(a, x["m"]))
    one = F.struct(F.col(turn).alias("t"), move(F.col(action)).alias("m"))
    pieces = actions.groupBy(run, F.floor(F.col(turn) / PIECE).alias("_piece")).agg(listed(one).alias("_moves"), F.count("*").alias("_n"))
    summed = pieces.select(run, F.struct(F.col("_piece").alias("t"), total("_moves").alias("m")).alias("_sum"), "_n")
    whole = summed.groupBy(run).agg(listed("_sum").alias("_sums"), F.sum("_n").alias("n_actions")).withColumn("_m", total("_sums"))
    m = F.col("_m")
    step = F.least(m["high"], F.greatest(m["low"], m["add"]))
    return whole.select(run, "n_actions", step.cast("int").alias("last_step"), ((step == RESULT) & F.coalesce(m["told"], F.lit(False))).alias("shows_result"))
