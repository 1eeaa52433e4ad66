"""Recommendations: the priority preset, the questionnaire's decision table and its steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kitwright.functions.scalars import col, dollars, trimmed
from kitwright.sources.catalog import SLOTS, literal

# The three kits (frame, motors, controller, ESC, propellers, battery), and names with and without footage.
KITS = {
    "compact": (["frame3", "motors3", "fcF4", "esc20", "props3", "battery4"], "Protected Video Build", "First Flight Build"),
    "long": (["frame7", "motors7", "fcF7", "esc55", "props7", "battery6long"], "Explorer Video Build", "Long-Range Explorer Build"),
    "default": (["frame5", "motors5", "fcF7", "esc55", "props5", "battery6"], "Cinematic Freestyle Build", "Freestyle FPV Build"),
}

# The decision table. Style (null: none chosen), lowest and highest budget, name, four parts, and the
# reason before and after the budget.
SUGGESTIONS = [
    ("FPV", None, None, "Immersive FPV Build", ["5-inch freestyle frame with soft-mounted motors", "Punchy 2207 motors for quick, snappy moves", "Digital FPV camera — crystal clear through goggles", "6S 1300 mAh battery for nimble, agile flying"], "FPV is all about feeling every move, so this build favors quick response over long flight times. Your ", " budget covers it comfortably."),
    ("Cinematic", None, None, "Backpack Cinematic Build", ["220mm folding frame — small enough for a backpack", "Efficient 2306 motors — long flight times, low noise", "4K camera with a 3-axis gimbal for steady footage", "6S 3000 mAh battery — around 25 minutes of flying"], "Cinematic flying lives on smooth footage, so the gimbal and big battery do the heavy lifting. Your ", " budget covers everything here with room to spare."),
    ("Racing", None, None, "Track Rocket Build", ["5-inch stiff racing frame — zero flex at speed", "High-KV 2207 motors for explosive acceleration", "Lightweight analog FPV camera — lowest possible lag", "Small 6S 850 mAh battery to keep weight down"], "Racing drones shed every gram they can, so this build is deliberately minimal. Your ", " budget leaves room for spare props — you will need them."),
    ("Long Range", None, None, "Long-Range Explorer Build", ["7-inch long frame with large, efficient props", "Low-KV motors tuned for calm, quiet efficiency", "GPS + return-to-home for hands-off safety", "High-capacity 6S 4000 mAh battery — very long flights"], "Long range is about efficiency and safety, so big slow propellers and GPS keep you flying far and coming home. Your ", " budget fits this build well."),
    (None, None, 699, "First Racer Build", ["Tiny 95mm whoop frame — survives crashes", "Gentle 1103 motors — smooth and forgiving to fly", "Ducted prop guards — safe around people and furniture", "Basic analog FPV camera — simple and cheap to replace"], "Your ", " budget fits this comfortably. Small, protected props and mild power mean your first crashes cost almost nothing."),
    (None, 700, 1500, "Backpack Cinematic Build", ["220mm folding frame — small enough for a backpack", "Efficient 2306 motors — long flight times, low noise", "4K camera with a 3-axis gimbal for steady footage", "6S 3000 mAh battery — around 25 minutes of flying"], "Your ", " budget covers everything here with room to spare. Foldable parts keep it portable, while the gimbal and big battery do the heavy lifting for video quality."),
    (None, 1501, None, "Silent Shutter Pro Build", ["7-inch long frame with large, slow-spinning props", "Low-KV motors tuned for quiet efficiency", "Micro 4/3 camera with fast low-light lens", "GPS + return-to-home for calm, hands-off hovering"], "Your ", " budget unlocks premium parts. Big slow propellers are dramatically quieter than small fast ones — perfect for sunrise shoots."),
]


def kit(priorities: Column | str) -> Column:
    """``compact``, ``long`` or ``default``: parkour outweighs range, range outweighs beginner."""
    wants = lambda p: F.coalesce(F.array_contains(col(priorities), p), F.lit(False))
    return F.when(wants("beginner") & ~wants("range") & ~wants("parkour"), "compact").when(wants("range") & ~wants("parkour"), "long").otherwise("default")


def priority_preset(asked: DataFrame, priorities: str = "priorities", budget: str = "budget") -> DataFrame:
    """``asked`` with ``kit``, ``preset_name`` and ``selection`` (a map from slot to product id)."""
    footage = F.coalesce(F.array_contains(F.col(priorities), "footage"), F.lit(False))
    camera = F.when(footage & (F.col(budget) >= 700), "camera4k").otherwise("cameraFpv")
    receiver = F.when(F.col(budget) < 500, "receiver2").otherwise("receiver")

    def by_kit(value) -> Column:
        return F.when(F.col("kit") == "compact", value("compact")).when(F.col("kit") == "long", value("long")).otherwise(value("default"))

    picks = by_kit(lambda k: F.array(*map(F.lit, KITS[k][0])))
    return (
        asked.withColumn("kit", kit(priorities))
        .withColumn("preset_name", by_kit(lambda k: F.when(footage, KITS[k][1]).otherwise(KITS[k][2])))
        .withColumn("selection", F.map_from_arrays(F.array(*map(F.lit, SLOTS)), F.concat(picks, F.array(camera, receiver))))
    )


def suggestion_table(spark: SparkSession) -> DataFrame:
    return literal(spark, SUGGESTIONS, "style string, lo int, hi int, suggestion string, parts array<string>, before string, after string")


def suggest(answers: DataFrame, table: DataFrame) -> DataFrame:
    """``answers`` (``budget``, ``color``, ``style``) with ``suggestion``, ``parts`` and ``why``.

    A chosen style decides; without one (null or unknown) the budget's band does. The
    table is the decision table's seven rows, broadcast.
    """
    styles = [s[0] for s in SUGGESTIONS if s[0]]
    known = F.when(F.col("style").isin(styles), F.col("style"))
    t = table.withColumnsRenamed({"style": "_style"})
    band = F.col("budget").between(F.coalesce("lo", F.lit(-(2**31))), F.coalesce("hi", F.lit(2**31 - 1)))
    shell = F.coalesce(F.concat(F.lit("Custom shell in "), F.nullif(F.col("color"), F.lit(""))), F.lit("Classic factory shell"))
    return answers.join(t, known.eqNullSafe(F.col("_style")) & (known.isNotNull() | band), "left").select(
        *answers.columns, "suggestion", F.concat("parts", F.array(shell)).alias("parts"), F.concat("before", dollars("budget"), "after").alias("why")
    )


def wizard_step(step: Column | str, action: Column | str) -> Column:
    """The step (0 to 4) after ``next``, ``skip``, ``back`` or ``finish``; others leave it."""
    s, a = col(step), col(action)
    return F.when(a.isin("next", "skip", "finish"), F.least(F.lit(4), s + 1)).when(a == "back", F.greatest(F.lit(0), s - 1)).otherwise(s)


def shows_result(step: Column | str, action: Column | str) -> Column:
    """Whether a suggestion stands after the last question: skipping it computes none."""
    return (col(step) == 3) & (col(action) == "finish")


def summary(answers: DataFrame) -> DataFrame:
    """The wizard's summary lines, with a text for each answer that is missing."""
    return answers.select(
        *[c for c in answers.columns if c not in ("budget", "color", "style", "wishes")],
        dollars("budget").alias("budget_line"),
        F.coalesce(F.col("color"), F.lit("No preference")).alias("color_line"),
        F.coalesce(F.col("style"), F.lit("No preference")).alias("style_line"),
        F.coalesce(F.nullif(trimmed("wishes"), F.lit("")), F.lit("None")).alias("wishes_line"),
    )
