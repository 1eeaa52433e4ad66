"""Starter selections: toggles, totals, drafts and saved builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitwright.sources import manifest


def part_rows(toggles: DataFrame, parts: DataFrame, user: str = "user_id") -> DataFrame:
    """Every part for each user with ``is_selected`` after all toggles: ``user``, ``part_id``, ``price``, ``no``.

    A part is selected if it was toggled an odd number of times and isn't
    essential, or an even number of times and is. A user's toggles are one long,
    the exclusive or of a bit a part, so they are summed map-side and shuffled
    once. ``no`` counts the parts from 0; more than 63 are an error. Toggles of
    unknown parts count for the user only.
    """
    numbers = parts.select(F.col("id").alias("part_id"), "no")
    bit = F.when(F.col("no") < 63, F.expr("shiftleft(1L, no)")).when(F.col("no") >= 63, F.raise_error(F.lit("more than 63 parts")).cast("long"))
    odd = toggles.join(numbers, "part_id", "left").groupBy(user).agg(F.coalesce(F.bit_xor(bit), F.lit(0)).alias("_odd"))
    each = odd.crossJoin(parts.select(F.col("id").alias("part_id"), "price", "essential", "no"))  # a user's few parts
    return each.select(user, "part_id", "price", "no", (F.expr("shiftright(_odd, no) & 1 = 1") != F.col("essential")).alias("is_selected"))


def toggled(toggles: DataFrame, parts: DataFrame, user: str = "user_id") -> DataFrame:
    """The parts selected for each user after all toggles: ``user``, ``part_id``, ``price``, ``no``."""
    return part_rows(toggles, parts, user).filter("is_selected").drop("is_selected")


def toggled_totals(toggles: DataFrame, parts: DataFrame, user: str = "user_id") -> DataFrame:
    """``n_parts`` and ``total`` for each user with toggles; shuffled once."""
    chosen = F.col("is_selected")
    return part_rows(toggles, parts, user).groupBy(user).agg(F.count_if(chosen).alias("n_parts"), F.coalesce(F.sum(F.when(chosen, F.col("price"))), F.lit(0)).alias("total"))


def totals(selected: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """``n_parts`` and ``total`` for each user; an empty selection is 0."""
    sums = selected.groupBy(user).agg(F.count("*").alias("n_parts"), F.sum("price").alias("total"))
    return users.join(sums, user, "left").fillna(0, ["n_parts", "total"])


def restored(drafts: DataFrame, known: list[str], default: list[str], raw: str = "raw") -> DataFrame:
    """``drafts`` with ``part_ids``: of a stored draft's list the strings that are known ids, each once.

    A text that is no JSON object with such a list gives ``default``.
    """
    v = F.try_parse_json(F.col(raw))
    listed = F.try_variant_get(v, "$.partIds", "array<variant>")
    texts = F.filter(F.transform(listed, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda s: s.isin(known))
    return drafts.withColumn("part_ids", F.coalesce(F.array_distinct(texts), F.array(*map(F.lit, default))))


def save(builds: DataFrame, root: str, commit: str) -> None:
    """Appends saved builds (``user_id``, ``part_ids``, ``estimated_total``) with an id and a time, and drops the drafts of their users.

    Both are one commit to the store at ``root`` (tables ``builds`` and
    ``drafts``), made once however often it is repeated under its name.
    """
    rows = builds.withColumn("id", F.expr("uuid()")).withColumn("saved_at", F.current_timestamp())

    def change(now: dict[str, DataFrame]) -> dict[str, manifest.Append | manifest.Replace]:
        left = {"drafts": manifest.Replace(now["drafts"].join(builds.select("user_id"), "user_id", "left_anti"))} if "drafts" in now else {}
        return {"builds": manifest.Append(rows)} | left

    manifest.commit(builds.sparkSession, root, commit, change)


def save_draft(drafts: DataFrame, root: str, commit: str, status: Column) -> None:
    """Overwrites the drafts of those who are signed out; all other stored drafts stay as they are."""
    text = F.to_json(F.struct(F.col("part_ids").alias("partIds"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("savedAt")))
    rows = drafts.filter(status == "signedOut").select("user_id", text.alias("raw"))
    manifest.commit(rows.sparkSession, root, commit, lambda now: {"drafts": manifest.Replace(manifest.by_key(now.get("drafts"), rows, "user_id"))})


def saved_builds(raw: Column) -> Column:
    """A stored list of saved builds; nothing stored, or JSON that is no list, is the empty list. Broken JSON is null: it cannot be added to."""
    kind = "array<struct<id:string,savedAt:string,partIds:array<string>,estimatedTotal:int>>"
    text = F.coalesce(F.nullif(raw, F.lit("")), F.lit("[]"))
    parsed = F.try_parse_json(text)
    is_list = F.try_variant_get(parsed, "$", "array<variant>").isNotNull()
    return F.when(is_list, F.from_json(text, kind)).when(parsed.isNotNull(), F.array().cast(kind))


# What is shown where a build could not be saved.
SAVE_ERROR = "This browser could not save your build. Check its storage settings and try again."


def save_error(raw: Column) -> Column:
    """The text of a failed save: the stored list is broken; empty where it isn't."""
    return F.when(saved_builds(raw).isNull(), SAVE_ERROR).otherwise("")
