"""Queries on questionnaires, starter selections and the listing pages.

An order is a questionnaire: budget 300 + 50 * (o_orderkey % 55), style and
color by the customer key. A line of an order toggles part ``l_partkey % 8``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kitwright.functions import scalars as S
from kitwright.operators import recommend, selection
from kitwright.plans.registry import query
from kitwright.sources import catalog
from kitwright.sources.catalog import COLORS, PARTS, PARTS_SQL, READY_MADE_SQL, STYLES, TEMPLATES_SQL, values_sql
from kitwright.sources.tables import table

PRIORITIES = ["footage", "parkour", "range", "beginner"]


def _nth(values: list[str], index: F.Column) -> F.Column:
    return F.try_element_at(F.array(*map(F.lit, values)), index + 1)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last style and color index stand for no choice."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (300 + 50 * F.pmod("o_orderkey", F.lit(55))).cast("int").alias("budget"),
        _nth(COLORS, F.pmod("o_custkey", F.lit(7)).cast("int")).alias("color"),
        _nth(STYLES, F.pmod("o_custkey", F.lit(5)).cast("int")).alias("style"),
        F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.concat(F.lit(" \t"), "o_orderpriority", F.lit(" "))).when(F.pmod("o_orderkey", F.lit(3)) == 1, " \t ").alias("wishes"),
    )


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ANSWERS_SQL = f"""answers AS (SELECT o_orderkey, (300 + 50 * (o_orderkey % 55))::INT AS budget, {_list_sql(COLORS)}[(o_custkey % 7 + 1)::INT] AS color, {_list_sql(STYLES)}[(o_custkey % 5 + 1)::INT] AS style,
  CASE o_orderkey % 3 WHEN 0 THEN ' ' || chr(9) || o_orderpriority || ' ' WHEN 1 THEN ' ' || chr(9) || ' ' END AS wishes FROM orders)"""
TABLE_SQL = values_sql("decisions", "style, lo, hi, suggestion, p1, p2, p3, p4, before, after", [(s, lo, hi, n, *p, b, a) for s, lo, hi, n, p, b, a in recommend.SUGGESTIONS])


@query(
    "suggestions",
    f"""WITH {ANSWERS_SQL}, {TABLE_SQL} SELECT o_orderkey, d.suggestion,
  concat_ws(' + ', p1, p2, p3, p4, CASE WHEN color IS NULL THEN 'Classic factory shell' ELSE 'Custom shell in ' || color END) AS parts, before || '$' || format('{{:,}}', budget) || after AS why
FROM answers a JOIN decisions d ON CASE WHEN a.style IS NOT NULL THEN d.style = a.style ELSE d.style IS NULL AND a.budget >= coalesce(lo, 0) AND a.budget <= coalesce(hi, 999999) END""",
)
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recommend.suggest(answers(spark, sf_dir), recommend.suggestion_table(spark))
    return found.select("o_orderkey", "suggestion", F.concat_ws(" + ", "parts").alias("parts"), "why")


@query("suggestion_counts", f"WITH {ANSWERS_SQL}, {TABLE_SQL} SELECT d.suggestion, count(*) AS n_answers, min(budget) AS lowest FROM answers a JOIN decisions d ON a.style = d.style OR (a.style IS NULL AND d.style IS NULL AND a.budget BETWEEN coalesce(lo, 0) AND coalesce(hi, 999999)) GROUP BY 1")
def suggestion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recommend.suggest(answers(spark, sf_dir), recommend.suggestion_table(spark))
    return found.groupBy("suggestion").agg(F.count("*").alias("n_answers"), F.min("budget").alias("lowest"))


@query("wizard_summary", f"WITH {ANSWERS_SQL} SELECT o_orderkey, '$' || format('{{:,}}', budget) AS budget_line, coalesce(color, 'No preference') AS color_line, coalesce(style, 'No preference') AS style_line, coalesce(nullif(trim(wishes, ' ' || chr(9)), ''), 'None') AS wishes_line FROM answers")
def wizard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.summary(answers(spark, sf_dir))


@query(
    "wizard_steps",
    """WITH s AS (SELECT o_orderkey, (o_orderkey % 5)::INT AS step, ['next', 'skip', 'back', 'finish'][(o_custkey % 4 + 1)::INT] AS action FROM orders)
SELECT step, action, CASE action WHEN 'back' THEN greatest(step - 1, 0) ELSE least(step + 1, 4) END AS next_step, step = 3 AND action = 'finish' AS shows_result, count(*) AS n_answers,
  (0 <= least(step, 3)) AS lit_0, (3 <= least(step, 3)) AS lit_3 FROM s GROUP BY step, action""",
)
def wizard_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.pmod("o_orderkey", F.lit(5)).cast("int").alias("step"), _nth(["next", "skip", "back", "finish"], F.pmod("o_custkey", F.lit(4)).cast("int")).alias("action"))
    counted = s.groupBy("step", "action").agg(F.count("*").alias("n_answers"))
    return counted.select(
        "step", "action", recommend.wizard_step("step", "action").alias("next_step"), recommend.shows_result("step", "action").alias("shows_result"), "n_answers",
        S.progress("step", F.lit(0)).alias("lit_0"), S.progress("step", F.lit(3)).alias("lit_3"),
    )


@query(
    "priority_presets",
    """WITH a AS (SELECT o_orderkey, (300 + 50 * (o_orderkey % 55))::INT AS budget, (o_custkey % 16)::INT AS bits FROM orders),
k AS (SELECT *, bits & 1 = 1 AS footage, CASE WHEN bits & 8 = 8 AND bits & 6 = 0 THEN 'compact' WHEN bits & 4 = 4 AND bits & 2 = 0 THEN 'long' ELSE 'default' END AS kit FROM a)
SELECT o_orderkey, kit, CASE kit WHEN 'compact' THEN CASE WHEN footage THEN 'Protected Video Build' ELSE 'First Flight Build' END WHEN 'long' THEN CASE WHEN footage THEN 'Explorer Video Build' ELSE 'Long-Range Explorer Build' END ELSE CASE WHEN footage THEN 'Cinematic Freestyle Build' ELSE 'Freestyle FPV Build' END END AS preset_name,
  CASE kit WHEN 'compact' THEN 'frame3' WHEN 'long' THEN 'frame7' ELSE 'frame5' END AS frame, CASE kit WHEN 'compact' THEN 'battery4' WHEN 'long' THEN 'battery6long' ELSE 'battery6' END AS battery,
  CASE WHEN footage AND budget >= 700 THEN 'camera4k' ELSE 'cameraFpv' END AS camera, CASE WHEN budget < 500 THEN 'receiver2' ELSE 'receiver' END AS receiver FROM k""",
)
def priority_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.pmod("o_custkey", F.lit(16)).cast("int")
    chosen = F.array_compact(F.array(*[F.when(bits.bitwiseAND(1 << i) > 0, p) for i, p in enumerate(PRIORITIES)]))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (300 + 50 * F.pmod("o_orderkey", F.lit(55))).cast("int").alias("budget"), chosen.alias("priorities"))
    got = recommend.priority_preset(asked)
    return got.select("o_orderkey", "kit", "preset_name", *[F.col("selection")[s].alias(s) for s in ("frame", "battery", "camera", "receiver")])


def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("user_id"), _nth([p[0] for p in PARTS], F.pmod("l_partkey", F.lit(8)).cast("int")).alias("part_id"))


SELECTED_SQL = f"""{PARTS_SQL}, n AS (SELECT l_orderkey AS user_id, l_partkey % 8 AS no, count(*) AS n FROM lineitem GROUP BY ALL),
users AS (SELECT DISTINCT l_orderkey AS user_id FROM lineitem),
chosen AS (SELECT users.user_id, p.id AS part_id, p.name, p.price, p.no, (coalesce(n.n, 0) % 2 = 1) <> p.essential AS is_selected FROM users CROSS JOIN parts p LEFT JOIN n ON n.user_id = users.user_id AND n.no = p.no)"""


@query("starter_totals", f"WITH {SELECTED_SQL} SELECT user_id, count(*) FILTER (WHERE is_selected) AS n_parts, coalesce(sum(price) FILTER (WHERE is_selected), 0)::BIGINT AS total FROM chosen GROUP BY user_id")
def starter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.toggled_totals(toggles(spark, sf_dir), catalog.parts(spark))


@query("starter_part_rows", f"WITH {SELECTED_SQL} SELECT user_id, part_id, p.role, is_selected FROM chosen JOIN parts p ON p.id = part_id")
def starter_part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = catalog.parts(spark)
    roles = parts.select(F.col("id").alias("part_id"), "role")
    return selection.part_rows(toggles(spark, sf_dir), parts).join(roles, "part_id").select("user_id", "part_id", "role", "is_selected")


@query("starter_rows", f"WITH {SELECTED_SQL} SELECT part_id, count(*) FILTER (WHERE is_selected) AS n_selected, count(*) FILTER (WHERE NOT is_selected) AS n_open FROM chosen GROUP BY part_id")
def starter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = toggles(spark, sf_dir)
    users = t.agg(F.count_distinct("user_id").alias("n_users"))
    counts = selection.toggled(t, catalog.parts(spark)).groupBy("part_id").agg(F.count("*").alias("n"))
    listed = catalog.parts(spark).select(F.col("id").alias("part_id")).join(counts, "part_id", "left").crossJoin(F.broadcast(users))  # eight rows, one row
    return listed.select("part_id", F.coalesce("n", F.lit(0)).alias("n_selected"), (F.col("n_users") - F.coalesce("n", F.lit(0))).alias("n_open"))


@query(
    "starter_default",
    f"WITH {PARTS_SQL}, d AS (SELECT count(*) FILTER (WHERE essential) AS n_parts, sum(price) FILTER (WHERE essential)::BIGINT AS total, count(*) AS n_all, sum(price)::BIGINT AS total_all FROM parts) "
    "SELECT c_mktsegment, n_parts, n_all, count(*) AS n_customers, (d.total * count(*))::BIGINT AS total, (d.total_all * count(*))::BIGINT AS total_all FROM customer, d GROUP BY c_mktsegment, n_parts, n_all, d.total, d.total_all",
)
def starter_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each segment's customers begin with, and what all parts would come to."""
    on = F.col("essential")
    parts = catalog.parts(spark).agg(F.count(F.when(on, 1)).alias("n_parts"), F.sum(F.when(on, F.col("price"))).alias("one"), F.count("*").alias("n_all"), F.sum("price").alias("one_all"))
    segments = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n_customers"))
    each = segments.crossJoin(parts)  # one row
    return each.select("c_mktsegment", "n_parts", "n_all", "n_customers", (F.col("one") * F.col("n_customers")).alias("total"), (F.col("one_all") * F.col("n_customers")).alias("total_all"))


@query(
    "draft_restore",
    """WITH d AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 4 AS kind FROM events)
SELECT event_id, CASE kind WHEN 0 THEN 'camera,frame' WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'esc' ELSE '' END WHEN 2 THEN 'frame,motors,esc,fc,radio' ELSE 'frame,motors,esc,fc,radio' END AS part_ids FROM d""",
)
def draft_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored drafts in four shapes: repeats and unknown ids, numbers among texts, broken text, and no list."""
    k = F.get_json_object("props", "$.k").cast("long")
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.lit('{"partIds":["camera","frame","camera","wings"]}'))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"partIds":[5,null,'), F.when(k % 2 == 0, F.lit('"esc"')).otherwise(F.lit("true")), F.lit("]}")))
        .when(F.col("event_id") % 4 == 2, F.lit('{"partIds":["camera"'))
        .otherwise(F.lit('{"partIds":"camera"}'))
    )
    drafts = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    got = selection.restored(drafts, [p[0] for p in PARTS], [p[0] for p in PARTS if p[3]])
    return got.select("event_id", F.concat_ws(",", "part_ids").alias("part_ids"))


@query("saved_build_lists", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 ELSE 0 END AS n_saved, CASE event_id % 3 WHEN 0 THEN 405 + (event_id % 100) ELSE 0 END::BIGINT AS saved_total FROM events""")
def saved_build_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('[{"id":"a","partIds":["frame"],"estimatedTotal":405},{"id":"b","partIds":[],"estimatedTotal":'), F.col("event_id") % 100, F.lit("}]"))).when(F.col("event_id") % 3 == 1, "[]")
    lists = table(spark, sf_dir, "events").select("event_id", selection.saved_builds(stored).alias("b"))
    return lists.select("event_id", F.size("b").alias("n_saved"), F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["estimatedTotal"]).alias("saved_total"))


_TEMPLATE_IDS = [t[0] for t in catalog.TEMPLATES]


@query("template_cards", f"WITH {TEMPLATES_SQL} SELECT p_partkey, id, name, level, '$' || price AS price_text, flight_time, top_speed, camera, blurb FROM part JOIN templates ON id = {_TEMPLATE_IDS}[(p_partkey % {len(_TEMPLATE_IDS)} + 1)::INT]")
def template_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The card of the template that each part belongs to."""
    cards = catalog.templates(spark).select("id", "name", "level", F.concat(F.lit("$"), "price").alias("price_text"), "flight_time", "top_speed", "camera", "blurb")
    owned = table(spark, sf_dir, "part").select("p_partkey", _nth(_TEMPLATE_IDS, F.pmod("p_partkey", F.lit(len(_TEMPLATE_IDS))).cast("int")).alias("id"))
    return owned.join(cards, "id")


def by_brand(rows: DataFrame, brand: F.Column, column: str = "brand") -> DataFrame:
    """Rows of a brand; ``All`` keeps every row."""
    return rows.filter((brand == "All") | (F.col(column) == brand))


_BRANDS = ["All", *dict.fromkeys(r[1] for r in catalog.READY_MADE)]


@query("ready_made_cards", f"WITH {READY_MADE_SQL}, b AS (SELECT c_custkey, {_BRANDS}[(c_custkey % {len(_BRANDS)} + 1)::INT] AS shown FROM customer) SELECT c_custkey, shown, name, '$' || price AS price_text, weight, best_for, brand, camera FROM ready_made, b WHERE shown = 'All' OR brand = shown")
def ready_made_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer sees under the brand they chose."""
    shown = table(spark, sf_dir, "customer").select("c_custkey", _nth(_BRANDS, F.pmod("c_custkey", F.lit(len(_BRANDS))).cast("int")).alias("shown"))
    every = shown.crossJoin(catalog.ready_made(spark))  # six rows
    return by_brand(every, F.col("shown")).select("c_custkey", "shown", "name", F.concat(F.lit("$"), "price").alias("price_text"), "weight", "best_for", "brand", "camera")


@query("brand_filter", "SELECT 'All' AS shown, count(*) AS n_parts FROM part UNION ALL SELECT p_brand, count(*) FROM part GROUP BY p_brand")
def brand_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts the brand filter shows for each brand and for ``All``: one pass over the parts."""
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n_parts"))
    return counts.select(F.col("p_brand").alias("shown"), "n_parts").unionByName(counts.agg(F.lit("All").alias("shown"), F.sum("n_parts").alias("n_parts")).select("shown", "n_parts"))
