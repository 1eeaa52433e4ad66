"""Queries on large catalogues, removals, runs of actions, read-once slots, chart series and sign-up outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kitwright.functions import scalars as S
from kitwright.operators import configure, slots, wizard
from kitwright.plans.builds import SHORT, evaluation_sql, picks
from kitwright.plans.registry import query
from kitwright.sources import catalog
from kitwright.sources.catalog import PRODUCTS_SQL
from kitwright.sources.tables import table

#: Slots of the parts taken as products, by their number.
PART_SLOTS = ["frame", "motors", "propellers", "flightController", "esc", "battery"]


def part_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a product with the attributes of its slot, drawn from its number, size and brand."""
    k, size = F.col("p_partkey"), F.col("p_size")
    category = F.get(F.array(*map(F.lit, PART_SLOTS)), F.pmod(k, F.lit(6)).cast("int"))
    only = lambda slot, value: F.when(category == slot, value)
    supplied = category.isin("motors", "esc", "flightController")
    made = {
        "no": k.cast("int"), "id": F.concat(F.lit("p"), k), "category": category, "price": F.col("p_retailprice").cast("decimal(10,2)"), "weight": size,
        "frame_inches": only("frame", size % 8), "mount": F.when(category.isin("frame", "motors") & (size % 11 > 0), F.col("p_brand")), "prop_inches": only("propellers", F.when(size % 13 > 0, size % 9)),
        "motor_size": only("motors", 1400 + F.pmod(k * 7, F.lit(1600)).cast("int")), "voltage": only("battery", F.pmod(k, F.lit(43)).cast("int")), "min_voltage": F.when(supplied & (size % 7 > 0), size % 43),
        "max_voltage": F.when(supplied, size % 43 + 2), "connector": only("flightController", F.col("p_type")), "esc_input": only("esc", F.concat("p_type", F.when(size > 40, "x").otherwise(""))), "thrust": F.lit(None).cast("int"),
        "current": only("motors", F.pmod(k, F.lit(97)).cast("int")), "esc_amps": only("esc", size % 12), "battery_mah": F.lit(None).cast("int"),
    }
    return table(spark, sf_dir, "part").select(*[made[c].alias(c) for c in configure.ATTRIBUTES])


PART_PRODUCTS_SQL = f"""products AS (SELECT *, CASE WHEN category = 'frame' THEN p_size % 8 END AS frame_inches, CASE WHEN category IN ('frame', 'motors') AND p_size % 11 > 0 THEN p_brand END AS mount,
  CASE WHEN category = 'propellers' AND p_size % 13 > 0 THEN p_size % 9 END AS prop_inches, CASE WHEN category = 'motors' THEN 1400 + (p_partkey * 7) % 1600 END AS motor_size, CASE WHEN category = 'battery' THEN p_partkey % 43 END AS voltage,
  CASE WHEN category IN ('motors', 'esc', 'flightController') AND p_size % 7 > 0 THEN p_size % 43 END AS min_voltage, CASE WHEN category IN ('motors', 'esc', 'flightController') THEN p_size % 43 + 2 END AS max_voltage,
  CASE WHEN category = 'flightController' THEN p_type END AS connector, CASE WHEN category = 'esc' THEN p_type || CASE WHEN p_size > 40 THEN 'x' ELSE '' END END AS esc_input,
  CASE WHEN category = 'motors' THEN p_partkey % 97 END AS "current", CASE WHEN category = 'esc' THEN p_size % 12 END AS esc_amps
  FROM (SELECT *, 'p' || p_partkey AS id, {PART_SLOTS}[(p_partkey % 6 + 1)::INT] AS category FROM part))"""


@query(
    "pair_rules",
    f"""WITH {PART_PRODUCTS_SQL}, f AS (SELECT * FROM products WHERE category = 'frame'), m AS (SELECT * FROM products WHERE category = 'motors'), p AS (SELECT * FROM products WHERE category = 'propellers'),
c AS (SELECT * FROM products WHERE category = 'flightController'), e AS (SELECT * FROM products WHERE category = 'esc'), pairs AS (
SELECT 'Frame / motors' AS rule_label, f.id AS a_id, m.id AS b_id FROM f, m WHERE f.mount = m.mount
UNION ALL SELECT 'Frame / propellers', f.id, p.id FROM f, p WHERE f.frame_inches > 0 AND p.prop_inches > 0 AND p.prop_inches <= f.frame_inches
UNION ALL SELECT 'Motors / propellers', m.id, p.id FROM m, p WHERE p.prop_inches > 0 AND CASE WHEN m.motor_size >= 2600 THEN p.prop_inches BETWEEN 6 AND 7 WHEN m.motor_size >= 2000 THEN p.prop_inches BETWEEN 4 AND 5 ELSE p.prop_inches <= 3 END
UNION ALL SELECT 'Controller / ESC', c.id, e.id FROM c, e WHERE c.connector = e.esc_input
UNION ALL SELECT 'Motors / ESC', m.id, e.id FROM m, e WHERE m."current" > 0 AND e.esc_amps > 0 AND m."current" <= e.esc_amps)
SELECT rule_label, a_id, count(*) AS n_fitting, min(b_id) AS first_fitting FROM pairs GROUP BY ALL""",
)
def pair_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits each part taken as a product, by rule."""
    return configure.fitting_counts(part_products(spark, sf_dir), amperes=7).withColumnRenamed("rule", "rule_label")


@query(
    "voltage_fits",
    f"""WITH {PART_PRODUCTS_SQL} SELECT CASE p.category WHEN 'motors' THEN 'Motors' WHEN 'esc' THEN 'ESC' ELSE 'Flight controller' END AS rule_label, p.id AS b_id, count(*) AS n_batteries, min(b.id) AS first_battery
FROM products b JOIN products p ON b.voltage BETWEEN p.min_voltage AND p.max_voltage WHERE b.category = 'battery' GROUP BY ALL""",
)
def voltage_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many batteries lie in the range of each part taken as a product."""
    return configure.voltage_counts(part_products(spark, sf_dir)).withColumnRenamed("rule", "rule_label")


_REMOVALS = f"""WITH {PRODUCTS_SQL}, picked AS (
  SELECT o_custkey AS build_id, p.category AS slot, CASE WHEN l_returnflag <> 'R' THEN p.no END AS no, row_number() OVER (PARTITION BY o_custkey, p.category ORDER BY l_orderkey DESC, l_linenumber DESC, p.no DESC, l_returnflag = 'R' DESC) AS turn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN products p ON p.no = l_partkey % 20
), slots AS (SELECT build_id, {", ".join(f"max(CASE WHEN slot = '{s}' THEN no END) AS {a}" for s, a in SHORT.items())} FROM picked WHERE turn = 1 GROUP BY build_id)"""


@query("builds_after_removals", f"{_REMOVALS}, {evaluation_sql('slots', 's.build_id')} SELECT build_id, n_filled, price::DOUBLE AS price, score, status FROM evaluated")
def builds_after_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds where a returned line removes what its slot holds: a removal after a pick empties it, a pick after that fills it."""
    chosen = picks(spark, sf_dir, F.col("l_returnflag") == "R")
    e = configure.evaluate(configure.resolve(chosen, catalog.products(spark), order=["turn"]))
    return e.select("build_id", "n_filled", F.col("price").cast("double").alias("price"), "score", "status")


_ACTIONS = ["next", "next", "skip", "finish", "back", "over", "next"]


@query(
    "wizard_runs",
    f"""WITH RECURSIVE a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 7) AS k, {_ACTIONS}[(l_partkey % 7 + 1)::INT] AS action, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
w AS (SELECT l_orderkey, n, 0::BIGINT AS k, 0 AS step, false AS told FROM a WHERE k = 1
  UNION ALL SELECT w.l_orderkey, w.n, w.k + 1, CASE action WHEN 'back' THEN greatest(step - 1, 0) WHEN 'finish' THEN 4 WHEN 'over' THEN 0 ELSE least(step + 1, 4) END, CASE action WHEN 'finish' THEN true WHEN 'over' THEN false ELSE told END
  FROM w JOIN a ON a.l_orderkey = w.l_orderkey AND a.k = w.k + 1)
SELECT l_orderkey, n AS n_actions, step AS last_step, step = 4 AND told AS shows_result FROM w WHERE k = n""",
)
def wizard_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's lines as the actions of a run through the questionnaire."""
    action = F.get(F.array(*map(F.lit, _ACTIONS)), F.pmod("l_partkey", F.lit(7)).cast("int"))
    turn = F.col("l_linenumber") * 7 + F.pmod("l_partkey", F.lit(7))  # lines of one number go by what they do
    return wizard.runs(table(spark, sf_dir, "lineitem").select("l_orderkey", turn.alias("turn"), action.alias("action")), "l_orderkey", "turn")


@query(
    "captured_errors",
    """WITH e AS (SELECT *, lag(event_type) OVER w AS before, lag(event_id) OVER w AS before_id, lag(ts) OVER w AS before_ts FROM events WHERE event_type IN ('error', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CASE WHEN before = 'error' AND ts - before_ts <= INTERVAL 5 DAY THEN before_id END AS found FROM e WHERE event_type = 'view'""",
)
def captured_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error that each view takes from its user's slot; five days to live, as a user's events are days apart."""
    kind = F.col("event_type")
    return slots.reads(table(spark, sf_dir, "events"), kind == "error", kind == "view", 5 * 86400.0)


#: Labels and colors by key, as a chart is configured; one has neither color nor theme.
SERIES = {"view": ("Viewed", "#1f77b4", None), "error": ("Failed", None, "dark"), "kind": ("By kind", "#2ca02c", None), "shop": ("Shop", None, None), "value": ("Value", "#d62728", None)}


@query(
    "chart_series",
    """SELECT event_id, key, CASE key WHEN 'kind' THEN CASE event_type WHEN 'view' THEN 'Viewed' WHEN 'error' THEN 'Failed' ELSE 'By kind' END WHEN 'place' THEN CASE WHEN event_id % 2 = 0 THEN 'Shop' END ELSE 'Value' END AS label,
  CASE key WHEN 'kind' THEN CASE event_type WHEN 'view' THEN '#1f77b4' WHEN 'error' THEN NULL ELSE '#2ca02c' END WHEN 'value' THEN '#d62728' END AS color
FROM (SELECT *, ['kind', 'place', 'value'][(event_id % 3 + 1)::INT] AS key FROM events WHERE event_type <> 'click')""",
)
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of events as chart items but clicks, which are of no series, the configuration by a key in the item, in its payload, or the key itself."""
    config = F.create_map(*[x for k, v in SERIES.items() for x in (F.lit(k), F.struct(*[F.lit(t).cast("string").alias(n) for n, t in zip(("label", "color", "theme"), v, strict=True)]))])
    payload = F.struct(F.when(F.col("event_id") % 2 == 0, "shop").otherwise("web").alias("place"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    item = F.to_variant_object(F.struct(F.when(F.col("event_type") == "click", "none").otherwise("line").alias("type"), F.col("event_type").alias("kind"), "value", payload.alias("payload")))
    key = F.get(F.array(F.lit("kind"), F.lit("place"), F.lit("value")), (F.col("event_id") % 3).cast("int"))
    items = table(spark, sf_dir, "events").select("event_id", key.alias("key"), item.alias("item")).filter(S.shown_series("item"))
    found = items.withColumn("c", S.payload_config(config, F.col("item"), F.col("key")))
    return found.select("event_id", "key", F.col("c.label").alias("label"), F.col("c.color").alias("color"))


@query(
    "sign_up_outcomes",
    """WITH s AS (SELECT *, c_custkey % 5 AS kind, CASE WHEN c_custkey % 6 = 0 THEN 'c' ELSE 'c@a.b' END AS email, c_custkey % 7 AS letters, CASE WHEN c_custkey % 11 = 0 THEN 101 ELSE 5 END AS named FROM customer)
SELECT c_custkey, (c_custkey % 6 = 0)::INT + (named > 100)::INT + (letters = 0 OR letters < 4)::INT AS n_errors, kind = 4 OR kind = 3 AS ok,
  CASE kind WHEN 0 THEN 'Could not create your account. Check your connection and try again.' WHEN 1 THEN 'rate limit' WHEN 2 THEN 'An account with this email already exists. Try signing in.' END AS error_text, kind = 3 AS needs_confirmation,
  replace('r' || c_custkey || ':x:', ':', '') AS chart_id, contains(c_name, '00') AS has_zeros, try_cast(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '1' || c_custkey END AS DOUBLE) AS number FROM s""",
)
def sign_up_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form errors counted, and what the sign-up service answered, for each customer."""
    key = F.col("c_custkey")
    kind = key % 5
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment", F.when(key % 6 == 0, "c").otherwise("c@a.b").alias("email"), F.repeat(F.lit("x"), (key % 7 * 2).cast("int")).alias("password"), F.repeat(F.lit("n"), F.when(key % 11 == 0, 101).otherwise(5)).alias("name"),
        (kind != 0).alias("reached"), F.when(kind == 1, "rate limit").alias("error"), F.when(kind == 2, 0).when(kind > 2, 1).alias("identities"), (kind == 4).alias("session"),
    )
    outcome = S.sign_up_outcome("reached", "error", "identities", "session")
    return rows.select("c_custkey", F.size(S.form_errors("email", "password", "name")).alias("n_errors"), outcome.alias("o"), "c_name", "c_mktsegment").select(
        "c_custkey", "n_errors", "o.ok", "o.error_text", "o.needs_confirmation", S.chart_id(F.concat(F.lit("r"), "c_custkey", F.lit(":x:"))).alias("chart_id"), F.contains("c_name", F.lit("00")).alias("has_zeros"),
        S.number(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("1"), "c_custkey"))).alias("number"),
    )


@query(
    "calendar_labels",
    "SELECT o_orderkey, strftime(o_orderdate, '%b') AS month_label, strftime(o_orderdate, '%-m/%-d/%Y') AS day_label FROM orders",
)
def calendar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month and day texts of a calendar."""
    return table(spark, sf_dir, "orders").select("o_orderkey", S.month_label("o_orderdate").alias("month_label"), S.day_label("o_orderdate").alias("day_label"))
