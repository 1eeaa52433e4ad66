"""Queries on builds. A build is a customer; each order line picks product number ``l_partkey % 20`` for its slot.

The latest pick of a slot counts, by order, line and product number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kitwright.operators import configure
from kitwright.plans.registry import query
from kitwright.sources import catalog
from kitwright.sources.catalog import CATEGORIES_SQL, PRESETS_SQL, PRODUCTS_SQL, SLOTS
from kitwright.sources.tables import table


def picks(spark: SparkSession, sf_dir: str, removes: F.Column | None = None) -> DataFrame:
    """``build_id``, ``slot``, ``product_id`` and ``turn``, the order of picks (room for 65,535 lines an order).

    A line that ``removes`` is a removal, after a pick at the same place.
    """
    products = catalog.PRODUCTS
    number = F.pmod("l_partkey", F.lit(len(products))).cast("int")
    slot, ident = (F.element_at(F.array(*[F.lit(p[k]) for p in products]), number + 1) for k in ("category", "id"))
    turn = (F.col("l_orderkey").cast("long") * 65536 + F.col("l_linenumber")) * 32 + number
    if removes is not None:
        turn, ident = turn * 2 + removes.cast("int"), F.when(~removes, ident)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", turn.alias("turn"), slot.alias("slot"), ident.alias("product_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("build_id"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("build_id", "slot", "product_id", "turn")


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure.resolve(picks(spark, sf_dir), catalog.products(spark), order=["turn"])


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure.evaluate(builds(spark, sf_dir))


SHORT = dict(zip(SLOTS, ("f", "m", "c", "e", "p", "b", "k", "r"), strict=True))

#: Winners of each slot, then one row a build with the eight product numbers.
BUILDS_SQL = f"""
{PRODUCTS_SQL}, picked AS (
  SELECT o_custkey AS build_id, p.category AS slot, p.no, row_number() OVER (PARTITION BY o_custkey, p.category ORDER BY l_orderkey DESC, l_linenumber DESC, p.no DESC) AS turn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN products p ON p.no = l_partkey % 20
), slots AS (
  SELECT build_id, {", ".join(f"max(CASE WHEN slot = '{s}' THEN no END) AS {a}" for s, a in SHORT.items())}
  FROM picked WHERE turn = 1 GROUP BY build_id
)"""


def evaluation_sql(source: str, keys: str) -> str:
    """CTE ``evaluated`` over ``source`` (``keys`` and the product numbers of the slots)."""
    joins = " ".join(f"LEFT JOIN products {a}_ ON {a}_.no = s.{a}" for a in SHORT.values())
    volts = lambda a: f"b_.voltage IS NOT NULL AND {a}_.no IS NOT NULL AND (b_.voltage < {a}_.min_voltage OR b_.voltage > {a}_.max_voltage)"
    text = lambda a, label: f"'{label}: ' || b_.voltage || 'S battery is outside supported ' || {a}_.min_voltage || '–' || {a}_.max_voltage || 'S range.'"
    total = lambda c: " + ".join(f"coalesce({a}_.{c}, 0)" for a in SHORT.values())
    return f"""joined AS (
  SELECT {keys}, list_filter([
      CASE WHEN f_.no IS NOT NULL AND m_.no IS NOT NULL AND coalesce(f_.mount <> m_.mount, true) THEN 'Frame / motors: Motor mounting pattern does not fit the frame.' END,
      CASE WHEN f_.no IS NOT NULL AND p_.no IS NOT NULL AND coalesce(p_.prop_inches > f_.frame_inches, true) THEN 'Frame / propellers: Propellers exceed frame clearance.' END,
      CASE WHEN m_.no IS NOT NULL AND p_.no IS NOT NULL AND NOT coalesce(CASE WHEN m_.motor_size >= 2600 THEN p_.prop_inches IN (6, 7) WHEN m_.motor_size >= 2000 THEN p_.prop_inches IN (4, 5) ELSE p_.prop_inches <= 3 END, false) THEN 'Motors / propellers: Motor size is not rated for this propeller diameter in the demo data.' END,
      CASE WHEN {volts("m")} THEN {text("m", "Motors")} END,
      CASE WHEN {volts("e")} THEN {text("e", "ESC")} END,
      CASE WHEN {volts("c")} THEN {text("c", "Flight controller")} END,
      CASE WHEN c_.no IS NOT NULL AND e_.no IS NOT NULL AND coalesce(c_.connector <> e_.esc_input, true) THEN 'Controller / ESC: ESC plug does not match flight controller connector.' END,
      CASE WHEN m_.no IS NOT NULL AND e_.no IS NOT NULL AND coalesce(m_."current" > e_.esc_amps, true) THEN 'Motors / ESC: Motor peak current exceeds ESC rating.' END
    ], lambda x: x IS NOT NULL) AS warnings,
    {" + ".join(f"({a}_.no IS NOT NULL)::INT" for a in SHORT.values())} AS n_filled, {total("price")} AS price,
    CASE WHEN f_.no IS NOT NULL AND m_.no IS NOT NULL AND p_.no IS NOT NULL AND b_.no IS NOT NULL AND e_.no IS NOT NULL THEN {total("weight")} + 80 END AS weight,
    m_.thrust AS thrust, b_.voltage AS volts, p_.prop_inches AS inches, b_.battery_mah AS mah
  FROM {source} s {joins}
), evaluated AS (
  SELECT {keys.replace("s.", "")}, n_filled, price, weight, CASE WHEN weight > 0 AND thrust > 0 AND volts > 0 AND inches > 0 THEN floor(least(180.0, thrust * 4 / weight::DOUBLE * 12 + volts * 4 + inches * 3) + 0.5)::BIGINT END AS speed,
    CASE WHEN n_filled = 8 AND len(warnings) = 0 THEN greatest(1, least(100, floor(70 + thrust / 120.0::DOUBLE - weight / 110.0::DOUBLE + mah / 900.0::DOUBLE + 0.5)::BIGINT)) END AS score,
    CASE WHEN len(warnings) > 0 THEN 'incompatible' WHEN n_filled < 8 THEN 'unknown' ELSE 'compatible' END AS status, warnings
  FROM joined
)"""


EVALUATED_SQL = f"WITH {BUILDS_SQL}, {evaluation_sql('slots', 's.build_id')}"


@query("build_status_histogram", f"{EVALUATED_SQL} SELECT status, count(*) AS n_builds, round(avg(price)::DOUBLE, 4) AS mean_price, max(score) AS best_score FROM evaluated GROUP BY status")
def build_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.round((F.sum("price") / F.count("*")).cast("double"), 4)
    return evaluated(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n_builds"), mean.alias("mean_price"), F.max("score").alias("best_score"))


@query("build_evaluation", f"{EVALUATED_SQL} SELECT build_id, n_filled, price::DOUBLE AS price, weight::BIGINT AS weight, speed, score, status, array_to_string(warnings, ' | ') AS warnings, '' AS missing FROM evaluated")
def build_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluated(spark, sf_dir)
    return e.withColumn("price", F.col("price").cast("double")).withColumn("warnings", F.concat_ws(" | ", "warnings")).withColumn("missing", F.concat_ws(" | ", "missing"))


@query("build_rule_counts", f"{EVALUATED_SQL} SELECT split_part(w, ':', 1) AS rule_label, count(*) AS n_builds FROM (SELECT unnest(warnings) AS w FROM evaluated) GROUP BY 1")
def build_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select(F.explode("warnings").alias("w")).groupBy(F.split_part("w", F.lit(":"), F.lit(1)).alias("rule_label")).agg(F.count("*").alias("n_builds"))


#: An amount in German style.
_EUROS = "translate(format('{{:,.2f}}', {}::DOUBLE), ',.', '.,') || chr(160) || '€'"


@query(
    "build_tiles",
    f"""{EVALUATED_SQL} SELECT build_id, coalesce(score::VARCHAR, '—') || '/100' AS score_text, CASE WHEN score >= 80 THEN 'Great match' WHEN score IS NOT NULL THEN 'Good match' ELSE 'Build incomplete' END AS grade,
  coalesce('~ ' || speed::VARCHAR || ' km/h', '—') AS speed_text, coalesce('~ ' || weight::VARCHAR || ' g', '—') AS weight_text, {_EUROS.format("price")} AS price_text,
  CASE status WHEN 'compatible' THEN 'All components are compatible' WHEN 'incompatible' THEN 'Compatibility needs attention' ELSE 'Select components to check compatibility' END AS status_text FROM evaluated""",
)
def build_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure.tiles(evaluated(spark, sf_dir))


_CANDIDATES = ", ".join(f"CASE WHEN q.category = '{s}' THEN q.no ELSE {a} END AS {a}" for s, a in SHORT.items())


@query(
    "candidate_verdicts",
    f"WITH {BUILDS_SQL}, tried AS (SELECT build_id, q.category, q.id AS candidate_id, {_CANDIDATES} FROM slots CROSS JOIN products q), "
    f"{evaluation_sql('tried', 's.build_id, s.category, s.candidate_id')} "
    "SELECT build_id, category, candidate_id, status AS verdict, array_to_string(warnings, ' | ') AS messages FROM evaluated",
)
def candidate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = configure.candidates(builds(spark, sf_dir), catalog.products(spark))
    return found.withColumnRenamed("status", "verdict").withColumn("messages", F.concat_ws(" | ", "messages"))


@query(
    "candidate_rows",
    f"WITH {BUILDS_SQL}, tried AS (SELECT build_id, q.category, q.id AS candidate_id, {_CANDIDATES} FROM slots CROSS JOIN products q WHERE q.category = 'esc'), "
    f"{evaluation_sql('tried', 's.build_id, s.category, s.candidate_id')} "
    "SELECT build_id, e.category, candidate_id, q.spec || ' · ' || q.weight || ' g' AS detail, CASE status WHEN 'incompatible' THEN array_to_string(warnings, ' ') "
    "WHEN 'compatible' THEN 'Compatible with the completed demo build' ELSE 'No conflicts found so far; complete the build to verify.' END AS verdict_text FROM evaluated e JOIN products q ON q.id = candidate_id",
)
def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = catalog.products(spark)
    return configure.candidate_rows(configure.candidates(builds(spark, sf_dir), products, "esc"), products)


@query(
    "candidate_visible_counts",
    f"WITH {BUILDS_SQL}, tried AS (SELECT build_id, q.category, q.id AS candidate_id, {_CANDIDATES} FROM slots CROSS JOIN products q WHERE q.category = 'motors'), "
    f"{evaluation_sql('tried', 's.build_id, s.category, s.candidate_id')} "
    "SELECT candidate_id, count(*) AS n_visible FROM evaluated WHERE status <> 'incompatible' GROUP BY 1",
)
def candidate_visible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = configure.candidates(builds(spark, sf_dir), catalog.products(spark), "motors", compatible_only=True)
    return found.groupBy("candidate_id").agg(F.count("*").alias("n_visible"))


@query(
    "component_rows",
    f"{EVALUATED_SQL}, {CATEGORIES_SQL}, long AS (UNPIVOT (SELECT build_id, {', '.join(f'coalesce({a}, -1) AS {s}' for s, a in SHORT.items())} FROM slots) ON {', '.join(SLOTS)} INTO NAME category VALUE no) "
    "SELECT build_id, ord, label, coalesce(name, 'No component selected') AS product_name, spec, CASE WHEN p.no IS NULL THEN 'Not selected' WHEN status = 'compatible' THEN 'Compatible' WHEN status = 'incompatible' THEN 'Check fit' ELSE 'Pending checks' END AS fit, "
    f"coalesce({_EUROS.format('p.price')}, '—') AS price_text, CASE WHEN p.no IS NULL THEN 'Select Component' ELSE 'Change' END AS button FROM long JOIN categories USING (category) JOIN evaluated e USING (build_id) LEFT JOIN products p USING (no)",
)
def component_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category of every build, filled or not."""
    return configure.component_rows(builds(spark, sf_dir), catalog.products(spark), catalog.categories(spark))


@query(
    "build_export",
    f"WITH {BUILDS_SQL} SELECT build_id, md5('{{\\n  \"source\": \"kitwright\",\\n  \"name\": \"Build ' || build_id || '\",\\n  \"selection\": {{\\n' || ".replace("\\n", "' || chr(10) || '")
    + "array_to_string(list_filter([" + ", ".join(f"'    \"{s}\": \"' || {a}_.id || '\"'" for s, a in SHORT.items()) + "], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '  }' || chr(10) || '}') AS export_md5 FROM slots s "
    + " ".join(f"LEFT JOIN products {a}_ ON {a}_.no = s.{a}" for a in SHORT.values()),
)
def build_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = configure.exported(builds(spark, sf_dir), "kitwright", F.concat(F.lit("Build "), F.col("build_id")))
    return out.select("build_id", F.md5("export").alias("export_md5"))


_ALL = "every AS (SELECT " + ", ".join(f"{a}0.no AS {a}" for a in SHORT.values()) + " FROM " + ", ".join(f"(SELECT no FROM products WHERE category = '{s}') {a}0" for s, a in SHORT.items()) + ")"


#: The products that any order line picks.
_STOCK = "stock AS (SELECT p.*, (SELECT count(*) FROM lineitem WHERE l_partkey % 20 = p.no) AS n_picks FROM products p WHERE p.no IN (SELECT DISTINCT l_partkey % 20 FROM lineitem))"


@query(
    "catalogue_cross_product",
    f"WITH {PRODUCTS_SQL}, {_STOCK}, {_ALL.replace('FROM products', 'FROM stock')}, {evaluation_sql('every', 's.' + ', s.'.join(SHORT.values()))} SELECT status, count(*) AS n_builds, min(score) AS lowest, max(score) AS highest, "
    f"sum((SELECT sum(n_picks) FROM stock WHERE no IN ({', '.join('e.' + a for a in SHORT.values())})))::BIGINT AS n_picks FROM evaluated e GROUP BY status",
)
def catalogue_cross_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every complete build of the products that are picked at all, and how often their parts are picked."""
    picked = table(spark, sf_dir, "lineitem").groupBy(F.pmod("l_partkey", F.lit(20)).cast("int").alias("no")).agg(F.count("*").alias("n_picks"))
    stock = catalog.products(spark).join(picked, "no", "left_semi")
    builds = configure.catalogue_builds(stock)
    for s in SLOTS:
        builds = builds.join(picked.toDF("_no", f"_{s}"), F.col(s)["no"] == F.col("_no")).drop("_no")
    n_picks = sum((F.col(f"_{s}") for s in SLOTS), F.lit(0))
    e = configure.evaluate(builds.withColumn("n_picks", n_picks), ["n_picks"])
    return e.groupBy("status").agg(F.count("*").alias("n_builds"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.sum("n_picks").alias("n_picks"))


_PRESET_NUMBERS = "numbered AS (SELECT key, " + ", ".join(f"(SELECT no FROM products WHERE id = s{i}) AS {a}" for i, a in enumerate(SHORT.values())) + " FROM presets)"
#: The preset that an order asks for.
PRESET_KEYS = [p[0] for p in catalog.PRESETS]


def asked_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.get(F.array(*map(F.lit, PRESET_KEYS)), F.pmod("o_custkey", F.lit(len(PRESET_KEYS))).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", key.alias("preset"))


@query(
    "preset_evaluation",
    f"WITH {PRODUCTS_SQL}, {PRESETS_SQL}, {_PRESET_NUMBERS}, {evaluation_sql('numbered', 's.key')}, asked AS (SELECT {PRESET_KEYS}[(o_custkey % {len(PRESET_KEYS)} + 1)::INT] AS key, count(*) AS n_orders FROM orders GROUP BY 1) "
    "SELECT key AS preset, n_filled, price::DOUBLE AS price, weight::BIGINT AS weight, speed, score, status, n_orders, (price * n_orders)::DOUBLE AS revenue FROM evaluated JOIN asked USING (key)",
)
def preset_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presets that orders ask for, and what they bring in."""
    asked = asked_presets(spark, sf_dir).groupBy("preset").agg(F.count("*").alias("n_orders"))
    chosen = catalog.presets(spark).select(F.col("key").alias("preset"), F.explode("selection").alias("slot", "product_id"))
    e = configure.evaluate(configure.resolve(chosen, catalog.products(spark), "preset")).join(asked, "preset")
    return e.select("preset", "n_filled", F.col("price").cast("double").alias("price"), "weight", "speed", "score", "status", "n_orders", (F.col("price") * F.col("n_orders")).cast("double").alias("revenue"))
