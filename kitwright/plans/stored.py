"""Queries on stored records, the catalogue index, presets, render parameters and ordered trails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kitwright.functions import scalars as S
from kitwright.operators import records
from kitwright.plans.accounts import AS_OF, STATES_SQL, _at, invoices, states
from kitwright.plans.builds import BUILDS_SQL, PRESET_KEYS, asked_presets, builds
from kitwright.plans.registry import query
from kitwright.sources import catalog
from kitwright.sources.catalog import PRESETS_SQL, PRODUCTS_SQL, SLOTS
from kitwright.sources.tables import table


@query(
    "product_index",
    f"WITH {PRODUCTS_SQL}, r AS (SELECT p.id, p.category, p_name AS name, p_retailprice AS price, p_size AS weight, row_number() OVER (PARTITION BY p.id ORDER BY p_partkey DESC) AS back FROM part JOIN products p ON p.no = p_partkey % 20) "
    "SELECT id, category, name, price::DECIMAL(10, 2)::DOUBLE AS price, weight FROM r WHERE back = 1",
)
def product_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as rows of the catalogue, by id; of a repeated id the last row counts."""
    known = catalog.products(spark).select(F.col("no").alias("_no"), "id", "category")
    rows = table(spark, sf_dir, "part").join(known, F.pmod("p_partkey", F.lit(20)) == F.col("_no"))
    rows = rows.select("id", F.col("p_partkey").alias("no"), "category", F.col("p_name").alias("name"), F.col("p_retailprice").cast("decimal(10,2)").alias("price"), F.col("p_size").alias("weight"))
    return catalog.product_index(rows).select("id", "category", "name", F.col("price").cast("double").alias("price"), "weight")


@query(
    "preset_rows",
    f"WITH {PRESETS_SQL} SELECT o_orderkey, key AS preset, name, slot, product_id FROM orders JOIN (" + " UNION ALL ".join(f"SELECT key, name, '{s}' AS slot, s{i} AS product_id FROM presets" for i, s in enumerate(SLOTS)) + f") p ON key = {PRESET_KEYS}[(o_custkey % {len(PRESET_KEYS)} + 1)::INT]",
)
def preset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of the preset that each order asks for."""
    rows = catalog.presets(spark).select(F.col("key").alias("preset"), "name", F.explode("selection").alias("slot", "product_id"))
    return asked_presets(spark, sf_dir).join(rows, "preset").select("o_orderkey", "preset", "name", "slot", "product_id")


@query("budget_domain", "SELECT budget, count(o_orderkey) AS n_orders FROM (SELECT range AS budget FROM range(300, 3001, 50)) LEFT JOIN orders ON budget = 300 + 50 * least(54, greatest(0, (floor(o_totalprice / 200)::BIGINT - 300) // 50)) GROUP BY budget")
def budget_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every budget that can be asked for, and how many orders would: a two-hundredth of their price, brought to the nearest budget below."""
    steps = F.sequence(F.lit(catalog.BUDGET_MIN), F.lit(catalog.BUDGET_MAX), F.lit(catalog.BUDGET_STEP))
    budgets = spark.range(1).select(F.explode(steps).alias("budget")).select(F.col("budget").cast("long"))
    step = F.expr(f"(floor(o_totalprice / 200) - {catalog.BUDGET_MIN}) div {catalog.BUDGET_STEP}")
    asked = catalog.BUDGET_MIN + catalog.BUDGET_STEP * F.least(F.lit((catalog.BUDGET_MAX - catalog.BUDGET_MIN) // catalog.BUDGET_STEP), F.greatest(F.lit(0), step))
    counts = table(spark, sf_dir, "orders").groupBy(asked.cast("long").alias("budget")).agg(F.count("*").alias("n_orders"))
    return budgets.join(counts, "budget", "left").fillna(0, ["n_orders"])


@query(
    "render_parameters",
    f"""WITH {BUILDS_SQL}, r AS (SELECT build_id, CASE a.frame_inches WHEN 7 THEN 2.05::DOUBLE WHEN 3 THEN 1.15::DOUBLE ELSE 1.6::DOUBLE END AS radius, coalesce(b.prop_inches, 5) / 5.0::DOUBLE * 0.66::DOUBLE AS prop_scale FROM slots s LEFT JOIN products a ON a.no = s.f LEFT JOIN products b ON b.no = s.p),
c(corner, sx, sz) AS (VALUES (0, -1, -1), (1, 1, -1), (2, -1, 1), (3, 1, 1))
SELECT build_id, corner, round(radius * sx, 6) AS x, round(radius * sz, 6) AS z, round(prop_scale, 6) AS prop_scale, round(sqrt(2.0::DOUBLE * radius * radius) * 1.35::DOUBLE, 6) AS arm, round(CASE WHEN sx * sz > 0 THEN -1 ELSE 1 END * pi() / 4, 6) AS turn FROM r, c""",
)
def render_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size class of the frame, the scale of the propellers and the four mirrored arms of each build."""
    inches = F.col("frame")["frame_inches"]
    radius = F.when(inches == 7, 2.05).when(inches == 3, 1.15).otherwise(1.6)
    scale = F.coalesce(F.col("propellers")["prop_inches"], F.lit(5)) / 5 * 0.66
    corners = F.posexplode(F.array(*[F.struct(F.lit(x).alias("sx"), F.lit(z).alias("sz")) for x, z in ((-1, -1), (1, -1), (-1, 1), (1, 1))]))
    rows = builds(spark, sf_dir).select("build_id", radius.alias("radius"), scale.alias("scale"), corners.alias("corner", "c"))
    x, z = F.col("radius") * F.col("c.sx"), F.col("radius") * F.col("c.sz")
    return rows.select(
        "build_id", "corner", F.round(x, 6).alias("x"), F.round(z, 6).alias("z"), F.round("scale", 6).alias("prop_scale"), F.round(F.hypot(x, z) * 1.35, 6).alias("arm"),
        F.round(F.when(x * z > 0, -1).otherwise(1) * F.pi() / 4, 6).alias("turn"),
    )


#: A stored text for each user: three in five are whole, one is broken and one is missing.
_RAW = """CASE WHEN user_id % 5 = 4 THEN '{"plan":"team","card"' WHEN user_id % 5 < 3 THEN concat(
  '{"plan":"', CASE WHEN user_id % 3 = 0 THEN 'pro' ELSE 'team' END, '","interval":"yearly","cancelAtPeriodEnd":', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END,
  ',"periodEndAt":"2024-0', user_id % 2 + user_id % 3 + 2, '-01T00:00:00.000Z","card":', CASE WHEN user_id % 5 = 2 THEN 'null' ELSE '{"brand":"VISA","last4":"4242","addedAt":"2024-01-02T03:04:05.678Z"}' END,
  ',"billingEmail":"pay', user_id, '@example.com","usage":{"aiBuilds":', n, ',"savedBuilds":', top % 60, ',"exports":', n % 7,
  '},"invoices":[{"id":"DEMO-0002","date":"2024-02-01T00:00:00.000Z","description":"Team plan, monthly","amount":49,"status":"Paid"},{"id":"DEMO-0001","date":"2024-01-01T00:00:00.000Z","description":"Pro plan, monthly","amount":', n, '.4,"status":"Paid"}],"nextInvoiceNumber":', n + 3, '}') END AS raw"""


@query(
    "billing_records",
    f"""WITH s AS (SELECT user_id, {_RAW} FROM (SELECT user_id, count(*) AS n, max(event_id) AS top FROM events GROUP BY user_id)), j AS (SELECT user_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS r FROM s),
p AS (SELECT *, r IS NULL AS was_seeded, r->>'plan' AS plan, (r->>'cancelAtPeriodEnd')::BOOLEAN AS cancels, replace(r->>'periodEndAt', 'Z', '')::TIMESTAMP AS ends, replace(r->'card'->>'addedAt', 'Z', '')::TIMESTAMP AS added FROM j),
o AS (SELECT *, coalesce(cancels AND ends <= TIMESTAMP '{AS_OF}', false) AS is_over FROM p)
SELECT user_id, was_seeded, CASE WHEN was_seeded THEN 'pro' WHEN is_over THEN 'free' ELSE plan END AS plan, CASE WHEN was_seeded OR is_over THEN 'monthly' ELSE r->>'interval' END AS plan_interval, coalesce(cancels AND NOT is_over, false) AS cancels,
  CASE WHEN was_seeded THEN TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY WHEN NOT is_over THEN ends END AS period_end_at,
  CASE WHEN is_over AND user_id % 4 = 0 THEN NULL ELSE coalesce(added, TIMESTAMP '{AS_OF}') END AS card_added_at, CASE WHEN is_over AND user_id % 4 = 0 THEN NULL ELSE '4242' END AS card_last4,
  CASE WHEN user_id % 7 = 0 THEN 'bills' || user_id || '@example.com' WHEN was_seeded THEN 'user' || user_id || '@example.com' ELSE r->>'billingEmail' END AS billing_email,
  coalesce((r->'usage'->>'aiBuilds')::BIGINT, 4) AS ai_builds, coalesce((r->'usage'->>'savedBuilds')::BIGINT, 15) AS saved_builds, coalesce((r->'usage'->>'exports')::BIGINT, 6) AS exports,
  CASE WHEN was_seeded THEN 4 ELSE json_array_length(r->'invoices') END::INT AS n_invoices, CASE WHEN was_seeded THEN 19 ELSE (r->'invoices'->1->>'amount')::DOUBLE END::DOUBLE AS second_amount,
  coalesce((r->>'nextInvoiceNumber')::INT, 5) AS next_invoice FROM o""",
)
def billing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records read, a card added, cards removed on free plans, e-mails changed, and all written as text and read again."""
    user, as_of = F.col("user_id"), _at(AS_OF)
    mail = lambda name: F.concat(F.lit(name), user.cast("string"), F.lit("@example.com"))
    texts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("top")).selectExpr("user_id", _RAW)
    stored = records.read(texts, "raw", as_of, mail("user"))
    carded = records.with_card(F.col("record"), as_of)
    carded = F.when(user % 4 == 0, records.without_card(carded)).otherwise(carded)
    mailed = records.with_email(F.col("record"), F.when(user % 7 == 0, mail("bills")))
    changed = stored.withColumn("record", carded).withColumn("record", mailed)
    again = records.read(changed.select("user_id", "was_seeded", records.text(F.col("record")).alias("raw")).withColumnRenamed("was_seeded", "seeded"), "raw", as_of, mail("user"))
    again, r = again.withColumn("record", records.fields(F.col("record"))), F.col("record")
    return again.select(
        "user_id", F.col("seeded").alias("was_seeded"), r["plan"].alias("plan"), r["interval"].alias("plan_interval"), r["cancelAtPeriodEnd"].alias("cancels"), r["periodEndAt"].alias("period_end_at"),
        r["card"]["addedAt"].alias("card_added_at"), r["card"]["last4"].alias("card_last4"), r["billingEmail"].alias("billing_email"), r["usage"]["aiBuilds"].alias("ai_builds"), r["usage"]["savedBuilds"].alias("saved_builds"),
        r["usage"]["exports"].alias("exports"), F.size(r["invoices"]).alias("n_invoices"), r["invoices"][1]["amount"].cast("double").alias("second_amount"), r["nextInvoiceNumber"].alias("next_invoice"),
    )


@query(
    "stored_billing",
    """SELECT user_id, CASE WHEN user_id % 4 = 1 THEN 'team' WHEN user_id % 4 = 2 THEN 'free' ELSE 'pro' END AS plan, CASE WHEN user_id % 4 = 1 THEN 'yearly' ELSE 'monthly' END AS plan_interval,
  CASE WHEN user_id % 4 = 1 THEN 12 WHEN user_id % 4 = 2 THEN 7 ELSE 5 END AS next_invoice, user_id % 4 IN (0, 3) AS was_seeded FROM (SELECT DISTINCT user_id FROM events)""",
)
def stored_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records read back: a live one, a cancelled one whose period has ended, a broken text, and none."""
    k = F.col("user_id") % 4
    raw = (
        F.when(k == 1, '{"plan":"team","interval":"yearly","cancelAtPeriodEnd":false,"periodEndAt":"2023-01-01T00:00:00.000Z","nextInvoiceNumber":12}')
        .when(k == 2, '{"plan":"team","interval":"yearly","cancelAtPeriodEnd":true,"periodEndAt":"2024-03-01T00:00:00.000Z","nextInvoiceNumber":7}')
        .when(k == 3, '{"plan":"team"')
    )
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    got = records.read(users.withColumn("raw", raw), "raw", _at(AS_OF), F.lit("a@example.com"))
    r = records.fields(F.col("record"))
    return got.select("user_id", r["plan"].alias("plan"), r["interval"].alias("plan_interval"), r["nextInvoiceNumber"].alias("next_invoice"), "was_seeded")


@query(
    "invoice_totals",
    f"""WITH {STATES_SQL}, i AS (SELECT user_id, CASE WHEN value >= 50 THEN CASE WHEN event_id % 2 = 0 THEN 470.4 ELSE 49 END ELSE CASE WHEN event_id % 2 = 0 THEN 182.4 ELSE 19 END END AS amount FROM events WHERE event_type = 'purchase')
SELECT user_id, plan, round((76 + coalesce((SELECT sum(amount) FROM i WHERE i.user_id = final.user_id), 0))::DOUBLE, 2) AS paid FROM final""",
)
def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = invoices(spark, sf_dir).groupBy("user_id").agg(F.round(F.sum("invoice.amount").cast("double"), 2).alias("paid"))
    return states(spark, sf_dir).select("user_id", "plan").join(paid, "user_id")


@query(
    "event_trail",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, least(100, (100 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) // count(*) OVER (PARTITION BY user_id)) AS percent,
  upper(left(event_type, 1)) || substr(event_type, 2) AS label FROM events""",
)
def event_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by number, with the progress they mark."""
    user = W.partitionBy("user_id")
    place = F.row_number().over(user.orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", place.alias("place"), F.count("*").over(user).alias("n"))
    return rows.select("user_id", "event_id", "place", F.least(F.lit(100), F.expr("(100 * place) div n")).alias("percent"), S.capitalised("event_type").alias("label"))


@query(
    "label_lookup",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'Clicked' WHEN event_type = 'view' THEN 'Viewed' WHEN event_id % 2 = 0 THEN 'Other' END AS label FROM events""",
)
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label by key, then by a fallback key: a map looked up twice."""
    labels = F.create_map(*[F.lit(x) for x in ("click", "Clicked", "view", "Viewed", "0", "Other")])
    fallback = (F.col("event_id") % 2).cast("string")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(labels, F.col("event_type")), F.try_element_at(labels, fallback)).alias("label"))
