"""Queries on accounts and subscriptions, and on the scalar functions.

A user's events are the ``events`` table: a purchase changes the plan (team
from a value of 50, yearly for even ids), a signup adds the card, an error
cancels, a view resumes, a click does nothing. Accounts open on
``OPENED``; states are as of ``AS_OF``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kitwright.functions import scalars as S
from kitwright.operators import billing, history
from kitwright.plans.registry import query
from kitwright.sources import catalog
from kitwright.sources.catalog import PLANS_SQL
from kitwright.sources.tables import table

OPENED, AS_OF = "2024-01-01 00:00:00", "2024-03-15 00:00:00"


def _at(text: str) -> F.Column:
    return F.lit(text).cast("timestamp")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"purchase": "change", "signup": "add_card", "error": "cancel", "view": "resume"}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.coalesce(kind[F.col("event_type")], F.lit("none")).alias("action"),
        F.when(F.col("value") >= 50, "team").otherwise("pro").alias("plan"), F.when(F.col("event_id") % 2 == 0, "yearly").otherwise("monthly").alias("interval"),
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.states(actions(spark, sf_dir), _at(OPENED), _at(AS_OF))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.invoices(actions(spark, sf_dir), _at(OPENED))


#: The state by windows instead of a fold: what counts is each user's last purchase, and after it the last cancel or
#: resume before the period's end. Cards are never removed here, so every purchase succeeds.
STATES_SQL = f"""e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN value >= 50 THEN 'team' ELSE 'pro' END AS plan, CASE WHEN event_id % 2 = 0 THEN 'yearly' ELSE 'monthly' END AS "interval" FROM events),
users AS (SELECT DISTINCT user_id FROM e),
bought AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n FROM e WHERE event_type = 'purchase'),
base AS (SELECT u.user_id, coalesce(b.plan, 'pro') AS plan, coalesce(b."interval", 'monthly') AS "interval", coalesce(b.n, 0) AS n, b.ts AS since, coalesce(b.event_id, -1) AS since_id,
  CASE WHEN b.ts IS NULL THEN TIMESTAMP '{OPENED}' + INTERVAL 30 DAY ELSE
    CAST(CAST(date_trunc('month', b.ts) + CASE WHEN b."interval" = 'yearly' THEN INTERVAL 12 MONTH ELSE INTERVAL 1 MONTH END AS DATE) + (day(b.ts) - 1)::INT AS TIMESTAMP) + (b.ts - date_trunc('day', b.ts)) END AS ends
  FROM users u LEFT JOIN bought b ON b.user_id = u.user_id AND b.back = 1),
flags AS (SELECT b.user_id, arg_max(e.event_type, (e.ts, e.event_id)) FILTER (WHERE e.ts < ends) AS before_end, arg_max(e.event_type, (e.ts, e.event_id)) AS last_flag
  FROM base b JOIN e ON e.user_id = b.user_id AND e.event_type IN ('error', 'view') AND (since IS NULL OR (e.ts, e.event_id) > (since, since_id)) GROUP BY b.user_id),
states AS (SELECT user_id, n,
  ends <= TIMESTAMP '{AS_OF}' AND coalesce(before_end = 'error', false) OR (ends <= TIMESTAMP '{AS_OF}' AND coalesce(last_flag = 'error', false)) AS is_over, plan, "interval", ends, coalesce(last_flag = 'error', false) AS last_cancel
  FROM base LEFT JOIN flags USING (user_id)),
final AS (SELECT user_id, CASE WHEN is_over THEN 'free' ELSE plan END AS plan, CASE WHEN is_over THEN 'monthly' ELSE "interval" END AS plan_interval, NOT is_over AND last_cancel AS cancels, CASE WHEN NOT is_over THEN ends END AS period_end_at, n FROM states)"""


@query("billing_states", f"WITH {STATES_SQL} SELECT user_id, plan, plan_interval, cancels, period_end_at, (4 + n)::INT AS n_invoices, (5 + n)::INT AS next_invoice FROM final")
def billing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select(
        "user_id", "plan", F.col("interval").alias("plan_interval"), F.col("cancel_at_period_end").alias("cancels"), "period_end_at", F.col("n_invoices").cast("int"), F.col("next_invoice_number").cast("int").alias("next_invoice")
    )


_INVOICES = f"""WITH b AS (SELECT user_id, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'purchase'),
u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events GROUP BY user_id),
rows AS (
  SELECT user_id, k + 4 AS no, 'DEMO-' || CASE WHEN k + 4 < 10000 THEN lpad((k + 4)::VARCHAR, 4, '0') ELSE (k + 4)::VARCHAR END AS invoice_id, ts AS d,
    CASE WHEN value >= 50 THEN 'Team' ELSE 'Pro' END || ' plan, ' || CASE WHEN event_id % 2 = 0 THEN 'yearly' ELSE 'monthly' END AS description,
    CASE WHEN value >= 50 THEN CASE WHEN event_id % 2 = 0 THEN '€470.40' ELSE '€49.00' END ELSE CASE WHEN event_id % 2 = 0 THEN '€182.40' ELSE '€19.00' END END AS amount_text FROM b
  UNION ALL SELECT user_id, i + 1, 'DEMO-000' || (i + 1), TIMESTAMP '{OPENED}' - INTERVAL (3 - i) MONTH, 'Pro plan, monthly', '€19.00' FROM u, range(4) r(i))"""


@query("billing_invoices", f"{_INVOICES} SELECT user_id, no, invoice_id, strftime(d, '%b %-d, %Y') AS date_text, description, amount_text, 'Paid' AS paid_status FROM rows")
def billing_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.listed(invoices(spark, sf_dir))


@query(
    "billing_receipts",
    f"""{_INVOICES} SELECT user_id, invoice_id || '.txt' AS file_name, md5(concat_ws(chr(10), 'Demo receipt', 'Invoice: ' || invoice_id, 'Date: ' || strftime(d, '%b %-d, %Y'), 'Customer: User ' || user_id || ' <u' || user_id || '@example.com>',
  'Description: ' || description, 'Amount: ' || amount_text, 'Status: Paid', '', 'Demo only. No payment was processed.')) AS body_md5 FROM rows""",
)
def billing_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, email = F.concat(F.lit("User "), F.col("user_id")), F.concat(F.lit("u"), F.col("user_id"), F.lit("@example.com"))
    return billing.receipts(invoices(spark, sf_dir), name, email).select("user_id", "file_name", F.md5("body").alias("body_md5"))


@query(
    "billing_selections",
    """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN value >= 50 THEN 'team' ELSE 'pro' END AS plan, CASE WHEN event_id % 2 = 0 THEN 'yearly' ELSE 'monthly' END AS term FROM events WHERE event_type = 'purchase'),
p AS (SELECT *, lag(plan, 1, 'pro') OVER w AS old_plan, lag(term, 1, 'monthly') OVER w AS old_term FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, arg_max(plan, (ts, event_id)) AS plan, arg_max(term, (ts, event_id)) AS plan_interval, count(*) FILTER (WHERE plan <> old_plan OR term <> old_term)::INT AS n_changes FROM p GROUP BY user_id""",
)
def billing_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases alone, as choices on the page: one that names the plan and interval in force makes no invoice."""
    chosen = actions(spark, sf_dir).filter("action = 'change'").withColumn("action", F.lit("select"))
    after = billing.replay(chosen, _at(OPENED), _at(AS_OF))
    return after.select("user_id", "plan", F.col("interval").alias("plan_interval"), (F.col("next_invoice_number") - 5).alias("n_changes"))


@query(
    "usage_meters",
    f"""WITH {STATES_SQL}, {PLANS_SQL} SELECT user_id, plan,
  (user_id % 150) || ' / ' || ai_builds::INT AS ai_builds_text, least(100.0::DOUBLE, (user_id % 150)::DOUBLE / ai_builds * 100) AS ai_builds_percent,
  (user_id % 60) || ' / ' || CASE WHEN isinf(saved_builds) THEN 'Unlimited' ELSE saved_builds::DECIMAL(18, 0)::VARCHAR END AS saved_builds_text, CASE WHEN isinf(saved_builds) THEN 100.0::DOUBLE ELSE least(100.0::DOUBLE, (user_id % 60)::DOUBLE / saved_builds * 100) END AS saved_builds_percent,
  (user_id % 25) || ' / ' || CASE WHEN isinf(exports) THEN 'Unlimited' ELSE exports::DECIMAL(18, 0)::VARCHAR END AS exports_text, CASE WHEN isinf(exports) THEN 100.0::DOUBLE WHEN exports = 0 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, (user_id % 25)::DOUBLE / exports * 100) END AS exports_percent
FROM final JOIN plans USING (plan)""",
)
def usage_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    used = {"ai_builds": user % 150, "saved_builds": user % 60, "exports": user % 25}
    return billing.usage_meters(states(spark, sf_dir).select("user_id", "plan"), catalog.plans(spark), used)


@query(
    "plan_cards",
    f"""WITH {PLANS_SQL}, c AS (SELECT c_custkey, ['team', 'free', 'pro'][(c_custkey % 3 + 1)::INT] AS current_plan, CASE WHEN c_custkey % 3 <> 1 AND c_custkey % 2 = 0 THEN 'yearly' ELSE 'monthly' END AS current_interval, CASE WHEN c_custkey % 5 < 2 THEN 'yearly' ELSE 'monthly' END AS shown FROM customer)
SELECT c_custkey, current_plan, shown, plan, CASE plan WHEN 'free' THEN 'Get started with Kitwright.' WHEN 'pro' THEN 'For hobbyists and small builders.' ELSE 'For clubs and small companies.' END AS copy,
  array_to_string(list_filter([CASE WHEN plan = current_plan THEN 'Current plan' END, CASE WHEN plan = 'team' THEN 'Best for teams' END], lambda x: x IS NOT NULL), ', ') AS badges,
  '€' || format('{{:.2f}}', CASE WHEN plan = 'free' THEN 0.0::DOUBLE WHEN shown = 'yearly' THEN yearly_monthly::DOUBLE ELSE monthly::DOUBLE END) AS price_text,
  CASE WHEN plan = 'free' THEN 'Free forever' WHEN shown = 'yearly' THEN '€' || format('{{:.2f}}', yearly_total::DOUBLE) || ' billed yearly' END AS note,
  ai_builds::INT || ' AI builds / month' AS feature_1, CASE WHEN isinf(saved_builds) THEN 'Unlimited' ELSE saved_builds::DECIMAL(18, 0)::VARCHAR END || ' saved builds' AS feature_2,
  CASE WHEN isinf(exports) THEN 'Unlimited' ELSE exports::DECIMAL(18, 0)::VARCHAR END || ' parts list exports' AS feature_3, support AS feature_4,
  CASE WHEN plan = current_plan THEN 'Current plan' WHEN plan = 'free' THEN 'Cancel subscription' WHEN plan = 'pro' AND current_plan = 'team' THEN 'Switch to Pro' ELSE 'Upgrade to ' || plan_name END AS button,
  plan = current_plan AND (plan = 'free' OR shown = current_interval) AS disabled
FROM plans, c""",
)
def plan_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three cards as each customer sees them, by the plan they have and the interval they look at."""
    k = F.col("c_custkey")
    plan = F.get(F.array(F.lit("team"), F.lit("free"), F.lit("pro")), (k % 3).cast("int"))
    seen = table(spark, sf_dir, "customer").select(
        "c_custkey", plan.alias("current_plan"), F.when((k % 3 != 1) & (k % 2 == 0), "yearly").otherwise("monthly").alias("current_interval"), F.when(k % 5 < 2, "yearly").otherwise("monthly").alias("shown")
    )
    each = seen.crossJoin(catalog.plans(spark))  # three rows
    return billing.plan_cards(each, F.col("current_plan"), F.col("current_interval"), F.col("shown"), ["c_custkey", "current_plan", "shown"])


@query(
    "month_arithmetic",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) + (day(o_orderdate) - 1)::INT AS next_month, CAST(date_trunc('month', o_orderdate) + INTERVAL 12 MONTH AS DATE) + (day(o_orderdate) - 1)::INT AS next_year,
  strftime(o_orderdate, '%b %-d, %Y') AS label, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso_text FROM orders""",
)
def month_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date(S.add_months(d, 1)).alias("next_month"), F.to_date(S.add_months(d, 12)).alias("next_year"), S.date_label(d).alias("label"), S.iso(d).alias("iso_text")
    )


@query(
    "money_texts",
    """SELECT o_orderkey, translate(format('{:,.2f}', round(o_totalprice::DECIMAL(20, 6), 2)::DOUBLE), ',.', '.,') || chr(160) || '€' AS german, '€' || format('{:,.2f}', round(o_totalprice::DECIMAL(20, 6), 2)::DOUBLE) AS irish,
  '-€' || format('{:,.2f}', round(o_totalprice::DECIMAL(20, 6), 2)::DOUBLE) AS irish_negative, '$' || format('{:,}', o_orderkey) AS us, floor(o_totalprice + 0.5)::BIGINT AS rounded, floor(0.5 - o_totalprice)::BIGINT AS rounded_negative,
  CASE WHEN o_orderkey < 10000 THEN lpad(o_orderkey::VARCHAR, 4, '0') ELSE o_orderkey::VARCHAR END AS padded FROM orders""",
)
def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.euro_german(price).alias("german"), S.euro_irish(price).alias("irish"), S.euro_irish(-price).alias("irish_negative"), S.dollars("o_orderkey").alias("us"),
        S.round_half_up(price).alias("rounded"), S.round_half_up(-price).alias("rounded_negative"), S.padded("o_orderkey").alias("padded"),
    )


@query(
    "account_texts",
    """WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' ' || c_name || chr(9) WHEN 1 THEN ' ' END AS name, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' c' || c_custkey || '@example.com ' WHEN 2 THEN 'c@' || c_custkey ELSE 'c' || c_custkey || '@a.b' END AS email FROM customer)
SELECT c_custkey, coalesce(nullif(trim(name, ' ' || chr(9)), ''), nullif(split_part(email, '@', 1), ''), 'Pilot') AS display_name, upper(left(coalesce(nullif(name, ''), nullif(email, ''), '?'), 1)) AS initial,
  regexp_full_match(trim(email), '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') AS valid_email,
  CASE WHEN c_custkey % 5 = 0 THEN 'Please confirm your email first. Check your inbox.' WHEN c_custkey % 5 IN (1, 2) THEN 'Could not reach the sign-in service. Check your connection and try again.' ELSE 'Email or password is incorrect.' END AS sign_in_text,
  CASE WHEN c_custkey % 2 = 0 THEN 'signup' END AS search_mode, upper(left(c_mktsegment, 1)) || substr(c_mktsegment, 2) AS capitalised, c_custkey % 7 >= 2 AND c_custkey % 3 <> 1 AS password_ok
FROM c JOIN customer USING (c_custkey)""",
)
def account_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment",
        F.when(key % 3 == 0, F.concat(F.lit(" "), "c_name", F.lit("\t"))).when(key % 3 == 1, " ").alias("name"),
        F.when(key % 4 == 0, "").when(key % 4 == 1, F.concat(F.lit(" c"), key, F.lit("@example.com "))).when(key % 4 == 2, F.concat(F.lit("c@"), key)).otherwise(F.concat(F.lit("c"), key, F.lit("@a.b"))).alias("email"),
        F.when(key % 5 == 0, "email_not_confirmed").alias("code"),
        F.when(key % 5 == 1, "Failed to FETCH").when(key % 5 == 2, "Network down").alias("message"),
        F.when(key % 2 == 0, "signup").otherwise("admin").alias("mode"),
        F.repeat(F.lit("x"), (6 + key % 7).cast("int")).alias("password"),
        F.repeat(F.lit("x"), (6 + key % 7 + (key % 3 == 1).cast("int")).cast("int")).alias("again"),
    )
    return c.select(
        "c_custkey", S.display_name("name", "email").alias("display_name"), S.initial("name", "email").alias("initial"), S.is_email("email").alias("valid_email"), S.sign_in_error("code", "message").alias("sign_in_text"),
        S.one_of("mode", ["signin", "signup"]).alias("search_mode"), S.capitalised("c_mktsegment").alias("capitalised"), S.acceptable_password("password", "again").alias("password_ok"),
    )
