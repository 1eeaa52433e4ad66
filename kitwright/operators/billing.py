"""Subscriptions: the billing state machine as an ordered fold, and its projections.

A user's events are folded in order of time with ``aggregate`` over a sorted
list. The order matters, so a user is the unit; what a task holds is bounded
by one user's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitwright.functions.scalars import add_months, capitalised, date_label, euro_irish, holds, padded, unlimited, usage_label, usage_percent

# The demo card.
CARD_BRAND, CARD_LAST4 = "VISA", "4242"
INVOICE = "struct<id:string,date:timestamp,description:string,amount:decimal(10,2),status:string>"
STATE = f"struct<plan:string,interval:string,cancel_at_period_end:boolean,period_end_at:timestamp,has_card:boolean,invoices:array<{INVOICE}>,next_invoice_number:int>"


def seed(as_of: Column) -> Column:
    """The record of a user without one: pro, monthly, four invoices, the last of them now."""

    def invoice(k: int) -> Column:
        month_start = F.add_months(F.trunc(as_of, "MM"), k - 3)
        day = F.date_add(month_start, F.dayofmonth(as_of) - 1).cast("timestamp")
        return F.struct(F.concat(F.lit("DEMO-"), padded(F.lit(k + 1))).alias("id"), (as_of if k == 3 else day).alias("date"), F.lit("Pro plan, monthly").alias("description"), F.lit(19).cast("decimal(10,2)").alias("amount"), F.lit("Paid").alias("status"))

    return F.struct(
        F.lit("pro").alias("plan"), F.lit("monthly").alias("interval"), F.lit(False).alias("cancel_at_period_end"), (as_of + F.expr("INTERVAL 30 DAYS")).alias("period_end_at"),
        F.lit(True).alias("has_card"), F.array(*map(invoice, range(4))).alias("invoices"), F.lit(5).alias("next_invoice_number"),
    ).cast(STATE)


def _with(state: Column, **changes: Column) -> Column:
    names = ["plan", "interval", "cancel_at_period_end", "period_end_at", "has_card", "invoices", "next_invoice_number"]
    return F.struct(*[changes.get(n, state[n]).alias(n) for n in names]).cast(STATE)


def expired(state: Column, now: Column) -> Column:
    """A cancelled plan whose period has ended is the free plan; nothing else ever ends."""
    over = holds(state["cancel_at_period_end"] & (state["period_end_at"] <= now))
    free = _with(state, plan=F.lit("free"), interval=F.lit("monthly"), cancel_at_period_end=F.lit(False), period_end_at=F.lit(None))
    return F.when(over, free).otherwise(state)


def step(state: Column, event: Column) -> Column:
    """The state after an event (``ts``, ``action``, ``plan``, ``interval``).

    Actions: ``change``, ``select`` (a change, unless it names the plan and interval
    that hold already), ``cancel``, ``resume``, ``add_card``, ``remove_card``.
    """
    now = event["ts"]
    s = expired(state, now)
    yearly, free = event["interval"] == "yearly", event["plan"] == "free"
    price = F.when(event["plan"] == "team", F.when(yearly, F.lit("470.4")).otherwise("49")).otherwise(F.when(yearly, F.lit("182.4")).otherwise("19")).cast("decimal(10,2)")
    invoice = F.struct(
        F.concat(F.lit("DEMO-"), padded(s["next_invoice_number"])).alias("id"), now.alias("date"), F.concat(capitalised(event["plan"]), F.lit(" plan, "), event["interval"]).alias("description"), price.alias("amount"), F.lit("Paid").alias("status")
    ).cast(INVOICE)
    paid = _with(
        s, plan=event["plan"], interval=event["interval"], cancel_at_period_end=F.lit(False), period_end_at=add_months(now, F.when(yearly, 12).otherwise(1)),
        invoices=F.concat(F.array(invoice), s["invoices"]), next_invoice_number=s["next_invoice_number"] + 1,
    )
    same = (event["plan"] == s["plan"]) & (free | (event["interval"] == s["interval"]))
    change = (event["action"] == "change") | ((event["action"] == "select") & ~holds(same))
    to_free = _with(s, plan=F.lit("free"), interval=F.lit("monthly"), cancel_at_period_end=F.lit(False), period_end_at=F.lit(None))
    return (
        F.when(change & free, to_free)
        .when(change & s["has_card"], paid)
        .when((event["action"] == "cancel") & (s["plan"] != "free"), _with(s, cancel_at_period_end=F.lit(True)))
        .when(event["action"] == "resume", _with(s, cancel_at_period_end=F.lit(False)))
        .when(event["action"] == "add_card", _with(s, has_card=F.lit(True)))
        .when((event["action"] == "remove_card") & (s["plan"] == "free"), _with(s, has_card=F.lit(False)))
        .otherwise(s)
    )


def replay(events: DataFrame, opened: Column, as_of: Column, user: str = "user_id") -> DataFrame:
    """The state of each user at ``as_of`` after their events (``ts``, ``seq``, ``action``, ``plan``, ``interval``)."""
    ordered = F.sort_array(F.collect_list(F.struct("ts", "seq", "action", "plan", "interval")))
    folded = events.groupBy(user).agg(ordered.alias("e")).select(user, F.aggregate("e", seed(opened), step).alias("s"))
    return folded.select(user, expired(F.col("s"), as_of).alias("s")).select(user, "s.*")


def listed(invoices: DataFrame, user: str = "user_id") -> DataFrame:
    """Invoices (``no``, ``invoice``) as shown; the page lists those made later first."""
    i = F.col("invoice")
    return invoices.select(user, "no", i["id"].alias("invoice_id"), date_label(i["date"]).alias("date_text"), i["description"].alias("description"), euro_irish(i["amount"]).alias("amount_text"), i["status"].alias("paid_status"))


def receipts(invoices: DataFrame, name: Column, email: Column, user: str = "user_id") -> DataFrame:
    """A text for each invoice: ``file_name`` and ``body``."""
    rows = invoices.select(user, name.alias("_name"), email.alias("_email"), F.col("invoice").alias("i"))
    lines = [
        F.lit("Demo receipt"), F.concat(F.lit("Invoice: "), "i.id"), F.concat(F.lit("Date: "), date_label("i.date")), F.concat(F.lit("Customer: "), "_name", F.lit(" <"), "_email", F.lit(">")),
        F.concat(F.lit("Description: "), "i.description"), F.concat(F.lit("Amount: "), euro_irish("i.amount")), F.concat(F.lit("Status: "), "i.status"), F.lit(""), F.lit("Demo only. No payment was processed."),
    ]
    return rows.select(user, F.concat(F.col("i.id"), F.lit(".txt")).alias("file_name"), F.concat_ws("\n", *lines).alias("body"))


def write_receipts(receipts: DataFrame, path: str, user: str = "user_id") -> None:
    """Each receipt as a file of its own, in a folder for each user; the session knows the format ``text_files``."""
    rows = receipts.select(F.concat_ws("/", F.col(user).cast("string"), "file_name").alias("file_name"), "body")
    rows.write.format("text_files").mode("append").save(path)


# What the cards say of the plans; the first names the site.
PLAN_COPY = {"free": "Get started with {site}.", "pro": "For hobbyists and small builders.", "team": "For clubs and small companies."}


def plan_cards(plans: DataFrame, current_plan: Column, current_interval: Column, interval: Column, keep: list[str] | None = None, site: str = "Kitwright") -> DataFrame:
    """The plan cards as shown for a choice of interval: copy, badges, price, features and the button's text."""
    plan, yearly = F.col("plan"), interval == "yearly"
    is_current = plan == current_plan
    amount = lambda c: F.when(unlimited(c), "Unlimited").otherwise(F.col(c).cast("decimal(18,0)").cast("string"))
    return plans.select(
        *(keep or []), "plan", F.element_at(F.create_map(*[F.lit(x) for name, words in PLAN_COPY.items() for x in (name, words.format(site=site))]), plan).alias("copy"),
        F.concat_ws(", ", F.when(is_current, "Current plan"), F.when(plan == "team", "Best for teams")).alias("badges"),
        euro_irish(F.when(plan == "free", F.lit(0)).when(yearly, F.col("yearly_monthly")).otherwise(F.col("monthly"))).alias("price_text"),
        F.when(plan == "free", "Free forever").when(yearly, F.concat(euro_irish("yearly_total"), F.lit(" billed yearly"))).alias("note"),
        F.concat(F.col("ai_builds").cast("decimal(18,0)").cast("string"), F.lit(" AI builds / month")).alias("feature_1"),
        F.concat(amount("saved_builds"), F.lit(" saved builds")).alias("feature_2"),
        F.concat(amount("exports"), F.lit(" parts list exports")).alias("feature_3"),
        F.col("support").alias("feature_4"),
        F.when(is_current, "Current plan").when(plan == "free", "Cancel subscription").when((plan == "pro") & (current_plan == "team"), "Switch to Pro").otherwise(F.concat(F.lit("Upgrade to "), "plan_name")).alias("button"),
        (is_current & ((plan == "free") | (interval == current_interval))).alias("disabled"),
    )


def usage_meters(states: DataFrame, plans: DataFrame, usage: dict[str, Column]) -> DataFrame:
    """``<meter>_text`` and ``<meter>_percent`` of each meter in ``usage`` against the limits of the row's plan."""
    joined = states.join(plans.select("plan", *usage), "plan")
    shown = [x for m, v in usage.items() for x in (usage_label(v, m).alias(f"{m}_text"), usage_percent(v, m).alias(f"{m}_percent"))]
    return joined.select(*[c for c in states.columns], *shown)
