"""Subscriptions with histories of any length: states and invoices without a user's events in one task.

A user with up to ``WHOLE`` events is folded in one piece. The events of others
are cut by time, and what a stretch of events does to *any* state is a value of
fixed size (``SUMMARY``), so stretches are summed side by side, second by
second, and the sums joined level by level (:data:`WIDTHS`). Going back down,
every second gets the state it begins with, and is folded from there; only one
second of a user is ever in one task.

Why a summary has a fixed size: without a card the plan is free, because a card
is only removed on the free plan and only a card pays for another. So what
follows a change of plan depends on one bit, whether there was a card. Up to
the first change a paid plan either stays or ends, and it ends by the first
event after its end that finds it cancelled; whether that happened, and whether
a card was removed after it, are two comparisons of its end with a latest time
each, for either setting of the cancellation that the stretch begins with.

The actions are those of :func:`kitwright.operators.billing.step` but
``select``, which asks for the plan in force and needs the fold over a whole
history (``billing.replay``). Events with a null time are not taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kitwright.functions.scalars import add_months, capitalised, holds, padded
from kitwright.operators.billing import INVOICE, seed

#: Events of a user that are folded in one piece.
WHOLE = 4096
#: Seconds of a stretch of each level: a second, an hour, sixty days. The last level is the user.
WIDTHS = (1, 3600, 60 * 86400)

STATE = "struct<plan:string,interval:string,cancels:boolean,ends:timestamp,has_card:boolean,made:long>"
EVENT = "struct<ts:timestamp,seq:long,action:string,plan:string,interval:string>"
#: ``changed``: whether the plan was asked to change. Up to there: ``over_0`` and ``over_1``, the latest event that finds the
#: plan cancelled, if it was not or was so at the start; ``lost_0`` and ``lost_1``, that of those up to the last removal of a
#: card where no card is added after it; ``flag``, the last cancellation (true) or resumption (false); ``card``, whether the
#: last change of the card adds one. ``bare`` and ``carded``: the state after it all, by the card at the first change.
SUMMARY = f"struct<changed:boolean,over_0:timestamp,over_1:timestamp,lost_0:timestamp,lost_1:timestamp,flag:boolean,card:boolean,bare:{STATE},carded:{STATE}>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _state(plan: Column, interval: Column, cancels: Column, ends: Column, has_card: Column, made: Column) -> Column:
    names = ("plan", "interval", "cancels", "ends", "has_card", "made")
    return F.struct(*[c.alias(n) for n, c in zip(names, (plan, interval, cancels, ends, has_card, made), strict=True)]).cast(STATE)


def _free(has_card: Column, made: Column) -> Column:
    return _state(F.lit("free"), F.lit("monthly"), F.lit(False), F.lit(None), has_card, made)


def _bought(e: Column, made: Column) -> Column:
    return _state(e["plan"], e["interval"], F.lit(False), add_months(e["ts"], F.when(e["interval"] == "yearly", 12).otherwise(1)), F.lit(True), made + 1)


def ended(s: Column, now: Column) -> Column:
    """A cancelled plan whose period has ended is the free plan."""
    return F.when(holds(s["cancels"] & (s["ends"] <= now)), _free(s["has_card"], s["made"])).otherwise(s)


def step(state: Column, e: Column) -> Column:
    """The state after an event; ``made`` counts the purchases."""

    def after(s: Column) -> Column:
        put = lambda **changes: _state(*[changes.get(n, s[n]) for n in ("plan", "interval", "cancels", "ends", "has_card", "made")])
        return (
            F.when((e["action"] == "change") & (e["plan"] == "free"), _free(s["has_card"], s["made"]))
            .when((e["action"] == "change") & s["has_card"], _bought(e, s["made"]))
            .when((e["action"] == "cancel") & (s["plan"] != "free"), put(cancels=F.lit(True)))
            .when(e["action"] == "resume", put(cancels=F.lit(False)))
            .when(e["action"] == "add_card", put(has_card=F.lit(True)))
            .when((e["action"] == "remove_card") & (s["plan"] == "free"), put(has_card=F.lit(False)))
            .otherwise(s)
        )

    return _let(ended(state, e["ts"]), after)


def nothing() -> Column:
    """The summary of no event."""
    none = F.lit(None)
    return F.struct(F.lit(False), *[none] * 8).cast(SUMMARY)


def extended(summary: Column, e: Column) -> Column:
    """The summary of a stretch and one more event."""

    def after(a: Column) -> Column:
        over = [F.when(F.coalesce(a["flag"], F.lit(c)), F.greatest(a[f"over_{int(c)}"], e["ts"])).otherwise(a[f"over_{int(c)}"]) for c in (False, True)]
        removes, changes = e["action"] == "remove_card", e["action"] == "change"
        lost = [F.when(removes, o).when(e["action"] != "add_card", a[f"lost_{c}"]) for c, o in enumerate(over)]
        flag = F.when(e["action"] == "cancel", True).when(e["action"] == "resume", False).otherwise(a["flag"])
        card = F.when(e["action"] == "add_card", True).when(removes, False).otherwise(a["card"])
        none = F.lit(0).cast("long")
        first = [_free(F.lit(bit), none) for bit in (False, True)]
        first[1] = F.when(e["plan"] == "free", first[1]).otherwise(_bought(e, none))
        head = F.struct(changes, *over, *lost, flag, card, *[F.when(changes, s) for s in first]).cast(SUMMARY)
        later = F.struct(*[a[n] for n in ("changed", "over_0", "over_1", "lost_0", "lost_1", "flag", "card")], step(a["bare"], e), step(a["carded"], e)).cast(SUMMARY)
        return F.when(a["changed"], later).otherwise(head)

    return _let(summary, after)


def applied(b: Column, state: Column) -> Column:
    """The state after the stretch that ``b`` sums up."""

    def after(s: Column) -> Column:
        paid = s["plan"] != "free"
        pick = lambda name: F.when(s["cancels"], b[f"{name}_1"]).otherwise(b[f"{name}_0"])
        over, lost = paid & holds(s["ends"] <= pick("over")), paid & holds(s["ends"] <= pick("lost"))
        card = F.when(paid, ~lost).otherwise(F.coalesce(b["card"], s["has_card"]))

        def with_card(has_card: Column) -> Column:
            result = F.when(has_card, b["carded"]).otherwise(b["bare"])
            moved = _let(result, lambda r: _state(r["plan"], r["interval"], r["cancels"], r["ends"], r["has_card"], r["made"] + s["made"]))
            stays = _state(s["plan"], s["interval"], F.coalesce(b["flag"], s["cancels"]), s["ends"], s["has_card"], s["made"])
            return F.when(b["changed"], moved).when(over | ~paid, _free(has_card, s["made"])).otherwise(stays)

        return _let(card, with_card)

    return _let(state, after)


def joined(one: Column, two: Column) -> Column:
    """The summary of two stretches, one after the other."""

    def after(a: Column) -> Column:
        flags = [F.coalesce(a["flag"], F.lit(c)) for c in (False, True)]
        pick = lambda name, flag: F.when(flag, two[f"{name}_1"]).otherwise(two[f"{name}_0"])
        over = [F.greatest(a[f"over_{c}"], pick("over", f)) for c, f in enumerate(flags)]
        # Removed in the second stretch: what the first has that finds the plan cancelled comes before it.
        lost = [F.when(two["card"].isNull(), a[f"lost_{c}"]).when(~two["card"], F.greatest(a[f"over_{c}"], pick("lost", f))) for c, f in enumerate(flags)]
        head = F.struct(two["changed"], *over, *lost, F.coalesce(two["flag"], a["flag"]), F.coalesce(two["card"], a["card"]), two["bare"], two["carded"]).cast(SUMMARY)
        later = F.struct(*[a[n] for n in ("changed", "over_0", "over_1", "lost_0", "lost_1", "flag", "card")], applied(two, a["bare"]), applied(two, a["carded"])).cast(SUMMARY)
        return F.when(a["changed"], later).otherwise(head)

    return _let(one, after)


def opening(opened: Column) -> Column:
    """The state of a user without events; its four invoices are not among those ``made``."""
    s = seed(opened)
    return _state(s["plan"], s["interval"], s["cancel_at_period_end"], s["period_end_at"], s["has_card"], F.lit(0).cast("long"))


def _events(events: DataFrame, user: str) -> DataFrame:
    return events.filter("ts is not null").select(F.col(user).alias("user"), F.struct(F.col("ts").cast("timestamp"), F.col("seq").cast("long"), "action", "plan", "interval").cast(EVENT).alias("e"))


def _split(events: DataFrame, whole: int) -> tuple[DataFrame, DataFrame | None]:
    """The events of users with up to ``whole`` of them, and the others'; None if there are no others, which is looked up at once."""
    counts = events.groupBy("user").agg(F.count("*").alias("_n"))  # map-side first
    many = counts.filter(F.col("_n") > whole).select("user")
    if many.isEmpty():
        return events, None
    return events.join(many, "user", "left_anti"), events.join(many, "user", "left_semi")


def _key(width: int) -> Column:
    return F.floor(F.unix_seconds(F.col("e.ts")) / width).cast("long")


def _levels(long: DataFrame) -> list[DataFrame]:
    """By level, ``user``, ``key`` (null for the user), ``parts`` (events, or the keys and summaries of the level below, in order) and ``sum``."""
    parts = F.sort_array(F.collect_list("e"))  # of one second
    level = long.groupBy("user", _key(WIDTHS[0]).alias("key")).agg(parts.alias("parts")).withColumn("sum", F.aggregate("parts", nothing(), extended))
    levels = [level]
    for below, width in zip(WIDTHS, (*WIDTHS[1:], None), strict=True):
        key = F.lit(None).cast("long") if width is None else F.floor(F.col("key") * below / width).cast("long")
        # By key, which no two parts share; of 3,600, 1,440, and some sixty a decade.
        listed = F.array_sort(F.collect_list(F.struct("key", "sum")), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
        level = levels[-1].groupBy("user", key.alias("above")).agg(listed.alias("parts")).withColumnRenamed("above", "key")
        levels.append(level.withColumn("sum", F.aggregate("parts", nothing(), lambda a, p: joined(a, p["sum"]))))
    return levels


def _entries(levels: list[DataFrame], opened: Column) -> DataFrame:
    """``user``, ``events`` and ``entry``, the state before them, of each second."""
    known = levels[-1].select("user", "parts", opening(opened).alias("entry"))
    walked = f"struct<now:{STATE},out:array<struct<key:bigint,entry:{STATE}>>>"
    for level in reversed(levels[:-1]):
        walk = F.aggregate(
            "parts", F.struct(F.col("entry"), F.array()).cast(walked),
            lambda a, p: F.struct(applied(p["sum"], a["now"]), F.concat(a["out"], F.array(F.struct(p["key"].alias("key"), a["now"].alias("entry"))))).cast(walked),
        )
        starts = known.select("user", F.explode(walk["out"]).alias("p")).select("user", "p.key", "p.entry")
        known = level.select("user", "key", "parts").join(starts, ["user", "key"]).select("user", "parts", "entry")
    return known.withColumnRenamed("parts", "events")


def states(events: DataFrame, opened: Column, as_of: Column, user: str = "user_id", whole: int = WHOLE) -> DataFrame:
    """The state of each user at ``as_of``: ``plan``, ``interval``, ``cancel_at_period_end``, ``period_end_at``, ``has_card``, ``n_invoices``, ``next_invoice_number``."""
    few, many = _split(_events(events, user), whole)
    short = few.groupBy("user").agg(F.sort_array(F.collect_list("e")).alias("events")).select("user", F.aggregate("events", opening(opened), step).alias("s"))
    if many is not None:
        short = short.unionByName(_levels(many)[-1].select("user", applied(F.col("sum"), opening(opened)).alias("s")))
    s = F.col("s")
    rows = short.select("user", ended(s, as_of).alias("s"))
    return rows.select(
        F.col("user").alias(user), s["plan"].alias("plan"), s["interval"].alias("interval"), s["cancels"].alias("cancel_at_period_end"), s["ends"].alias("period_end_at"), s["has_card"].alias("has_card"),
        (s["made"] + 4).alias("n_invoices"), (s["made"] + 5).alias("next_invoice_number"),
    )


def invoices(events: DataFrame, opened: Column, user: str = "user_id", whole: int = WHOLE) -> DataFrame:
    """Every user's invoices, one a row: ``invoice`` and ``no`` (from 1 in order of making, the seed's four first)."""
    few, many = _split(_events(events, user), whole)
    short = few.groupBy("user").agg(F.sort_array(F.collect_list("e")).alias("events")).select("user", "events", opening(opened).alias("entry"))
    pieces = short if many is None else short.unionByName(_entries(_levels(many), opened))
    paid = lambda e: (e["action"] == "change") & (e["plan"] != "free")
    # What a piece makes is its purchases but those without a card; these are noted by place, as they are few.
    walked = f"struct<now:{STATE},at:int,missed:array<int>>"

    def go(a: Column, e: Column) -> Column:
        def after(now: Column) -> Column:
            failed = paid(e) & (now["made"] == a["now"]["made"])
            return F.struct(now, a["at"] + 1, F.when(failed, F.concat(a["missed"], F.array(a["at"]))).otherwise(a["missed"])).cast(walked)

        return _let(step(a["now"], e), after)

    walk = F.aggregate("events", F.struct(F.col("entry"), F.lit(0), F.array()).cast(walked), go)
    made = F.filter("events", lambda e, i: paid(e) & ~F.array_contains("missed", i))
    rows = pieces.select("user", "entry.made", "events", walk["missed"].alias("missed")).select("user", "made", F.posexplode(made).alias("i", "e"))
    e, yearly = F.col("e"), F.col("e.interval") == "yearly"
    price = F.when(e["plan"] == "team", F.when(yearly, F.lit("470.4")).otherwise("49")).otherwise(F.when(yearly, F.lit("182.4")).otherwise("19")).cast("decimal(10,2)")
    no = F.col("made") + F.col("i") + 5
    bought = F.struct(F.concat(F.lit("DEMO-"), padded(no)), e["ts"], F.concat(capitalised(e["plan"]), F.lit(" plan, "), e["interval"]), price, F.lit("Paid")).cast(INVOICE)
    first = _events(events, user).select("user").distinct().select("user", F.posexplode(seed(opened)["invoices"]).alias("i", "invoice"))
    return rows.select("user", no.cast("long").alias("no"), bought.alias("invoice")).unionByName(first.select("user", (F.col("i") + 1).cast("long").alias("no"), "invoice")).withColumnRenamed("user", user)
