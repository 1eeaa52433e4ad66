"""Histories in pieces against the fold over a whole history."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from kitwright.operators import billing, history

OPENED, AS_OF = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 9, 1)
ACTIONS = ["change", "change", "cancel", "cancel", "resume", "add_card", "remove_card", "none"]


@pytest.fixture(scope="module")
def events(spark):
    """Short histories, and one that holds a third of all events, many of them within a second."""
    rng = random.Random(2)
    rows = []
    for user in range(60):
        for k in range(rng.randrange(1, 25)):
            ts = OPENED + datetime.timedelta(hours=rng.randrange(24 * 230))
            rows.append((user, ts, k, rng.choice(ACTIONS), rng.choice(["free", "pro", "team"]), rng.choice(["monthly", "yearly"])))
    for k in range(len(rows) // 2):
        ts = OPENED + datetime.timedelta(days=rng.randrange(230), seconds=rng.randrange(3))
        rows.append((99, ts, k, rng.choice(ACTIONS), rng.choice(["free", "free", "pro", "team"]), rng.choice(["monthly", "yearly"])))
    return spark.createDataFrame(rows, "user_id long, ts timestamp, seq long, action string, plan string, interval string").repartition(4).cache()


@pytest.mark.parametrize("whole", [0, 5, 4096])
def test_states_equal_the_fold(events, whole):
    """Cut up everywhere, in part, and nowhere."""
    want = billing.replay(events, F.lit(OPENED), F.lit(AS_OF)).withColumn("n_invoices", F.size("invoices").cast("long")).drop("invoices")
    got = history.states(events, F.lit(OPENED), F.lit(AS_OF), whole=whole).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("whole", [0, 5, 4096])
def test_invoices_equal_the_fold(events, whole):
    want = billing.replay(events, F.lit(OPENED), F.lit(AS_OF)).select("user_id", F.posexplode(F.reverse("invoices")).alias("no", "i"))
    made = {(r.user_id, r.no, r.i) for r in want.collect()}
    # The fold puts the newest first and the seed's four, oldest first, behind them.
    seeds = {(u, 3 - no if no < 4 else no, i) for u, no, i in made}
    got = {(r.user_id, r.no - 1, r.invoice) for r in history.invoices(events, F.lit(OPENED), whole=whole).collect()}
    assert got == seeds and len(got) > 300


def test_summaries_compose(spark):
    """The summary of all is what the summaries of any two parts join to, and does what the fold does to any state."""
    rng = random.Random(9)
    day = lambda: OPENED + datetime.timedelta(days=rng.randrange(60))
    starts = [("free", "monthly", False, None, False, 0), ("free", "monthly", False, None, True, 3)]
    rows = []
    for k in range(400):
        made = sorted((day(), i, rng.choice(ACTIONS[k % 2 * 2 :]), rng.choice(["free", "pro", "team"]), rng.choice(["monthly", "yearly"])) for i in range(rng.randrange(1, 9)))
        state = rng.choice([*starts, ("team", "yearly", rng.random() < 0.5, day(), True, 7)])
        rows.append((k, state, made, rng.randrange(len(made) + 1)))
    table = spark.createDataFrame(rows, f"k int, s {history.STATE}, e array<{history.EVENT}>, cut int")
    total = lambda e: F.aggregate(e, history.nothing(), history.extended)
    one, two = total(F.slice("e", F.lit(1), F.col("cut"))), total(F.slice("e", F.col("cut") + 1, F.lit(99)))
    sums = table.select("k", "e", "s", total(F.col("e")).alias("all"), one.alias("one"), two.alias("two"))
    got = sums.select(
        "k", F.aggregate("e", F.col("s"), history.step).alias("want"), history.applied(F.col("all"), F.col("s")).alias("whole"),
        history.applied(F.col("two"), history.applied(F.col("one"), F.col("s"))).alias("twice"), history.applied(history.joined(F.col("one"), F.col("two")), F.col("s")).alias("joined"),
    )
    for r in got.collect():
        assert r.want == r.whole == r.twice == r.joined, rows[r.k]


def test_no_events(events):
    assert history.states(events.limit(0), F.lit(OPENED), F.lit(AS_OF)).collect() == []
    assert history.invoices(events.limit(0), F.lit(OPENED)).collect() == []
