"""Streams against their batch forms."""

import datetime

import pytest
from pyspark.sql import functions as F

from kitwright.operators import history, slots
from kitwright.plans.accounts import OPENED, actions
from kitwright.sources.tables import table
from kitwright.streaming import billing_stream, ordered, slot_stream

COLUMNS = ["user_id", "ts", "seq", "action", "plan", "interval"]
SCHEMA = "user_id long, ts timestamp, seq long, action string, plan string, interval string"


@pytest.fixture()
def store(spark):
    for k, v in ordered.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in ordered.STORE:
        spark.conf.unset(k)


def run(spark, rows, folder, name, schema=SCHEMA):
    """The rows of the stream over the files of ``folder``, one file a batch."""
    stream = rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    q = stream.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{folder}-c").trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None
    return spark.table(name).collect()


def written(spark, batches, folder):
    """One file for each batch, in that order of time of writing."""
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/part={i:03d}")
    return folder


def latest(rows):
    out = {}
    for r in rows:
        if r.user_id not in out or r.since >= out[r.user_id].since:
            out[r.user_id] = r
    return out


def test_stream_out_of_order_equals_batch(spark, store, tmp_path):
    """Three batches whose times overlap; a last event moves the watermark beyond them all."""
    events = actions(spark, "/root/testdata/sf0.001").select(COLUMNS).cache()
    third = F.pmod(F.xxhash64("seq"), F.lit(3))
    end = events.agg(F.max("ts")).first()[0] + datetime.timedelta(days=400)
    last = spark.createDataFrame([(-1, end, 0, "none", None, None)], SCHEMA)
    batches = [events.filter(third == k) for k in range(3)] + [last, last.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))]
    folder = written(spark, batches, f"{tmp_path}/in")
    rows = run(spark, lambda e: billing_stream.replay_stream(e, OPENED, "365 days"), folder, "billing_now")
    passed = F.lit(end - datetime.timedelta(days=365))
    want = history.states(events, F.lit(OPENED).cast("timestamp"), passed)
    want = {r.user_id: (r.plan, r.interval, r.cancel_at_period_end, r.period_end_at, r.has_card, r.n_invoices) for r in want.collect()}
    got = {u: (r.plan, r.interval, r.cancels, r.period_end, r.has_card, r.n_invoices) for u, r in latest(rows).items() if u >= 0}
    assert got == want and any(v[0] == "free" for v in want.values())


def test_a_plan_ends_by_its_timer(spark, store, tmp_path):
    """One user cancels and has no further event; another resumes; a third's events come in the wrong order."""
    at = lambda day, month=1: datetime.datetime(2024, month, day)
    first = [(1, at(5), 1, "cancel", None, None), (2, at(5), 1, "cancel", None, None), (3, at(9), 2, "resume", None, None)]
    second = [(2, at(6), 2, "resume", None, None), (3, at(8), 1, "cancel", None, None)]
    third = [(9, at(20), 1, "none", None, None)]
    fourth = [(9, at(1, 3), 2, "none", None, None)]
    batches = [spark.createDataFrame(rows, SCHEMA) for rows in (first, second, third, fourth, [(9, at(2, 3), 3, "none", None, None)])]
    rows = run(spark, lambda e: billing_stream.replay_stream(e, "2024-01-01", "10 days"), written(spark, batches, f"{tmp_path}/in"), "billing_ends")
    of = lambda user: [(r.since, r.plan, r.cancels) for r in sorted(rows, key=lambda r: r.since) if r.user_id == user]
    assert of(1) == [(at(5), "pro", True), (at(31), "free", False)]
    assert of(2)[-1][1:] == ("pro", False) and of(3)[-1][1:] == ("pro", False)


def test_a_slot_is_read_once(spark, store, tmp_path):
    """Errors are written and views read, over a stream whose files overlap in time, as in the batch form."""
    error, view = F.col("event_type") == "error", F.col("event_type") == "view"
    events = table(spark, "/root/testdata/sf0.001", "events").select("user_id", "ts", "event_id", "event_type").cache()
    want = {(r.user_id, r.event_id, r.found) for r in slots.reads(events, error, view, 86400.0).collect()}
    plain, held = set(), {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        if r.event_type == "error":
            held[r.user_id] = r
        elif r.event_type == "view":
            e = held.pop(r.user_id, None)
            plain.add((r.user_id, r.event_id, e.event_id if e and (r.ts - e.ts).total_seconds() <= 86400 else None))
    assert want == plain and 0 < sum(f is not None for *_, f in want) < len(want)
    third, end = F.pmod(F.xxhash64("event_id"), F.lit(3)), events.agg(F.max("ts")).first()[0] + datetime.timedelta(days=400)
    last = spark.createDataFrame([(-1, end, 0, "error")], events.schema)
    folder = written(spark, [*(events.filter(third == k) for k in range(3)), last, last.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))], f"{tmp_path}/in")
    rows = run(spark, lambda e: slot_stream.reads_stream(e, error, view, 86400.0, "365 days"), folder, "slot_reads", events.schema)
    assert {(r.user_id, r.event_id, r.found) for r in rows} == want and len(rows) == len(want)
