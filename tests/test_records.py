"""Stored billing records keep what an update does not touch, and writing by key keeps all other keys."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from kitwright.operators import records, selection
from kitwright.sources import manifest, text_files

NOW = datetime.datetime(2024, 3, 15)
RAW = '{"plan":"free","interval":"monthly","cancelAtPeriodEnd":false,"periodEndAt":null,"card":null,"billingEmail":"a@b.ie","usage":{"aiBuilds":9,"savedBuilds":8,"exports":7},"invoices":[{"id":"DEMO-0009","date":"2024-01-02T03:04:05.678Z","description":"Team plan, yearly","amount":470.4,"status":"Paid"}],"nextInvoiceNumber":10}'


def read(spark, rows):
    table = spark.createDataFrame(rows, "user_id long, raw string")
    return records.read(table, "raw", F.lit(NOW), F.lit("new@b.ie"))


def declared(df, *columns):
    """The declared fields in place of each of the record ``columns``."""
    for c in columns or ("record",):
        df = df.withColumn(c, records.fields(F.col(c)))
    return df


def test_reading(spark):
    ended = RAW.replace('"plan":"free"', '"plan":"team"').replace('"cancelAtPeriodEnd":false,"periodEndAt":null', '"cancelAtPeriodEnd":true,"periodEndAt":"2024-03-15T00:00:00.000Z"')
    unknown = ended.replace("2024-03-15T00:00:00.000Z", "someday")
    got = {r.user_id: r for r in declared(read(spark, [(1, RAW), (2, None), (3, "{"), (4, ended), (5, unknown), (6, "null"), (7, "")])).collect()}
    assert [got[k].was_seeded for k in range(1, 8)] == [False, True, True, False, False, True, True]
    one, two, four, five = (got[k].record for k in (1, 2, 4, 5))
    assert (one.card, one.billingEmail, tuple(one.usage), one.invoices[0].date) == (None, "a@b.ie", (9, 8, 7), datetime.datetime(2024, 1, 2, 3, 4, 5, 678000))
    assert (two.plan, tuple(two.card), two.billingEmail, tuple(two.usage), len(two.invoices)) == ("pro", ("VISA", "4242", NOW), "new@b.ie", (4, 15, 6), 4)
    assert (four.plan, four.periodEndAt, four.invoices, tuple(four.usage)) == ("free", None, one.invoices, (9, 8, 7))
    assert (five.plan, five.cancelAtPeriodEnd, five.periodEndAt) == ("team", True, None)


def test_updates(spark):
    record, later = F.col("record"), F.lit(datetime.datetime(2024, 4, 1))
    r = read(spark, [(1, RAW), (2, None)]).select(
        "user_id", records.with_card(record, later).alias("carded"), records.without_card(record).alias("bare"), records.with_email(record, F.lit("")).alias("mailed"), records.with_email(record, F.lit(None).cast("string")).alias("same"), "record"
    )
    one, two = declared(r, "carded", "bare", "mailed", "same", "record").orderBy("user_id").collect()
    assert (one.carded.card.addedAt, two.carded.card.addedAt) == (datetime.datetime(2024, 4, 1), NOW)
    assert (one.bare.card, two.bare.card.last4) == (None, "4242")
    assert (one.mailed.billingEmail, one.same) == ("", one.record)


def test_what_nobody_declared_stays(spark):
    """Unknown fields, odd dates and amounts, and fields of another kind keep their meaning through a read, three changes and a write."""
    odd = {
        "plan": "team", "interval": "fortnightly", "cancelAtPeriodEnd": True, "periodEndAt": "someday", "card": None, "billingEmail": 5, "usage": {"aiBuilds": "many", "flights": [1, {"a": None}]},
        "invoices": [{"id": "X", "date": "yesterday", "amount": "free of charge", "vat": 0.19}, 7], "nextInvoiceNumber": 12345678901234, "note": "ünïcode \" \\ / \n", "deep": {"x": [[], {}, [True, 1.5, -2e-3]]},
    }
    table = read(spark, [(1, json.dumps(odd))])
    record = F.col("record")
    changed = table.withColumn("record", records.with_email(record, F.lit("b@c.ie"))).withColumn("record", records.with_card(record, F.lit(NOW))).withColumn("record", records.without_card(record))
    got = json.loads(changed.select(records.text(record)).first()[0])
    assert got == odd | {"billingEmail": "b@c.ie", "card": {"brand": "VISA", "last4": "4242", "addedAt": "2024-03-15T00:00:00.000Z"}}
    seen = declared(table).first().record
    assert (seen.plan, seen.periodEndAt) == ("team", None)
    ended = json.loads(read(spark, [(1, json.dumps(odd | {"periodEndAt": "2024-01-01T00:00:00Z"}))]).select(records.text(record)).first()[0])
    assert ended == odd | {"plan": "free", "interval": "monthly", "cancelAtPeriodEnd": False, "periodEndAt": None}


def test_writing_by_key(spark, tmp_path):
    root = f"{tmp_path}/store"
    first = read(spark, [(1, RAW), (2, None)])
    records.save(first, root, "first")
    records.save(read(spark, [(2, RAW), (3, RAW)]), root, "second")
    records.save(read(spark, [(1, None)]), root, "second")  # made already
    stored = records.read(manifest.tables(spark, root)["billing"], "raw", F.lit(NOW), F.lit("x"))
    got = {r.user_id: (r.record, r.was_seeded) for r in declared(stored).collect()}
    one = declared(first).filter("user_id = 1").first().record
    assert got == {k: (one, False) for k in (1, 2, 3)}


def test_a_build_and_its_draft_are_one_commit(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/store"
    drafts = spark.createDataFrame([(1, ["frame"], "signedOut"), (2, ["esc"], "signedOut")], "user_id long, part_ids array<string>, status string")
    selection.save_draft(drafts, root, "drafts", F.col("status"))
    builds = spark.createDataFrame([(1, ["frame"], 45)], "user_id long, part_ids array<string>, estimated_total int")
    seen = lambda: {t: sorted(r.user_id for r in rows.collect()) for t, rows in manifest.tables(spark, root).items()}
    # Cut off after the rows are written and before they count: readers see neither change.
    publish = manifest._publish
    monkeypatch.setattr(manifest, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        selection.save(builds, root, "build 1")
    assert seen() == {"drafts": [1, 2]}
    monkeypatch.setattr(manifest, "_publish", publish)
    for _ in range(2):  # the retry, and a second retry of what was made
        selection.save(builds, root, "build 1")
        assert seen() == {"drafts": [2], "builds": [1]}
    selection.save(builds, root, "build 2")
    assert seen() == {"drafts": [2], "builds": [1, 1]} and manifest.tables(spark, root)["builds"].select("id").distinct().count() == 2


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(folder) for f in fs}


def test_text_files(spark, tmp_path):
    """Contents as given; a failed job leaves nothing; an existing folder stays unless it is to be overwritten."""
    text_files.register(spark)
    rows = spark.range(40).selectExpr("concat(id % 7, '/', id, '.txt') as file_name", "concat('line ', id, '\n–') as body").repartition(3)
    rows.write.format("text_files").mode("append").save(f"{tmp_path}/out")
    want = {r.file_name: r.body for r in rows.collect()}
    assert {k.split("/", 1)[1]: v for k, v in files(f"{tmp_path}/out").items()} == want
    for mode, bad in (("append", rows), ("overwrite", rows.withColumn("body", F.when(F.col("file_name") == "3/17.txt", F.raise_error(F.lit("no"))).otherwise(F.col("body")))), ("overwrite", rows.withColumn("file_name", F.lit("../x")))):
        with pytest.raises(Exception):
            bad.write.format("text_files").mode(mode).save(f"{tmp_path}/out")
        assert os.listdir(tmp_path) == ["out"] and len(files(f"{tmp_path}/out")) == 40
    rows.limit(1).write.format("text_files").mode("overwrite").save(f"{tmp_path}/out")
    assert len(files(f"{tmp_path}/out")) == 1 and os.listdir(tmp_path) == ["out"]


def test_receipts_as_files(spark, tmp_path):
    from kitwright.operators import billing
    from kitwright.plans.accounts import invoices

    text_files.register(spark)
    made = billing.receipts(invoices(spark, "/root/testdata/sf0.001"), F.lit("Ann"), F.lit("a@b.ie"))
    billing.write_receipts(made, f"{tmp_path}/receipts")
    got = {k.split("/", 1)[1]: v for k, v in files(f"{tmp_path}/receipts").items()}
    assert got == {f"{r.user_id}/{r.file_name}": r.body for r in made.collect()}


def test_builds_as_files(spark, tmp_path):
    """As ``JSON.stringify(build, null, 2)`` writes them, which Python's ``json`` does too."""
    from kitwright.operators import configure
    from kitwright.sources import catalog

    text_files.register(spark)
    picks = spark.createDataFrame([(1, "frame", "frame5"), (1, "esc", "esc"), (2, "frame", "nothing")], "build_id long, slot string, product_id string")
    out = configure.exported(configure.resolve(picks, catalog.products(spark)), 'a "source"', F.concat(F.lit("Ünï \\ "), F.col("build_id")))
    configure.write_exports(out, f"{tmp_path}/builds", F.col("build_id"))
    got = {k.split("/", 1)[1]: v for k, v in files(f"{tmp_path}/builds").items()}
    known = [p["id"] for p in catalog.PRODUCTS]
    chosen = [{k: v for k, v in (("frame", "frame5"), ("esc", "esc")) if v in known}, {}]
    assert got == {f"{i + 1}/build.json": json.dumps({"source": 'a "source"', "name": f"Ünï \\ {i + 1}", "selection": s}, indent=2, ensure_ascii=False) for i, s in enumerate(chosen)}
