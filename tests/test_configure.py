"""Golden builds, what-if candidates, and edges of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from kitwright.functions import scalars as S
from kitwright.operators import billing, configure, recommend, selection
from kitwright.sources import catalog, manifest
from kitwright.sources.catalog import SLOTS

RACER = dict(zip(SLOTS, catalog.PRESETS[1][2], strict=True))
COMPACT = dict(zip(SLOTS, ["frame3", "motors3", "fcF4", "esc20", "props3", "battery4", "cameraFpv", "receiver2"], strict=True))


def evaluate(spark, chosen):
    picks = spark.createDataFrame([("b", s, p) for s, p in chosen.items()] or [("b", "frame", "none")], "build_id string, slot string, product_id string")
    return configure.evaluate(configure.resolve(picks, catalog.products(spark))).first()


@pytest.mark.parametrize(
    "chosen, want",
    [
        (dict(zip(SLOTS, catalog.PRESETS[0][2], strict=True)), (8, 726.20, 1044, 121, 78, "compatible", 0)),
        (RACER, (8, 522.20, 706, 141, 78, "compatible", 0)),
        (COMPACT, (8, 364.20, 390, 93, 72, "compatible", 0)),
        (COMPACT | {"camera": "camera4k", "receiver": "receiver"}, (8, 509.20, 457, 83, 71, "compatible", 0)),
        ({}, (0, 0.0, None, None, None, "unknown", 0)),
        ({"frame": "motors5"}, (1, 89.90, None, None, None, "unknown", 0)),
        ({"frame": "frame5", "motors": "motors3"}, (2, 129.80, None, None, None, "incompatible", 1)),
        (RACER | {"esc": "esc20"}, (8, 477.20, 696, 142, None, "incompatible", 3)),
        ({k: v for k, v in RACER.items() if k != "camera"}, (7, 482.30, 697, 142, None, "unknown", 0)),
        ({k: v for k, v in RACER.items() if k != "flightController"}, (7, 402.30, 688, 144, None, "unknown", 0)),
    ],
)
def test_golden(spark, chosen, want):
    r = evaluate(spark, chosen)
    assert (r.n_filled, float(r.price), r.weight, r.speed, r.score, r.status, len(r.warnings)) == want


def test_missing_voltage_and_last_pick(spark):
    products = catalog.products(spark).withColumn("max_voltage", F.when(F.col("id") != "motors5", F.col("max_voltage")))
    picks = spark.createDataFrame([("b", s, p, 1) for s, p in RACER.items()] + [("b", "frame", "frame3", 0)], "build_id string, slot string, product_id string, seq int")
    r = configure.evaluate(configure.resolve(picks, products, order=["seq"])).first()
    assert (r.status, r.missing, r.score) == ("unknown", ["Motors voltage range is missing."], None)


def test_candidates_of_the_racer(spark):
    picks = spark.createDataFrame([("b", s, p) for s, p in RACER.items()], "build_id string, slot string, product_id string")
    found = {r.candidate_id: r for r in configure.candidates(configure.resolve(picks, catalog.products(spark)), catalog.products(spark)).collect()}
    bad = {"frame3": 2, "motors7": 1, "motors3": 3, "fcF4": 2, "esc20": 3, "props7": 2, "props3": 1}
    assert {k: len(r.messages) for k, r in found.items() if r.status == "incompatible"} == bad
    assert len(found) == 20 and {r.status for k, r in found.items() if k not in bad} == {"compatible"}


def test_scalars(spark):
    ts = lambda t: F.lit(t).cast("timestamp")
    r = spark.range(1).select(
        S.round_half_up(F.lit(-2.5)).alias("a"), S.add_months(ts("2023-01-31 10:00:00"), 1).alias("b"), S.add_months(ts("2024-02-29 00:00:00"), 12).alias("c"), S.padded(F.lit(12345)).alias("d"),
        S.usage_percent(F.lit(5), F.lit(0.0)).alias("e"), S.usage_percent(F.lit(5), F.lit(float("inf"))).alias("f"), S.usage_label(F.lit(5), F.lit(float("inf"))).alias("g"),
        S.date_label(F.lit(None).cast("timestamp")).alias("h"), S.euro_german(F.lit(1234.5)).alias("i"), S.trimmed(F.lit("  x\t")).alias("j"), S.is_email(F.lit(None)).alias("k"),
    ).first()
    assert tuple(r) == (-2, datetime.datetime(2023, 3, 3, 10), datetime.datetime(2025, 3, 1), "12345", 0.0, 100.0, "5 / Unlimited", "—", "1.234,50 €", "x", False)


def test_suggestion_edges(spark):
    asked = spark.createDataFrame([(699, None, None), (700, "Sky Blue", None), (1500, None, None), (1501, None, None), (300, None, "Racing"), (1000, "", "Other")], "budget int, color string, style string")
    got = [(r.suggestion, r.parts[4]) for r in recommend.suggest(asked, recommend.suggestion_table(spark)).orderBy("style", "budget").collect()]
    assert sorted(got) == sorted([("First Racer Build", "Classic factory shell"), ("Backpack Cinematic Build", "Custom shell in Sky Blue"), ("Backpack Cinematic Build", "Classic factory shell"), ("Silent Shutter Pro Build", "Classic factory shell"), ("Track Rocket Build", "Classic factory shell"), ("Backpack Cinematic Build", "Classic factory shell")])


def test_billing_trace(spark):
    rows = [(1, "2024-01-10", 1, "cancel", None, None), (1, "2024-02-05", 2, "remove_card", None, None), (1, "2024-02-06", 3, "change", "pro", "monthly"), (1, "2024-02-07", 4, "add_card", None, None), (1, "2024-02-08", 5, "change", "team", "yearly"), (2, "2024-01-31", 6, "change", "pro", "monthly"), (2, "2024-02-01", 7, "change", "free", "monthly")]
    events = spark.createDataFrame(rows, "user_id long, ts string, seq int, action string, plan string, interval string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.user_id: r for r in billing.replay(events, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-06-01").cast("timestamp")).collect()}
    one, two = got[1], got[2]
    assert (one.plan, one.interval, one.has_card, one.next_invoice_number, one.period_end_at) == ("team", "yearly", True, 6, datetime.datetime(2025, 2, 8))
    assert (one.invoices[0].id, one.invoices[0].description, float(one.invoices[0].amount)) == ("DEMO-0005", "Team plan, yearly", 470.40)
    assert (two.plan, two.period_end_at, len(two.invoices)) == ("free", None, 5)


def test_saving(spark, tmp_path):
    root = f"{tmp_path}/store"
    builds = spark.createDataFrame([(1, ["frame"], 45)], "user_id long, part_ids array<string>, estimated_total int")
    for commit in ("one", "two"):
        selection.save(builds, root, commit)
    assert manifest.tables(spark, root)["builds"].select("id").distinct().count() == 2
    drafts = spark.createDataFrame([(1, ["frame"], "signedOut"), (2, ["esc"], "loading")], "user_id long, part_ids array<string>, status string")
    selection.save_draft(drafts, root, "three", F.col("status"))
    stored = manifest.tables(spark, root)["drafts"]
    assert [r.part_ids for r in selection.restored(stored, ["frame", "esc"], ["fc"]).collect()] == [["frame"]]
    # Drafts of others, and of those whose status is not known, stay.
    later = spark.createDataFrame([(1, ["fc"], "loading"), (3, ["esc"], "signedOut")], drafts.schema)
    selection.save_draft(later, root, "four", F.col("status"))
    got = selection.restored(manifest.tables(spark, root)["drafts"], ["frame", "esc", "fc"], [])
    assert {r.user_id: r.part_ids for r in got.collect()} == {1: ["frame"], 3: ["esc"]}


def test_a_broken_list_is_an_error(spark):
    lists = spark.createDataFrame([(None,), ("",), ("[]",), ('{"a":1}',), ('[{"id":"a","estimatedTotal":5}]',), ("[{",)], "raw string")
    got = lists.select(F.size(selection.saved_builds(F.col("raw"))).alias("n"), selection.save_error(F.col("raw")).alias("e")).collect()
    assert [(r.n, r.e == "") for r in got] == [(0, True)] * 4 + [(1, True), (None, False)]


def test_selecting_the_plan_in_force_changes_nothing(spark):
    at = lambda day: datetime.datetime(2024, 1, day)
    events = [
        (1, at(2), 1, "select", "pro", "monthly"), (1, at(3), 2, "select", "pro", "yearly"), (1, at(4), 3, "select", "pro", "yearly"),
        (2, at(2), 1, "change", "pro", "monthly"),
        (3, at(2), 1, "select", "free", "monthly"), (3, at(3), 2, "select", "free", "yearly"), (3, at(4), 3, "remove_card", None, None), (3, at(5), 4, "select", "pro", "monthly"),
        (4, at(2), 1, "cancel", None, None), (4, at(3), 2, "select", "pro", "monthly"),
    ]
    table = spark.createDataFrame(events, "user_id long, ts timestamp, seq long, action string, plan string, interval string")
    opened, as_of = (F.lit(x).cast("timestamp") for x in ("2024-01-01", "2024-01-20"))
    got = {r.user_id: (r.plan, r.interval, r.cancel_at_period_end, r.has_card, r.next_invoice_number) for r in billing.replay(table, opened, as_of).collect()}
    assert got == {1: ("pro", "yearly", False, True, 6), 2: ("pro", "monthly", False, True, 6), 3: ("free", "monthly", False, False, 5), 4: ("pro", "monthly", True, True, 5)}


def test_names_and_part_bits(spark):
    names = spark.createDataFrame([("x" * 100,), (" " + "x" * 100 + "\t",), ("x" * 101,), (None,)], "name string")
    assert [r[0] for r in names.select(S.acceptable_name("name")).collect()] == [True, True, False, False]
    toggles = spark.createDataFrame([(1, "frame"), (1, "camera"), (1, "camera"), (1, "camera"), (2, "nothing"), (3, None)], "user_id long, part_id string")
    got = {u: {r.part_id for r in selection.toggled(toggles, catalog.parts(spark)).collect() if r.user_id == u} for u in (1, 2, 3)}
    default = {p[0] for p in catalog.PARTS if p[3]}
    assert got == {1: default - {"frame"} | {"camera"}, 2: default, 3: default}
    many = catalog.parts(spark).withColumn("no", F.col("no") + 60)
    with pytest.raises(Exception, match="more than 63 parts"):
        selection.toggled(toggles.withColumn("part_id", F.lit("camera")), many).collect()


def test_texts_of_an_empty_and_a_partial_build(spark):
    """As the page shows them: dashes alone for what is not known, and what stands in an empty row."""
    picks = spark.createDataFrame([(1, "frame", None, 1), (2, "frame", "frame5", 1), (2, "esc", "esc", 2)], "build_id long, slot string, product_id string, turn long")
    builds = configure.resolve(picks, catalog.products(spark), order=["turn"])
    one, two = configure.tiles(configure.evaluate(builds)).orderBy("build_id").collect()
    shown = ("—/100", "Build incomplete", "—", "—")
    assert tuple(one)[1:] == (*shown, "0,00 €", "Select components to check compatibility")
    known = {p["id"]: p for p in catalog.PRODUCTS}
    price = sum(float(known[i]["price"]) for i in ("frame5", "esc") if i in known)
    assert tuple(two)[1:5] == shown and two.price_text == f"{price:.2f}".replace(".", ",") + " €"
    rows = configure.component_rows(builds, catalog.products(spark), catalog.categories(spark)).collect()
    of = lambda build, label: next(r for r in rows if r.build_id == build and r.ord == label)
    assert len(rows) == 16 and {tuple(r)[3:] for r in rows if r.build_id == 1} == {("No component selected", None, "Not selected", "—", "Select Component")}
    frame = of(2, 0)
    assert (frame.product_name, frame.spec, frame.fit, frame.button) == (known["frame5"]["name"], known["frame5"]["spec"], "Pending checks", "Change")
    assert frame.price_text == f"{float(known['frame5']['price']):.2f}".replace(".", ",") + " €"
