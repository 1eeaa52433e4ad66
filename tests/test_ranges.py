"""Range joins and runs of actions against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from kitwright.operators import configure, ranges, wizard
from kitwright.plans import extended
from kitwright.sources import catalog


@pytest.mark.parametrize("bits", [4, 9])
def test_range_join_equals_the_nested_loop(spark, bits):
    rng = random.Random(bits)
    top = 2**bits
    numbers = [(i, rng.choice("ab"), rng.choice([None, *[rng.randrange(top) for _ in range(6)]])) for i in range(150)]
    spans = [(j, rng.choice("ab"), rng.choice([None, rng.randrange(-3, top + 5)]), rng.randrange(-3, top + 5)) for j in range(150)]
    spans += [(200, "a", 0, top - 1), (201, "b", -(10**6), 10**6), (202, "a", 3, 2), (203, "a", 5, 5)]
    left = spark.createDataFrame(numbers, "i int, k string, x int")
    right = spark.createDataFrame(spans, "j int, k string, lo int, hi int")
    out = ranges.range_join(left, right, F.col("x"), F.col("lo"), F.col("hi"), bits, ["k"])
    want = [(i, j) for i, k, x in numbers for j, kk, lo, hi in spans if k == kk and None not in (x, lo) and lo <= x <= hi]
    # Each pair once: what meets is what the result has.
    assert sorted((r.i, r.j) for r in out.collect()) == sorted(want) and len(want) > 1000


def test_numbers_outside_are_an_error(spark):
    one = spark.createDataFrame([(16,)], "x int")
    with pytest.raises(Exception, match="numbers are from 0 to 15"):
        ranges.range_join(one, spark.createDataFrame([(0, 99)], "lo int, hi int"), F.col("x"), F.col("lo"), F.col("hi"), 4).collect()


def test_fitting_pairs_are_those_of_the_matrix(spark):
    products = catalog.products(spark)
    want = {(r.rule, r.a_id, r.b_id) for r in configure.pair_matrix(products).filter("fits").collect()}
    assert {(r.rule, r.a_id, r.b_id) for r in configure.fitting_pairs(products).collect()} == want and want
    volts = {(r.rule, r.a_id, r.b_id) for r in configure.fitting_voltages(products).collect()}
    rows = products.collect()
    for slot, label in configure.VOLTAGE_SLOTS:
        for b in rows:
            for p in rows:
                if b.category == "battery" and p.category == slot:
                    fits = None not in (b.voltage, p.min_voltage, p.max_voltage) and p.min_voltage <= b.voltage <= p.max_voltage
                    assert ((label, b.id, p.id) in volts) == fits


def rows_made(df):
    """The most rows that one join of a plan that ran has made."""
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            if name.endswith("JoinExec"):
                most = max(most, node.metrics().apply("numOutputRows").value())
            left += [node.children().apply(i) for i in range(node.children().size())]
    return most


def alike_products(spark):
    """3,000 products of few kinds, some of an id that stands twice, some with gaps."""
    rng = random.Random(3)
    kind = lambda *values: rng.choice([None, *values, *values, *values])
    rows = []
    for i in range(3000):
        low = kind(0, 3, 4)
        rows.append((
            i, f"p{i - i % 50 // 49}", rng.choice(["frame", "motors", "propellers", "flightController", "esc", "battery"]), kind(0, 3, 5, 7), kind("", "a", "a", "b"), kind(3, 5, 6, 7),
            kind(1404, 2207, 2806), kind(3, 4, 6), low, kind(3, 4, 6), kind("6pin", "8pin"), kind("6pin", "8pin"), kind(0, 15, 38), kind(20, 55),
        ))
    columns = ["no", "id", "category", "frame_inches", "mount", "prop_inches", "motor_size", "voltage", "min_voltage", "max_voltage", "connector", "esc_input", "current", "esc_amps"]
    types = ["int" if isinstance(next(v for v in column if v is not None), int) else "string" for column in zip(*rows, strict=True)]
    found = spark.createDataFrame(rows, ", ".join(map(" ".join, zip(columns, types, strict=True))))
    return found.withColumns({c: F.lit(None).cast("int") for c in configure.ATTRIBUTES if c not in columns})


def test_counts_of_fitting_pairs_make_no_pairs(spark):
    products = alike_products(spark)
    pairs = configure.fitting_pairs(products, amperes=6)
    plain = pairs.groupBy("rule", "a_id").agg(F.count("*"), F.min("b_id"))
    want = plain.collect()
    got = configure.fitting_counts(products, amperes=6)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len({r.rule for r in want}) == 5
    assert rows_made(got) <= 3000 and rows_made(plain) > 20_000


def test_pair_rules_makes_no_pairs(spark, tmp_path):
    part = spark.range(3000).selectExpr("id as p_partkey", "'b' as p_brand", "'t' as p_type", "int(1 + id % 50) as p_size", "1.5d as p_retailprice")
    part.write.parquet(f"{tmp_path}/part.parquet")
    got = extended.pair_rules(spark, str(tmp_path))
    assert sum(r.n_fitting for r in got.collect()) > 300_000 and rows_made(got) <= 3000


def test_counts_of_fitting_voltages_make_no_pairs(spark, tmp_path):
    products = alike_products(spark)
    plain = configure.fitting_voltages(products).groupBy("rule", "b_id").agg(F.count("*"), F.min("a_id"))
    want = plain.collect()
    got = configure.voltage_counts(products)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len({r.rule for r in want}) == 3
    part = spark.range(6000).selectExpr("id as p_partkey", "'b' as p_brand", "'t' as p_type", "int(1 + id % 50) as p_size", "1.5d as p_retailprice")
    part.write.parquet(f"{tmp_path}/part.parquet")
    query = extended.voltage_fits(spark, str(tmp_path))
    assert sum(r.n_batteries for r in query.collect()) > 50_000
    assert max(rows_made(got), rows_made(query)) <= 6000 < rows_made(plain)


def test_runs_of_actions(spark, monkeypatch):
    """Step by step, whole and in pieces of three."""
    rng = random.Random(7)
    rows, want = [], {}
    for run in range(60):
        step, told = 0, False
        turns = sorted(rng.sample(range(1000), rng.randrange(1, 40)))
        for t in turns:
            a = rng.choice(["next", "skip", "next", "back", "finish", "over", "else", None])
            rows.append((run, t, a))
            step = {"next": min(step + 1, 4), "skip": min(step + 1, 4), "back": max(step - 1, 0), "finish": 4, "over": 0}.get(a, step)
            told = {"finish": True, "over": False}.get(a, told)
        want[run] = (len(turns), step, step == 4 and told)
    table = spark.createDataFrame(rows, "run int, turn int, action string").repartition(3)
    for piece in (wizard.PIECE, 3):
        monkeypatch.setattr(wizard, "PIECE", piece)
        assert {r.run: tuple(r)[1:] for r in wizard.runs(table, "run", "turn").collect()} == want


def test_a_removal_empties_a_slot(spark):
    picks = spark.createDataFrame([(1, "frame", "frame5", 1), (1, "frame", None, 2), (2, "frame", None, 1), (2, "frame", "frame5", 2), (3, "frame", None, 1)], "build_id long, slot string, product_id string, turn long")
    got = {r.build_id: r.frame and r.frame.id for r in configure.resolve(picks, catalog.products(spark), order=["turn"]).collect()}
    assert got == {1: None, 2: "frame5", 3: None}
