import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators.units import decompose, equal_classes, equal_statements, quantities, with_figure

FACT = "id long, document_id long, run_id long, subject_entity_id long, predicate_norm string, reporting_period_raw string, fact_type string, value_raw string, unit_raw string, magnitude string, currency string, value string, bin int"
COMMON = [("money", "INR"), ("money", "USD"), ("money", "EUR"), ("money", "GBP"), ("mass", "kg"), ("area", "sqm"), ("length", "m"), ("duration", "day"), ("share", "bps"), ("energy", "kwh"), ("power", "kw"), ("volume", "litre"), ("tally", "one")]
CASES = [
    # value, unit, magnitude, currency, predicate, common unit, value in it
    ("₹8,142 crore", None, None, None, "revenue", "INR", 8.142e10),
    ("8,142", "INR", "crore", "INR", "revenue", "INR", 8.142e10),
    ("₹8,142 crore", "INR", "crore", "INR", "revenue", "INR", 8.142e10),
    ("-Rs. 184.14 Cr", None, None, None, "revenue", "INR", -1.8414e9),
    ("Rs (21,65,528)", None, None, None, "revenue", "INR", -2165528.0),
    ("(2.050,6) thousands", None, None, "EUR", "revenue", "EUR", -2050600.0),
    ("€ 6.456,9 million", None, None, None, "revenue", "EUR", 6.4569e9),
    ("US$0.64155 bn", None, None, None, "revenue", "USD", 641550000.0),
    ("3.4883", "US$", "Mn", "USD", "revenue", "USD", 3488300.0),
    ("GBP 29,948 '000", None, None, None, "revenue", "GBP", 29948000.0),
    ("55.596 m", None, None, "INR", "revenue", "INR", 55596000.0),
    ("55.596 m", None, None, None, "pipeline", "m", 55.596),
    ("0.026 kt", None, None, None, "weight", "kg", 26000.0),
    ("507.67 lakhs kgs", None, None, None, "weight", "kg", 50767000.0),
    ("1,063", "MT", None, None, "weight", "kg", 1063000.0),
    ("12 t", None, None, None, "weight", "kg", 12000.0),
    ("1,000 lbs", None, None, None, "weight", "kg", 453.59237),
    ("100 sq. ft.", None, None, None, "floor", "sqm", 9.290304),
    ("5 m2", None, None, None, "floor", "sqm", 5.0),
    ("5 m³", None, None, None, "milk", "litre", 5000.0),
    ("1.5 KL", None, None, None, "milk", "litre", 1500.0),
    ("10", "(in gal (US))", None, None, "milk", "litre", 37.85411784),
    ("36 hrs", None, None, None, "wait", "day", 1.5),
    ("2 wks", None, None, None, "wait", "day", 14.0),
    ("2.5%", None, None, None, "margin", "bps", 250.0),
    ("25‰", None, None, None, "margin", "bps", 250.0),
    ("0.025x", None, None, None, "margin", "bps", 250.0),
    ("2 MU", None, None, None, "power made", "kwh", 2e6),
    ("3.6 GJ", None, None, None, "power made", "kwh", 1000.0),
    ("0.5 GW", None, None, None, "capacity", "kw", 500000.0),
    ("1.2 thousand customers", "customers", None, None, "customers", "one", 1200.0),
    ("0", "₹", None, None, "revenue", "INR", 0.0),
]
NONE = ["", "nil", "n.a.", "[●]", "—", "two 1 and 2", "between 40 and 60", "10-12%", "refer note 14", None, "5 gribbles", "₹" * 4000]


def facts(spark, rows):
    return spark.createDataFrame([(n, n, 1, 1, p, "FY24", "numeric", v, u, m, c, "x", 0) for n, (v, u, m, c, p) in enumerate(rows)], FACT)


def test_quantities(spark):
    rows = [c[:5] for c in CASES] + [(v, None, None, None, "revenue") for v in NONE] + [("7 km", None, None, None, "pipeline")] * 5
    common = spark.createDataFrame([(*c, "x") for c in COMMON], "dimension string, common_unit string, value string")
    got = {r.fact_id: r for r in quantities(facts(spark, rows), common).collect()}
    for n, case in enumerate(CASES):
        assert n in got, case
        assert (got[n].common_unit, pytest.approx(got[n].value, rel=1e-9)) == case[5:], case
    assert not set(got) & set(range(len(CASES), len(CASES) + len(NONE)))
    assert quantities(facts(spark, rows).limit(0), common).collect() == []


def test_the_first_field_wins_and_repeats_count_once():
    assert decompose(["Mn", "€ in Mn", "million", "EUR"])[0][1:] == ("money", "EUR", 1e6)
    assert decompose(["thousand thousand m^3"])[0][1:] == ("volume", "", 1e6)
    assert decompose([""]) == []


def test_figures_by_column(spark):
    df = spark.createDataFrame([("−1,23,456.5 kg",), ("12,5 kg",), ("1.234.567 kg",)], "v string")
    assert [r[0] for r in with_figure(df, "v").select("number").collect()] == [-123456.5, 12.5, 1234567.0]


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    base = [rng.choice([-1, 1]) * 10 ** rng.uniform(-1, 9) for _ in range(25)] + [0.0]
    rows = []
    for n in range(400):
        v = rng.choice(base) * (1 + rng.choice([0, 0, 0.0049, -0.0049, 0.00501, 0.01]))
        rows.append((n, rng.choice([1, 2, 3, None]), rng.choice([1, 1, 2, None]), 7, "revenue", "FY24", "numeric", f"{v:.9f}", "₹", None, None, "x", 0))
    common = spark.createDataFrame(COMMON, "dimension string, common_unit string")
    got = [tuple(r) for r in equal_statements(spark.createDataFrame(rows, FACT), common).collect()]
    want = set()
    for a in rows:
        for b in rows:
            va, vb = float(a[7]), float(b[7])
            if a[0] < b[0] and None not in (a[1], b[1], a[2], b[2]) and a[1] != b[1] and a[2] == b[2] and (va > 0) == (vb > 0) and (va == 0) == (vb == 0):
                if math.fabs(va - vb) <= 0.005 * max(abs(va), abs(vb)):
                    want.add((a[0], b[0]))
    assert len(got) == len(set(got)) and set(got) == want and want
    links = {}
    for a, b in want:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    classes = {r.fact_id: r for r in equal_classes(spark.createDataFrame(rows + rows[:5], FACT), common).collect()}
    assert {k: r.n_links for k, r in classes.items()} == links
    assert all(float(rows[r.class_id][7]) == float(rows[k][7]) and r.class_id <= k for k, r in classes.items())
