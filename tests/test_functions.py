import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions import fuzzy, numbers, periods, text

# Fixed vectors: labels and values that the engine must read alike.
NUMBERS = [("₹8,142 crore", 8142, "crore", 8.142e10), ("Rs. 578 Cr", 578, "crore", 5.78e9), ("5%", 5, None, 0.05), ("781 Bps", 781, "bps", 0.0781), ("₹(452) Cr", -452, "crore", -4.52e9), ("US$216 billion", 216, "billion", 2.16e11), ("1.4 Mn Tons", 1.4, "million", 1.4e6), ("1,234", 1234, None, 1234.0), ("", None, None, None), ("two 1 and 2", None, None, None), ("no digits here", None, None, None), (None, None, None, None), ("8142Cr", 8142, None, 8142.0), ("3bn", 3, "billion", 3e9), ("12mn", 12, "million", 1.2e7), ("10m", 10, None, 10.0), ("(6.3%)", 6.3, None, 0.063), ("₹-5", 5, None, 5.0)]
PERIODS = [("FY24", "2023-04-01", "2024-04-01", "fiscal_year"), ("Q3 FY24", "2023-10-01", "2024-01-01", "quarter"), ("nine months ended December 31, 2021", "2021-04-01", "2022-01-01", "range"), ("as on March 31, 2024", "2024-03-31", "2024-04-01", "instant"), ("FY2025/26", "2025-04-01", "2026-04-01", "fiscal_year"), ("2024", "2024-01-01", "2025-01-01", "calendar_year"), ("2024-25", "2024-04-01", "2025-04-01", "fiscal_year"), ("H1 FY24", "2023-04-01", "2023-10-01", "half_year"), ("year ended March 31, 2024", "2023-04-01", "2024-04-01", "fiscal_year"), ("2020-2021", "2020-01-01", "2022-01-01", "range"), ("some vague phrase", None, None, "unknown"), ("March 2024", "2024-03-01", "2024-03-02", "instant"), ("as on February 30, 2024", None, None, "unknown"), ("half year ended September 30, 2024", "2023-10-01", "2024-10-01", "fiscal_year"), ("Q3 2024", "2023-10-01", "2024-01-01", "quarter"), ("3Q FY24", "2023-10-01", "2024-01-01", "quarter"), ("q324", "2023-10-01", "2024-01-01", "quarter"), ("Q4 FY24 (unaudited)", None, None, "unknown"), ("quarter ended June 30, 2024", None, None, "unknown"), ("F.Y. 2023-24", "2023-04-01", "2024-04-01", "fiscal_year"), ("Fiscal Year 2021", "2020-04-01", "2021-04-01", "fiscal_year"), ("financial year 2020/21", "2020-04-01", "2021-04-01", "fiscal_year"), ("2021-2020", None, None, "unknown"), ("6 months period ending on 30th September 2024", "2024-04-01", "2024-10-01", "range"), ("as at 31-03-24", "2024-03-31", "2024-04-01", "instant"), ("Mar '24", "2024-03-01", "2024-03-02", "instant"), ("2024-03-15", "2024-03-15", "2024-03-16", "instant"), ("", None, None, None), (None, None, None, None)]


def test_parse_number(spark):
    df = spark.createDataFrame([(n, c[0]) for n, c in enumerate(NUMBERS)], "n int, v string")
    for r in df.select("n", *[c.alias(k) for k, c in numbers.parse_number(F.col("v")).items()]).collect():
        _, value, magnitude, base = NUMBERS[r.n]
        assert (r.value, r.magnitude) == (value, magnitude) and r.base == (None if base is None else pytest.approx(base)), NUMBERS[r.n]


def test_currency_and_unit(spark):
    df = spark.createDataFrame([("US$216 billion",), ("€10m",), ("£3bn",), ("Rs. 578 Cr",), ("42 units",)], "v string")
    assert [r[0] for r in df.select(numbers.parse_currency(F.col("v"))).collect()] == ["USD", "EUR", "GBP", "INR", None]
    units = {"₹ crore": "INR", "%": "ratio", "bps": "ratio", "0.01x": "ratio", "Mn Tons": "tonne", "days": "days", "million sq ft": "sqft", "shipments": "count", "pin codes": "count", "widgets": None, "": None}
    df = spark.createDataFrame([(k,) for k in units], "v string")
    assert [r[0] for r in df.select(numbers.parse_unit(F.col("v"), F.lit(None).cast("string"))).collect()] == list(units.values())


def test_periods(spark):
    day = lambda x: x and dt.date.fromisoformat(x)
    df = spark.createDataFrame([(n, p[0]) for n, p in enumerate(PERIODS)], "n int, v string")
    for r in df.select("n", periods.parse_period(F.col("v"), F.lit("apr-mar")).alias("p")).collect():
        assert tuple(r.p) == (day(PERIODS[r.n][1]), day(PERIODS[r.n][2]), PERIODS[r.n][3]), PERIODS[r.n]
    calendar = df.limit(1).select(periods.parse_period(F.lit("FY24"), F.lit("jan-dec")).alias("p")).collect()[0].p
    assert tuple(calendar)[:2] == (dt.date(2024, 1, 1), dt.date(2025, 1, 1))
    found = df.limit(1).select(*[periods.detect_convention(F.lit(x)) for x in ("financial year ended March 31, 2024", "fiscal year ending December 31, 2024", "financial year that ends June 30", "the financial year ended September 30")]).collect()[0]
    assert tuple(found) == ("apr-mar", "jan-dec", "jul-jun", None)


def test_text(spark):
    one = lambda *c: spark.range(1).select(*c).collect()[0]
    names = {"Vask Logistics Private Limited": "vask logistics", "Mr. Ada  Bell": "ada bell", "Acme Corp.": "acme", "Holdings Group": ""}
    assert list(one(*[text.normalize_name(F.lit(k)) for k in names])) == list(names.values())
    assert list(one(text.guess_type(F.lit("Dr. A")), text.guess_type(F.lit("Acme")))) == ["person", "org"]
    assert one(text.fold(F.lit("₹  8,142\n crore ‘x’ −")))[0] == "₹ 8,142 crore 'x' -"
    assert list(one(text.digits_of(F.lit("(452)")), text.digits_of(F.lit("1 and 2")), text.digits_of(F.lit("(-5")), text.digits_of(F.lit("(6.3%)")))) == [-452.0, None, -5.0, -6.3]
    assert list(one(*[text.token_in_text(F.lit(a), F.lit(b)) for a, b in (("8,142", "was 8142.5"), ("814", "8142"), ("%", "five per cent"), ("Cr", "in crore"))])) == [True, False, True, True]
    assert sorted(one(text.content_tokens(F.lit("The Revenue from operations, a 5th revenue")))[0]) == ["5th", "operations", "revenue"]


def test_fuzzy(spark):
    s = "revenue from operations"
    assert fuzzy.token_set_ratio(s, "revenue from services") == pytest.approx(77.2727, abs=1e-3)
    assert fuzzy.token_set_ratio(s, "profit after tax") == pytest.approx(35.8974, abs=1e-3) and fuzzy.token_set_ratio("a b", "a b c") == 100
    assert fuzzy.token_sort_ratio("deltivera", "deltivera robotics") == pytest.approx(66.6667, abs=1e-3)
    assert fuzzy.partial_ratio("abcd", "xxabcdxx") == 100 and fuzzy.partial_ratio("", "x") == 0 and fuzzy.common_length("abcbdab", "bdcaba") == 4
    df = spark.createDataFrame([("a b", "b a"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.sort_ratio("a", "b")).collect()] == [100.0, None]


def test_partial_ratio_with_cutoff_equals_all_windows():
    import random

    rng = random.Random(2)
    for _ in range(150):
        long_ = "".join(rng.choice("abcde ") for _ in range(120))
        k = rng.randrange(0, 80)
        short = list(long_[k : k + 40]) if rng.random() < 0.8 else [rng.choice("abcde ") for _ in range(40)]
        for _ in range(rng.randrange(0, 6)):
            short[rng.randrange(len(short))] = rng.choice(["", "x", "ab"])
        short = "".join(short)
        whole = fuzzy.partial_ratio(short, long_)
        assert fuzzy.partial_ratio(short, long_, 90.0) == (whole if whole >= 90 else 0.0)
