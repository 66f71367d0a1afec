"""Scalar functions on literal cases."""

import datetime as dt
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tieout.functions import calendar, dates, grounding, money, narration, text
from tieout.operators import similarity


def column(spark, values, schema="x string"):
    return spark.createDataFrame([(v,) for v in values], schema)


AMOUNTS = {
    "1,23,456.78": 12345678, "₹ 1,000": 100000, "(500.00)": -50000, "500.5 Dr": -50050, "Rs. 75 Cr.": 7500,
    "-12.349": -1234, "+9": 900, "INR10": 1000, "$1,0.1": 1010, "１２３．４５": 12345, "१२३": 12300, "1 000": 100000,
    "(-5)": -500, "1,,2": None, "abc": None, "": None, "  ": None, "1.2.3": None, ".5": None,
    "99999999999999999999": None,
}


def test_parse_amount(spark):
    rows = column(spark, AMOUNTS).select("x", money.parse_amount(F.col("x")).alias("p")).collect()
    assert {r.x: r.p.paise for r in rows} == AMOUNTS
    for r in rows:
        assert (r.p.paise is None) == (r.p.error is not None)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-10**14, 10**14), min_size=1, max_size=200))
def test_amounts_round_trip(spark, values):
    rows = column(spark, values, "x long").select(
        "x", money.parse_amount(money.format_paise(F.col("x")))["paise"].alias("back")).collect()
    assert all(r.x == r.back for r in rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=50))
def test_any_text_is_a_value_or_an_error(spark, values):
    values = [v.replace("\x00", "").encode("utf-8", "ignore").decode() for v in values]
    rows = column(spark, values).select(money.parse_amount(F.col("x")).alias("a"), dates.parse_date(F.col("x")).alias("d"))
    for r in rows.collect():
        assert (r.a.paise is None) != (r.a.error is None)
        assert (r.d.day is None) != (r.d.error is None)


DATES = {
    "2024-02-29": dt.date(2024, 2, 29), "2023-02-29": None, "5/8/2026": dt.date(2026, 8, 5), "4-Aug-26": dt.date(2026, 8, 4),
    "4-AUG-26": dt.date(2026, 8, 4), "2026-8-4": dt.date(2026, 8, 4), "20260804": dt.date(2026, 8, 4),
    "2026-W01-1": dt.date(2025, 12, 29), "2026W011": dt.date(2025, 12, 29), "2026-08-04T21:00:00Z": dt.date(2026, 8, 5),
    "2026-08-04T10:23:45+05:30": dt.date(2026, 8, 4), "2026-08-04 10:23:45": dt.date(2026, 8, 4),
    "5/8/2026 9:05 pm": dt.date(2026, 8, 5), "31/02/2026": None, "4-Foo-26": None, "45000": None, "": None,
    "2021-W53-1": None, "2020-W53-7": dt.date(2021, 1, 3),
}


def test_parse_date(spark):
    rows = column(spark, DATES).select("x", dates.parse_date(F.col("x")).alias("p")).collect()
    assert {r.x: r.p.day for r in rows} == DATES


def test_iso_dates_follow_python(spark):
    days = [dt.date(2023, 12, 25) + dt.timedelta(days=i) for i in range(800)]
    weeks = ["%d-W%02d-%d" % tuple(d.isocalendar()) for d in days]
    rows = column(spark, weeks).select("x", dates.parse_date(F.col("x"))["day"].alias("d")).collect()
    assert all(r.d == dt.date.fromisoformat(r.x) for r in rows)


def step(day, count):
    holidays = {dt.date.fromisoformat(h) for h in calendar.HOLIDAYS}
    sign = 1 if count >= 0 else -1
    while count:
        day += dt.timedelta(days=sign)
        if day.weekday() < 5 and day not in holidays:
            count -= sign
    return day


def test_business_days(spark):
    days = [dt.date(2023, 12, 20) + dt.timedelta(days=i) for i in range(760)]
    counts = (-8, -5, -1, 0, 1, 5, 8)
    rows = column(spark, days, "x date").select(
        "x", *[calendar.add_business_days("x", n).alias(str(n)) for n in counts]).collect()
    for r in rows:
        assert [r[str(n)] for n in counts] == [step(r.x, n) for n in counts]


@pytest.mark.parametrize("line, utrs", [
    ("NEFT CR-UTR 123456789012-ACME TRADERS", ["123456789012"]),
    ("utr no. abc123456789 utr: ABC123456789", ["ABC123456789"]),
    ("UTR NOTAVAILABLE", ["TAVAILABLE"]),
    ("UPI/RRN 400000000001/pay_Abc123/for ACME", []),
    ("RTGS 42 7", []),
])
def test_narration(spark, line, utrs):
    row = column(spark, [line]).select(narration.utrs(F.col("x")).alias("u"), narration.payer(F.col("x")).alias("p")).first()
    assert row.u == utrs
    words = [w for w in re.findall(narration.WORD, line) if w.upper() not in narration.NOISE_WORDS]
    assert row.p == (" ".join(words[:3]) or None)


def test_canonical_reference(spark):
    forms = ["UTR598806645", " utr 5988 06645", "RRN#: 598806645", "598806645", "UTR NO. 598806645"]
    rows = column(spark, forms).select(narration.canonical_utr(F.col("x")).alias("c")).collect()
    assert {r.c for r in rows} == {"598806645"}


def test_fee_band_edges(spark):
    pairs = [(i, g) for i in (0, 1, 99, 10000, 10299, 10300, 999983, -5) for g in range(-2, 12000, 13)]
    rows = spark.createDataFrame(pairs, "i long, g long").select("i", "g", money.within_fee_band(F.col("i"), F.col("g")).alias("w"))
    for r in rows.collect():
        expected = (r.g == 0) if r.i == 0 else abs(r.i - r.g) * 10000 // r.i <= 300
        assert r.w == expected


def test_headers_and_cells(spark):
    row = spark.createDataFrame([(["", "Date", " date ", "A  b"],)], "c array<string>").select(
        text.header_names(F.col("c")).alias("h")).first()
    assert row.h == ["column_1", "Date", "date_2", "A b"]
    cells = {"1,234.50 Cr": True, "(12)": True, "12/03/2024": True, "Amount": False, "": False, "INV-2024-0012": True, "nan": True}
    rows = column(spark, cells).select("x", text.is_numberish(F.col("x")).alias("n")).collect()
    assert {r.x: r.n for r in rows} == cells


def test_similarity_is_the_gestalt_ratio(spark):
    pairs = [("Acme Traders", "ACME TRADERS PVT"), ("a", "b"), ("", ""), (" x ", "X")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", similarity.payer_similarity(F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        assert r.r == pytest.approx(SequenceMatcher(None, r.a.lower().strip(), r.b.lower().strip()).ratio())


@pytest.mark.parametrize("gross, target, subset", [
    ([6000, 4000], 10000, ["p0", "p1"]), ([5000] * 4, 10000, None), ([1000, 2000], 9999, None), ([], 5, None),
    ([100] * 8 + [7], 7, None), ([100] * 8 + [7], 800, [f"p{i}" for i in range(8)]),
])
def test_subset_sum(spark, gross, target, subset):
    rows = spark.createDataFrame([(target, [(f"p{i}", g) for i, g in enumerate(gross)])],
                                 "target long, candidates array<struct<id: string, gross: long>>")
    assert similarity.subset_sum(rows).first().subset == subset


def test_numbers_in_prose(spark):
    row = column(spark, ["1. Total 12,345.50 in INV-2024 and 7%\n2. Batch 30."]).select(
        grounding.prose_numbers(F.col("x")).alias("n")).first()
    assert row.n == [12345.5, 7.0, 30.0]
    row = column(spark, ['{"a": 1.5, "b": "12", "c": [2, {"d": -3e2}], "e": true}']).select(
        grounding.json_numbers(F.col("x")).alias("n")).first()
    assert row.n == [1.5, 2.0, -300.0]
