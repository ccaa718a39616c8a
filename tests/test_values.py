import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obsmill.functions import values
from obsmill.functions.text import as_text, formula_safe
from obsmill.operators.measures import normalize_yields
from obsmill.operators.selection import literal_search


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def lit(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize(
    "current, previous, expected",
    [(110, 100, 10.0), (1, 0, None), (None, 5, None), (5, None, None), (-50, -100, 50.0)],
)
def test_percent_change(spark, current, previous, expected):
    assert one(spark, values.percent_change(lit(current), lit(previous))) == expected


@pytest.mark.parametrize(
    "start, end, years, expected",
    [(100, 121, 2, 10.0), (100, 121, 0, None), (0, 1, 2, None), (1, -1, 2, None), (None, 1, 2, None), (5, 0, 1, -100.0)],
)
def test_compound_growth(spark, start, end, years, expected):
    got = one(spark, values.compound_growth(lit(start), lit(end), F.lit(years)))
    assert got is None if expected is None else math.isclose(got, expected, rel_tol=1e-9)


def test_safe_ratio(spark):
    assert one(spark, values.safe_ratio(lit(25), lit(100))) == 0.25
    assert one(spark, values.safe_ratio(lit(25), lit(0))) is None
    assert one(spark, values.safe_ratio(lit(None), lit(2))) is None


@pytest.mark.parametrize(
    "code, number", [("'004", 4), ("''004", 4), ("4.0", 4), ("abc", None), (None, None), ("'840", 840)]
)
def test_m49_number(spark, code, number):
    assert one(spark, values.m49_number(F.lit(code).cast("string"))) == number


def test_exact_sum_ignores_order_and_keeps_missing(spark):
    numbers = [0.1, 0.2, 0.3, 1e15, -1e15, 403698.83]
    for rows in (numbers, numbers[::-1]):
        df = spark.createDataFrame([(v,) for v in rows], "v double")
        assert df.agg(values.exact_sum(F.col("v")).alias("s")).first().s == 403699.43
    empty = spark.createDataFrame([(None,)], "v double")
    assert empty.agg(values.exact_sum(F.col("v")).alias("s")).first().s is None


@pytest.mark.parametrize(
    "numbers, total", [([1e30, 1.0], 1e30), ([9e25, 9e25], 1.8e26), ([float("inf"), 1.0], float("inf")), ([None, 2.5], 2.5)]
)
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_sums_beyond_the_decimal_leave_nothing_out(spark, numbers, total, ansi):
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        assert df.agg(values.exact_sum(F.col("v")).alias("s")).first().s == total
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def total(spark, numbers):
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    return df.agg(values.exact_sum(F.col("v")).alias("s")).first().s


@pytest.mark.parametrize("number", [1 / 3, 4e-13, 7e-13, 1e30, -2 / 7, 0.1, 123456789.987654321, 5e-324])
def test_a_single_value_comes_back_bit_for_bit(spark, number):
    assert total(spark, [number]) == number


def test_digits_beyond_the_twelfth_add_up(spark):
    assert total(spark, [4e-13, 1e-13]) == pytest.approx(5e-13, rel=1e-12)
    assert total(spark, [1 / 3] * 3000) == pytest.approx(1000, rel=1e-15)


def test_mixed_sizes_in_any_order(spark):
    numbers = [1e30, 1 / 3, -1e30, 4e-13, 1e15, 0.1, -1e15] * 5
    exact = math.fsum(n for n in numbers if abs(n) < 1e20)
    for seed in range(3):
        random.Random(seed).shuffle(numbers)
        small = [n for n in numbers if abs(n) < 1e20]
        assert total(spark, small) == pytest.approx(exact, rel=1e-14)
        assert abs(total(spark, numbers)) < 1e16


def test_yield_units(spark, observe):
    rows = observe(
        [("A", "C", 1, "Yield", u, 5000.0) for u in ("kg/ha", "hg/ha", "100 mg/ha", "t/ha", "lb/acre")]
        + [("A", "C", 1, "Production", "t", 7.0)]
    )
    got = [(r.Unit, r.Value) for r in normalize_yields(rows).collect()]
    assert got == [
        ("kg/ha", 5000.0), ("kg/ha", 500.0), ("kg/ha", 0.5), ("kg/ha", 5000000.0), ("lb/acre", 5000.0), ("t", 7.0),
    ]


@pytest.mark.parametrize(
    "text, safe",
    [
        ("=1+1", "'=1+1"), (" +1", "' +1"), (" -1", "' -1"), ("\x1f-1", "'\x1f-1"), ("@x", "'@x"),
        ("a=1", "a=1"), ("", ""), (None, None), ("x\n=1", "x\n=1"), ("\n=1", "'\n=1"),
    ],
)
def test_formula_safe(spark, text, safe):
    assert one(spark, formula_safe(F.lit(text).cast("string"))) == safe


def test_as_text_has_no_exponent(spark):
    df = spark.createDataFrame([(12345678.9,), (100.0,), (0.5,), (None,)], "v double")
    assert [r.x for r in df.select(as_text(df, "v").alias("x")).collect()] == ["12345678.9", "100.0", "0.5", None]


@pytest.mark.parametrize(
    "text, hits", [("[", 1), ("SSE", 1), ("straße", 1), ("bc", 0), ("12345678.9", 1), ("nan", 0), ("", 3)]
)
def test_literal_search(spark, text, hits):
    df = spark.createDataFrame(
        [("a[b", "c", 1.0), ("Straße", None, None), ("x", "y", 12345678.9)], "p string, q string, v double"
    )
    assert literal_search(df, text).count() == hits


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=40))
def test_value_ladder_keeps_the_order(spark, numbers):
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    coarse, fine = values.value_ladder(F.col("v"))
    rows = sorted(df.select("v", coarse.alias("c"), fine.alias("f")).collect(), key=lambda r: r.v)
    steps = [(tuple(r.c), r.f) for r in rows]
    assert steps == sorted(steps)
