import pytest
from pyspark.sql import functions as F

from obsmill.operators import selection
from obsmill.operators.selection import Selection, apply_selection
from obsmill.schema import CPC_COLUMN, M49_COLUMN


def facts(spark):
    return spark.createDataFrame(
        [
            ("A", "'100", "Wheat", "'0111", "Area harvested", 2000),
            ("A", "'100", "Wheat", "'0111", "Production", 1999),
            ("A", "'100", "Cereals", "'F1717", "Area harvested", 2000),
            ("B", "'200", "Maize", None, "Area harvested", 2001),
            ("B", "'200", "Rice", "'0113", "Production", 1995),
            ("C", "'300", "Rice", "'0113", "Area harvested", 1996),
            ("C", "'300", "Rice", "'0113", "Stocks", 1990),
        ],
        f"Area string, `{M49_COLUMN}` string, Item string, `{CPC_COLUMN}` string, Element string, Year int",
    ).withColumns({"Unit": F.lit("t"), "Value": F.lit(None).cast("double")})


def test_none_is_everything_and_empty_is_nothing(sample):
    assert apply_selection(sample, Selection()).count() == 6
    assert apply_selection(sample, Selection(items=[])).count() == 0
    assert apply_selection(sample, Selection(areas=[])).count() == 0
    chosen = Selection(["A", "B"], ["Crop"], ["Yield"], (2020, 2024))
    assert apply_selection(sample, chosen).count() == 2
    assert apply_selection(sample, Selection(items=["Other"])).count() == 0


def test_empty_selection_reads_nothing(spark, sample):
    plan = apply_selection(sample, Selection(items=[]))._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan <empty>" in plan


def test_long_lists_become_a_semi_join(sample):
    many = [f"x{i}" for i in range(selection.MAX_IN_LITERALS)] + ["A", "A"]
    rows = apply_selection(sample, Selection(areas=many))
    assert rows.count() == 3
    assert "LeftSemi" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_annual_prices_only(spark, observe):
    rows = observe([("A", "Crop", 2024, "Producer Price (USD/tonne)", "USD", v) for v in (1.0, 2.0, 3.0)])
    rows = rows.withColumn("Months", F.when(F.col("Value") == 1, "Annual value").when(F.col("Value") == 2, "M1"))
    assert [r.Value for r in selection.select_observations(rows, "PP", Selection()).collect()] == [1.0]


def test_primary_items_leave_out_groups_and_uncoded(spark):
    assert {r.Item for r in selection.primary_items(facts(spark)).collect()} == {"Wheat", "Rice"}


def test_availability(spark):
    got = {(r.Area, r.Item): (r.Years, r.harvested) for r in selection.availability(facts(spark)).collect()}
    assert got == {
        ("A", "Wheat"): ([1999, 2000], True), ("B", "Rice"): ([1995], False), ("C", "Rice"): ([1996], True),
    }


@pytest.mark.parametrize("areas, items", [(None, {"Wheat", "Rice"}), (["B"], set()), (["A", "B"], {"Wheat"}), ([], set())])
def test_available_items(spark, areas, items):
    index = selection.availability(facts(spark))
    assert {r.Item for r in selection.available_items(index, areas).collect()} == items


def test_available_years(spark):
    index = selection.availability(facts(spark))
    years = lambda *a: sorted(r.Year for r in selection.available_years(index, *a).collect())
    assert years() == [1995, 1996, 1999, 2000]
    assert years(["A"], ["Wheat"]) == [1999, 2000]
    on_record = selection.years_on_record(facts(spark), Selection(elements=["Stocks"]))
    assert [r.Year for r in on_record.collect()] == [1990]


def test_dimensions(spark):
    rows = selection.dimensions(facts(spark)).collect()
    members = {d: sorted(r.member for r in rows if r.dimension == d) for d in ("area", "item", "element")}
    assert members == {
        "area": ["A", "B", "C"], "item": ["Cereals", "Maize", "Rice", "Wheat"],
        "element": ["Area harvested", "Production", "Stocks"],
    }
    (whole,) = (r for r in rows if r.dimension == "all")
    assert (whole.member, whole.min_year, whole.max_year) == (None, 1990, 2001)
    assert (min(r.min_year for r in rows), max(r.max_year for r in rows)) == (1990, 2001)


@pytest.mark.parametrize("years, period", [([1995, 2003, 2007], (2003, 2007)), ([1995, 1997], (1995, 1997)), ([2004], (2004, 2004))])
def test_default_period(spark, years, period):
    df = spark.createDataFrame([(y,) for y in years], "Year int")
    assert tuple(selection.default_period(df).first()) == period


def test_default_item(spark):
    df = spark.createDataFrame([("Wheat",), ("Maize",)], "Item string")
    assert selection.default_item(df, "Wheat").first().Item == "Wheat"
    assert selection.default_item(df, "Cocoa").first().Item == "Maize"


def test_canonical_order_puts_nulls_last(observe):
    rows = observe([(a, "I", 1, "E", "t", 1.0) for a in (None, "B", "A")])
    assert [r.Area for r in rows.orderBy(*selection.canonical_order()).collect()] == ["A", "B", None]
