import pytest
from pyspark.sql import functions as F

from obsmill.plans import reports
from obsmill.schema import AGGREGATE_FLAG


def countries(spark, *names):
    return spark.createDataFrame([(n, i + 1, n + "XX") for i, n in enumerate(names)], "Area string, M49 int, ISO3 string")


def prices(observe, n=1):
    rows = [("A", "Crop", 2024, "Producer Price (USD/tonne)", "USD", 5601.5)] * n
    return observe(rows).withColumn("Months", F.lit("Annual value"))


def history(observe):
    return observe(
        [("A", "Crop", 2023, "Production", "t", 8.0), ("A", "Crop", 2023, "Yield", "kg/ha", 4000.0),
         ("World", "Crop", 2024, "Production", "t", 200.0)]
    )


def kpis(spark, observe, sample, **change):
    arguments = dict(
        crops=sample.unionByName(history(observe)), prices=prices(observe), countries=countries(spark, "A", "B"),
        areas=["A"], items=["Crop"], years=(2023, 2024),
    )
    return {r.kpi: (r.value, r.unit, r.change_pct) for r in reports.kpi_summary(**{**arguments, **change}).collect()}


def test_key_figures_of_one_area(spark, observe, sample):
    assert kpis(spark, observe, sample) == {
        "production": (10.0, "t", 25.0), "harvested_area": (2.0, "ha", None), "yield": (5000.0, "kg/ha", 25.0),
        "producer_price": (5601.5, "USD/t", None), "world_production_share": (5.0, "%", None), "world_rank": (2.0, "rank", None),
    }


def test_change_needs_the_year_before_inside_the_period(spark, observe, sample):
    got = kpis(spark, observe, sample, years=(2024, 2024))
    assert {k: v[2] for k, v in got.items()} == dict.fromkeys(got)


def test_price_and_rank_need_one_country(spark, observe, sample):
    got = kpis(spark, observe, sample, areas=["A", "B"])
    assert got["producer_price"][0] is None and got["world_rank"][0] is None
    assert got["yield"][0] == 20000.0 and got["world_production_share"][0] == 50.0
    assert kpis(spark, observe, sample, prices=prices(observe, 2))["producer_price"][0] is None


def test_last_year_is_not_replaced(spark, observe, sample):
    got = kpis(spark, observe, sample, years=(2024, 2025))
    assert [got[k][0] for k in ("production", "yield", "world_rank", "world_production_share")] == [None] * 4


def many(observe, n):
    return observe([(f"a{i}", "Crop", 2024, "Production", "t", 1.0) for i in range(n)])


@pytest.mark.parametrize("count", [1, 30])
def test_the_level_alone_sets_the_grain_of_a_history(observe, count):
    rows = reports.history_series(many(observe, count), "Production").collect()
    assert len(rows) == count and {r.flag for r in rows} == {None} and rows[0].series.endswith(" · Crop")
    (row,) = reports.history_series(many(observe, count), "Production", level="item").collect()
    assert (row.series, row.Area, row.Value, row.flag) == ("Crop", None, float(count), AGGREGATE_FLAG)


def test_unknown_levels_are_refused(sample):
    with pytest.raises(ValueError, match="level"):
        reports.history_series(sample, "Production", level="world")


def test_a_history_without_values_has_none(observe):
    rows = many(observe, 3).withColumn("Value", F.lit(None).cast("double"))
    assert {r.Value for r in reports.history_series(rows, "Production").collect()} == {None}
    assert reports.series_guard(rows).first().n_values == 0


def test_source_flags_are_kept(observe):
    rows = many(observe, 1).withColumn("Flag", F.lit("E"))
    assert reports.history_series(rows, "Production").first().flag == "E"


def test_trade_series_of_both_levels(observe):
    few = observe([("A", "Crop", 2024, "Import value", "1000 USD", 3.0)])
    crowd = observe([(f"a{i}", "Crop", 2024, "Export value", "1000 USD", 1.0) for i in range(21)])
    rows = few.unionByName(crowd)
    assert reports.trade_series(rows).count() == 22
    got = {(r.Element, r.series): r.Value for r in reports.trade_series(rows, level="item").collect()}
    assert got == {("Import value", "Crop"): 3.0, ("Export value", "Crop"): 21.0}


def test_share_without_world_total_is_missing(spark, observe, sample):
    assert {r.share_pct for r in reports.production_share(sample, countries(spark, "A", "B")).collect()} == {None}
    zero = sample.unionByName(observe([("World", "Crop", 2024, "Production", "t", 0.0)]))
    assert {r.share_pct for r in reports.production_share(zero, countries(spark, "A", "B")).collect()} == {None}


def test_top_shares_keep_the_world_denominator(spark, observe, sample):
    rows = sample.unionByName(history(observe))
    shares = reports.production_share(rows.where("Year = 2024"), countries(spark, "A", "B"))
    (top,) = reports.top_shares(shares, 1).collect()
    assert (top.Area, top.share_pct, top["rank"]) == ("B", 45.0, 1)


def test_world_ranking_counts_countries_in_one_unit(spark, observe, sample):
    rows = sample.unionByName(
        observe([("World", "Crop", 2024, "Production", "t", 900.0), ("B", "Crop", 2024, "Production", "kg", 9e9)])
    )
    got = reports.world_ranking(rows, countries(spark, "A", "B"), "Production", (2024, 2024), ["A"]).collect()
    assert {(r.Area, r["rank"], r.share_pct, r.in_selection) for r in got} == {("B", 1, 90.0, False), ("A", 2, 10.0, True)}


def test_comparisons_need_two(spark, observe, sample):
    assert reports.country_comparison(sample).count() == 6
    assert reports.country_comparison(sample.where("Area = 'A'")).isEmpty()
    assert reports.crop_comparison(sample, "Yield").isEmpty()
    other = sample.unionByName(observe([("A", "Other", 2024, "Yield", "t/ha", 1.0)]))
    assert {(r.Item, r.Area, r.Value) for r in reports.crop_comparison(other, "Yield").collect()} == {
        ("Crop", "A", 5000.0), ("Crop", "B", 30000.0), ("Other", "A", 1000.0),
    }


def test_map_values(spark, observe):
    values = observe([("A", "", 1, "", "t", 0.5), ("B", "", 1, "", "t", None), ("Z", "", 1, "", "t", 9.0), ("A", "", 2, "", "t", 7.0)])
    got = reports.map_values(values, countries(spark, "A", "B")).collect()
    assert {(r.Area, r.Year, r.ISO3, r.color_max) for r in got} == {("A", 1, "AXX", 1.0), ("A", 2, "AXX", 7.0)}


def test_missing_items(spark, observe):
    requested = spark.createDataFrame([("Crop",), ("Gone",), ("Blank",)], "Item string")
    facts = observe([("A", "Crop", 1, "Yield", "t", 0.0), ("A", "Blank", 1, "Yield", "t", None)])
    assert {r.Item for r in reports.missing_items(requested, facts).collect()} == {"Gone", "Blank"}
    by = reports.missing_items_by_domain(requested, facts.withColumn("Domain", F.lit("PP")), ["TCL", "PP"])
    assert {(r.Domain, r.Item) for r in by.collect()} == {
        ("TCL", "Crop"), ("TCL", "Gone"), ("TCL", "Blank"), ("PP", "Gone"), ("PP", "Blank"),
    }


@pytest.mark.parametrize(
    "question, element, intent",
    [
        ("¿Cuál es el MAYOR productor?", "Production", "top"),
        ("¿creció el rendimiento?", "Yield", "growth"),
        ("ranking", "Area harvested", "top"),
        ("¿Aumentó?", "Area harvested", "growth"),
        ("rendimiento", "Yield", "top"),
        ("productor con mayor rendimiento", "Production", "top"),
        ("hola", "Area harvested", "count"),
    ],
)
def test_intents(spark, question, element, intent):
    df = spark.createDataFrame([(question,), ("   ",), ("\t\n\u2003",), ("",)], "q string")
    (row,) = reports.question_intents(df, "q", "Area harvested").collect()
    assert (row.element, row.intent) == (element, intent)


def test_answers(spark, observe, sample):
    df = spark.createDataFrame([("mayor productor",), ("creció el productor",), ("aumento",), ("hola",)], "q string")
    crops = sample.unionByName(observe([("A", "Crop", 2023, "Production", "t", 50.0)]))
    rows = reports.answered_questions(df, "q", crops, "Area harvested", 2024).collect()
    got = {r.q: (r.answer_area, r.answer_value, r.from_year, r.to_year, r.change_pct, r.n_rows) for r in rows}
    assert got == {
        "mayor productor": ("B", 90.0, None, 2024, None, None),
        "creció el productor": (None, None, 2023, 2024, 100.0, None),
        "aumento": (None, None, None, None, None, None),
        "hola": (None, None, None, None, None, 7),
    }


def test_price_rule(observe):
    assert reports.kpi_price(prices(observe)).first().price == 5601.5
    assert reports.kpi_price(prices(observe, 2)).first().price is None
    assert reports.kpi_price(prices(observe, 1).where("false")).first().price is None
