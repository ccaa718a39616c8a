import math

from obsmill.operators.change import period_change, series_growth, yoy_change
from obsmill.operators.trade import trade_balance, trade_by_item


def yearly(spark, rows):
    return spark.createDataFrame(rows, "Area string, Unit string, Year int, Value double")


def test_change_needs_the_very_year_before(spark):
    rows = yearly(spark, [("A", "t", y, v) for y, v in ((2000, 100.0), (2001, 110.0), (2003, 120.0), (2004, None), (2005, 1.0))])
    got = {r.Year: (r.previous, r.change_pct) for r in yoy_change(rows, ["Area", "Unit"]).collect()}
    assert got == {2000: (None, None), 2001: (100.0, 10.0), 2003: (None, None), 2004: (120.0, None), 2005: (None, None)}


def test_period_change_uses_first_and_last_value(spark):
    rows = yearly(
        spark,
        [("A", "t", 2000, None), ("A", "t", 2001, 50.0), ("A", "t", 2005, 75.0), ("A", "t", 2006, None), ("B", "t", 2000, 1.0),
         ("C", "t", 2000, 1.0), ("C", "kg", 2001, 9.0), ("D", "t", 2000, 0.0), ("D", "t", 2001, 5.0)],
    )
    got = {r.Area: (r.first_year, r.last_year, r.change_pct) for r in period_change(rows, ["Area"]).collect()}
    assert got == {"A": (2001, 2005, 50.0), "B": (2000, 2000, None), "C": (2000, 2001, None), "D": (2000, 2001, None)}


def test_growth_rate(spark):
    rows = yearly(spark, [("A", "t", 2000, 100.0), ("A", "t", 2002, 121.0), ("B", "t", 2000, 3.0)])
    got = {r.Area: r.cagr_pct for r in series_growth(rows, ["Area"]).collect()}
    assert math.isclose(got["A"], 10.0, rel_tol=1e-9) and got["B"] is None


def flows(observe):
    return observe(
        [
            ("A", "I", 2000, "Export value", "1000 USD", 10.0), ("A", "I", 2000, "Import value", "1000 USD", 4.0),
            ("B", "I", 2000, "Export value", "1000 USD", 7.0),
            ("C", "I", 2000, "Export value", "1000 USD", None), ("C", "I", 2000, "Import value", "1000 USD", None),
            ("D", "I", 2000, "Import value", "1000 USD", None), ("D", "I", 2000, "Export value", "1000 USD", 0.0),
            (None, "I", 2000, "Export value", "1000 USD", 1.0), ("A", "I", 2000, "Export quantity", "t", 99.0),
        ]
    )


def test_balance_has_no_filled_zeros(observe):
    got = {r.Area: (r.export_value, r.import_value, r.trade_balance) for r in trade_balance(flows(observe)).collect()}
    assert got == {"A": (10.0, 4.0, 6.0), "B": (7.0, None, None), "D": (0.0, None, None)}


def test_trade_by_item_drops_null_keys_only(observe):
    rows = flows(observe).unionByName(observe([("Z", None, 2000, "Export value", "1000 USD", 5.0)]))
    got = {r.Element: r.Value for r in trade_by_item(rows).collect()}
    assert got == {"Export value": 18.0, "Import value": 4.0, "Export quantity": 99.0}
