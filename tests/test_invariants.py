"""Random frames against brute force in plain Python, and laws that must hold."""

from collections import defaultdict
from math import isclose

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obsmill.operators.measures import normalize_yields, weighted_yield
from obsmill.operators import ranking
from obsmill.operators.ranking import shares_and_ranks, top_rows
from obsmill.operators.trade import trade_balance
from obsmill.plans import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def restore_limits(monkeypatch):
    monkeypatch.setattr(ranking, "CROWDED", ranking.CROWDED)


quick = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

key = st.tuples(st.sampled_from(["A", "B", "C", None]), st.sampled_from(["I", "J"]), st.integers(2000, 2002))
cell = st.tuples(
    st.sampled_from(["Production", "Area harvested", "Yield"]),
    st.sampled_from([None, 0.0, 1.0, 2.5, 40.0, 1000.0]),
)
UNITS = {"Production": "t", "Area harvested": "ha", "Yield": "hg/ha"}


def rows_of(cells):
    return [(a, i, y, e, UNITS[e], v) for (a, i, y), found in cells.items() for e, v in dict(found).items()]


@quick
@given(st.dictionaries(key, st.lists(cell, min_size=1, max_size=3), min_size=1, max_size=15), st.sampled_from([["Year"], ["Area"], ["Area", "Year"], ["Item", "Year"]]))
def test_weighted_yield_against_brute_force(observe, cells, groups):
    position = {"Area": 0, "Item": 1, "Year": 2}
    members = defaultdict(list)
    for k, found in cells.items():
        found = dict(found)
        published = found.get("Yield")
        members[tuple(k[position[g]] for g in groups)].append(
            (None if published is None else published * 0.1, found.get("Area harvested"))
        )
    expected = {}
    for group, pairs in members.items():
        if len(pairs) == 1:
            expected[group] = pairs[0][0]
        elif all(y is not None and a is not None and a > 0 for y, a in pairs):
            expected[group] = sum(y * a for y, a in pairs) / sum(a for _, a in pairs)
        else:
            expected[group] = None
    got = {tuple(r[g] for g in groups): r.Value for r in weighted_yield(observe(rows_of(cells)), groups).collect()}
    assert got.keys() == expected.keys()
    for group, value in expected.items():
        assert got[group] is None if value is None else isclose(got[group], value, rel_tol=1e-9, abs_tol=1e-9)


@quick
@given(st.lists(st.tuples(st.integers(2000, 2002), st.one_of(st.none(), st.sampled_from([0.0, 1.0, 5.0, 5.5]), st.floats(-1e6, 1e6))), min_size=1, max_size=40), st.booleans(), st.sampled_from([0, 3, 1000]))
def test_ranks_and_shares_against_brute_force(spark, population, small, crowded):
    ranking.CROWDED = crowded
    rows = [(f"a{i}", year, value) for i, (year, value) in enumerate(population)]
    df = spark.createDataFrame(rows, "Area string, Year int, Value double")
    got = {r.Area: (r["rank"], r.share_pct) for r in shares_and_ranks(df, ["Year"], small=small).collect()}
    assert len(got) == sum(v is not None for _, _, v in rows)
    for area, year, value in rows:
        if value is None:
            continue
        peers = [v for _, y, v in rows if y == year and v is not None]
        rank, share = got[area]
        assert rank == 1 + sum(v > value for v in peers)
        total = sum(peers)
        if abs(total) > 1e-6:
            assert share is None if total < 0 else isclose(share, value / total * 100, rel_tol=1e-6, abs_tol=1e-6)


@pytest.mark.parametrize("n", [1, 3, 50])
def test_top_rows_are_the_head_of_the_ranking(spark, n):
    df = spark.createDataFrame([(f"a{i:02}", i % 2, float(i * 7 % 10)) for i in range(40)], "Area string, Year int, Value double")
    ranked = shares_and_ranks(df, ["Year"]).orderBy("Year", "rank", "Area").collect()
    head = [r for y in (0, 1) for r in [x for x in ranked if x.Year == y][:n]]
    got = top_rows(df, ["Year"], n).orderBy("Year", "rank", "Area").collect()
    assert [(r.Year, r.Area, r["rank"]) for r in got] == [(r.Year, r.Area, r["rank"]) for r in head]


def test_shares_of_a_group_add_up(spark):
    rows = queries.registry()["shares_and_ranks"](spark, FOLDER).groupBy("Item", "Year", "Unit")
    assert all(isclose(r.s, 100, rel_tol=1e-9) for r in rows.agg(F.sum("share_pct").alias("s")).collect())


def test_balance_is_missing_exactly_when_a_flow_is(spark):
    rows = queries.registry()["trade_balance"](spark, FOLDER)
    wrong = F.col("trade_balance").isNull() != (F.col("export_value").isNull() | F.col("import_value").isNull())
    assert rows.where(wrong).isEmpty() and not rows.where("trade_balance is null").isEmpty()


def test_weighted_yield_lies_between_its_members(spark):
    crops = queries._crops(spark, FOLDER)
    members = normalize_yields(crops).where("Element = 'Yield'").groupBy("Area", "Year").agg(
        F.min("Value").alias("lo"), F.max("Value").alias("hi")
    )
    rows = weighted_yield(crops, ["Area", "Year"]).where("Value is not null").join(members, ["Area", "Year"])
    outside = (F.col("Value") < F.col("lo") - 1e-6) | (F.col("Value") > F.col("hi") + 1e-6)
    assert rows.count() > 0 and rows.where(outside).isEmpty()


def test_balance_does_not_depend_on_the_order_of_rows(observe):
    rows = [("A", "I", 2000, e, "1000 USD", 0.1 * k) for k in range(30) for e in ("Export value", "Import value")]
    a, b = (trade_balance(observe(r)).first() for r in (rows, rows[::-1]))
    assert a == b and a.trade_balance == 0.0
