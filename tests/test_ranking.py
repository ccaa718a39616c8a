import random

import pytest

from obsmill.operators import ranking
from obsmill.operators.ranking import rank_of, shares_and_ranks, top_area, top_rows, with_rank


def population(spark, rows, year=2024):
    return spark.createDataFrame([(a, year, "t", v) for a, v in rows], "Area string, Year int, Unit string, Value double")


def test_ties_share_a_rank_and_shares_are_of_the_whole(spark):
    rows = population(spark, [("A", 40.0), ("B", 40.0), ("C", 20.0), ("D", None)])
    got = shares_and_ranks(rows, ["Year", "Unit"]).orderBy("rank", "Area").collect()
    assert [(r.Area, r["rank"], r.share_pct) for r in got] == [("A", 1, 40.0), ("B", 1, 40.0), ("C", 3, 20.0)]
    assert shares_and_ranks(rows, []).count() == 3
    top = shares_and_ranks(rows, ["Year"]).orderBy("rank", "Area").limit(1).first()
    assert top.share_pct == 40.0


def test_share_of_a_zero_total_is_missing(spark):
    assert shares_and_ranks(population(spark, [("A", 0.0)]), ["Year"]).first().share_pct is None


@pytest.fixture(params=[ranking.CROWDED, 5, 0])
def crowded(request, monkeypatch):
    """Ranks by sorted buckets, by both ways, and by counted values only."""
    monkeypatch.setattr(ranking, "CROWDED", request.param)


def test_rank_against_counting_greater_values(spark, crowded):
    random.seed(5)
    pool = [0.0, -0.0, 1.0, -1.0, 1e300, -1e300, 5e-324, 0.1, 0.30000000000000004, 0.3, 7.0, float("inf")]
    rows = [(f"a{i}", random.choice(pool + [random.gauss(0, 100) for _ in range(10)])) for i in range(400)]
    got = {r.Area: r["rank"] for r in with_rank(population(spark, rows), ["Year", "Unit"]).collect()}
    assert got == {a: 1 + sum(w > v for _, w in rows) for a, v in rows}


def test_null_groups_are_ranked(spark, crowded):
    rows = spark.createDataFrame([("A", None, 1.0), ("B", None, 2.0), ("C", "t", 1.0)], "Area string, Unit string, Value double")
    got = {r.Area: (r["rank"], r.share_pct) for r in shares_and_ranks(rows, ["Unit"]).collect()}
    assert got["B"][0] == 1 and got["A"][0] == 2 and got["C"] == (1, 100.0)


def test_top_rows_break_the_tie_by_area_and_keep_ranks(spark):
    rows = population(spark, [("C", 5.0), ("A", 5.0), ("B", 9.0), ("D", 5.0), ("E", None)])
    got = top_rows(rows, ["Year"], 2).orderBy("rank", "Area").collect()
    assert [(r.Area, r["rank"]) for r in got] == [("B", 1), ("A", 2)]


def test_top_rows_limits_before_the_shuffle(spark):
    rows = population(spark, [("A", 1.0)]).repartition(3)
    plan = top_rows(rows, ["Year"], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_top_area(spark):
    rows = population(spark, [("B", 5.0), ("A", 5.0), ("C", 1.0), ("D", None)])
    assert tuple(top_area(rows, ["Year"]).first()) == (2024, "A", 5.0)


@pytest.mark.parametrize("area, rank", [("A", 1), ("B", 1), ("C", 3)])
def test_rank_of_one_area(spark, area, rank):
    rows = population(spark, [("A", 40.0), ("B", 40.0), ("C", 20.0)])
    assert rank_of(rows, area, ["Year"]).first()["rank"] == rank


def test_rank_of_an_absent_area_has_no_row(spark):
    assert rank_of(population(spark, [("A", 1.0)]), "Z", ["Year"]).isEmpty()
