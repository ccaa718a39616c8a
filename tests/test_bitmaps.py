"""Bitmaps of years and items against plain sets."""

from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from obsmill.operators import bitmaps
from obsmill.operators.selection import Selection, availability, available_items

ROWS = "Area string, Item string, Element string, Year int"
BY = ["Area", "Item", "Element"]
YEARS = [-33, -32, -1, 0, 31, 32, 63, 64, 1951, 1952, 1983, 1984, 2000, None]


def words_of(spark, rows):
    return bitmaps.year_bits(spark.createDataFrame(rows, ROWS), BY)


def held(frame, column):
    rows = [r[column] for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


row = st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y", None]), st.sampled_from(["e", "f"]), st.sampled_from(YEARS))
period = st.none() | st.tuples(*[st.sampled_from([y for y in YEARS if y is not None])] * 2)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, max_size=30), years=period)
def test_options_equal_those_of_sets(spark, rows, years):
    words = words_of(spark, rows).cache()
    for areas, elements in product((None, ["a"], []), (None, ["e"])):
        own = [r for r in rows if (areas is None or r[0] in areas) and (elements is None or r[2] in elements)]
        inside = [r for r in own if years is None or (r[3] is not None and years[0] <= r[3] <= years[1])]
        chosen = Selection(areas, None, elements, years)
        assert held(bitmaps.years_offered(words, chosen), "Year") == {r[3] for r in inside} - {None}
        assert held(bitmaps.items_offered(words, chosen), "Item") == {r[1] for r in inside} - {None}
    expected = {("all", None): {r[3] for r in rows}} if rows else {}
    for i, kind in enumerate(("area", "item", "element")):
        for r in rows:
            if r[i] is not None:
                expected.setdefault((kind, r[i]), set()).add(r[3])
    got = {(r.dimension, r.member): (r.min_year, r.max_year, r.n_years) for r in bitmaps.member_years(words).collect()}
    plain = {k: sorted(v - {None}) for k, v in expected.items()}
    assert got == {k: (v[0], v[-1], len(v)) if v else (None, None, 0) for k, v in plain.items()}
    words.unpersist()


def test_periods_of_every_extent(spark):
    years = list(range(-70, 71))
    words = words_of(spark, [("a", "x", "e", y) for y in years]).cache()
    for first, last in ((-70, 70), (-64, -33), (-33, -31), (0, 0), (31, 32), (32, 63), (5, 4), (71, 90), (-90, -71), (-90, 90)):
        got = held(bitmaps.years_offered(words, Selection(years=(first, last))), "Year")
        assert got == {y for y in years if first <= y <= last}
    words.unpersist()


@pytest.mark.parametrize("areas", [None, ["a1"], ["a1", "a2"], []])
def test_items_of_many_areas(spark, observe, areas, tmp_path):
    rows = [(f"a{i % 5}", f"crop {i}", 2000, "Area harvested", "ha", 1.0) for i in range(150)]
    rows += [(f"a{i % 3}", f"crop {i}", 2001, "Production", "t", 1.0) for i in range(150, 180)]
    crops = observe(rows)
    index = availability(crops, crops.select("Item").distinct())
    bitmaps.numbered(crops.select("Item")).write.parquet(str(tmp_path / "numbers"))
    numbers = spark.read.parquet(str(tmp_path / "numbers"))
    words = bitmaps.item_bits(index, numbers)
    chosen = words if areas is None else words.where(words.Area.isin(areas))
    got = held(bitmaps.items_of(bitmaps.merged_bits(chosen), numbers), "Item")
    assert got == held(available_items(index, areas), "Item")
    assert (len(got) == 150) == (areas is None)
