import pytest

from obsmill.operators import geography
from obsmill.schema import M49_COLUMN, UNCLASSIFIED

SOURCE = "UNcode int, ISOnumeric int, ISO3 string, continent string, UNregion string"


def lookup(spark):
    return geography.geography_lookup(
        spark.createDataFrame(
            [
                (218, 218, "ECU", "America", "South America"),
                (None, 158, "TWN", "Asia", "Eastern Asia"),
                (218, None, "ZZZ", "America", "Elsewhere"),
                (None, None, "NIL", "Asia", "Nowhere"),
                (10, None, "ATA", None, None),
            ],
            SOURCE,
        ),
        {"America": "The Americas"},
    )


def areas(spark):
    return spark.createDataFrame(
        [("Ecuador", "'218"), ("Ecuador", "'999"), ("Taiwan", "'158"), ("Antarctica", "'010"), ("Africa", "'002"), ("Odd", "abc")],
        f"Area string, `{M49_COLUMN}` string",
    )


def test_lookup_falls_back_drops_and_deduplicates(spark):
    got = {r.M49: (r.ISO3, r.Continent) for r in lookup(spark).collect()}
    assert got == {218: ("ECU", "The Americas"), 158: ("TWN", "Asia"), 10: ("ATA", None)}


def test_unmatched_areas_stay_unclassified(spark):
    rows = geography.enrich_geography(areas(spark), lookup(spark)).collect()
    got = {(r.Area, r[M49_COLUMN]): (r.M49, r.ISO3, r.Continent, r.Region) for r in rows}
    assert got[("Africa", "'002")] == (2, None, UNCLASSIFIED, UNCLASSIFIED)
    assert got[("Odd", "abc")] == (None, None, UNCLASSIFIED, UNCLASSIFIED)
    assert got[("Antarctica", "'010")] == (10, "ATA", UNCLASSIFIED, UNCLASSIFIED)
    assert len(rows) == 6


def test_existing_geography_is_replaced(spark):
    once = geography.enrich_geography(areas(spark), lookup(spark))
    assert sorted(geography.enrich_geography(once, lookup(spark)).columns) == sorted(once.columns)


def test_without_codes_everything_is_unclassified(spark):
    row = geography.enrich_geography(areas(spark).select("Area"), lookup(spark)).first()
    assert (row.ISO3, row.Continent, row.Region) == (None, UNCLASSIFIED, UNCLASSIFIED)


def test_countries_have_a_code_and_one_row(spark):
    both = areas(spark).union(spark.createDataFrame([("Taiwan", "'218")], "a string, c string"))
    rows = geography.country_areas(geography.enrich_geography(both, lookup(spark))).collect()
    assert {r.Area: r.M49 for r in rows} == {"Ecuador": 218, "Taiwan": 158, "Antarctica": 10}


def test_scope(spark):
    countries = geography.country_areas(geography.enrich_geography(areas(spark), lookup(spark)))
    names = lambda *a: sorted(r.Area for r in geography.scope_areas(countries, *a).collect())
    assert names() == ["Antarctica", "Ecuador", "Taiwan"]
    assert names("Asia") == ["Taiwan"]
    assert names("The Americas", "South America") == ["Ecuador"]
    assert names(None, None, ["Taiwan"]) == ["Taiwan"]
    assert names("Asia", None, ["Ecuador"]) == []
    assert names("Asia", None, []) == ["Taiwan"]


def test_a_code_that_comes_twice_is_refused(spark):
    lookup = spark.createDataFrame([(4, "AFG", "Asia", "S"), (4, "XXX", "Asia", "S")], "M49 int, ISO3 string, Continent string, Region string")
    areas = spark.createDataFrame([("A", "'004")], f"Area string, `{M49_COLUMN}` string")
    with pytest.raises(Exception, match="more than one row for code 4"):
        geography.enrich_geography(areas, lookup).collect()
    assert geography.enrich_geography(areas, lookup.limit(1)).first().ISO3 == "AFG"
