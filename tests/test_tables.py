"""From bulk files to reports: both stores must answer alike."""

import pytest
from pyspark.sql import functions as F

from obsmill.operators.selection import canonical_order
from obsmill.plans import queries, reports
from obsmill.sources import bulk, star
from obsmill.sources.domains import DomainStore
from obsmill.sources.release import ReleaseStore, row_differences
from obsmill.sources.workspace import new_folder
from obsmill.tables import BulkTables, PreparedTables

FOLDER = "/root/testdata/sf0.001"
AREAS, ITEMS = ["NATION_3", "NATION_20"], ["ECONOMY", "LARGE"]


@pytest.fixture(scope="module")
def tables(spark):
    domains = DomainStore(spark, new_folder(spark, "domains"))
    for code, rows in {"QCL": star.crops, "PP": star.prices, "TCL": star.trade}.items():
        folder = new_folder(spark, code)
        bulk.write_bulk(rows(spark, FOLDER).drop("Domain"), folder, code)
        domains.ensure({"code": code, "name": code, "updated": "2001"}, folder)
    releases = ReleaseStore(spark, new_folder(spark, "releases"))
    releases.ensure(lambda: (domains.observations(), domains.metadata()))
    return BulkTables(domains), PreparedTables(releases)


def values(df, column):
    return sorted(r[column] for r in df.collect())


@pytest.mark.parametrize("code", ["QCL", "PP", "TCL"])
def test_selections_agree(tables, code):
    whole, prepared = tables
    chosen = dict(areas=AREAS, items=ITEMS, years=(1996, 1999))
    a = whole.query(code, **chosen)
    b = prepared.query(code, **chosen).select(*a.columns)
    assert row_differences(a, b).isEmpty() and not a.isEmpty()
    assert {r.Area for r in b.collect()} == set(AREAS) and {r.Item for r in b.collect()} == set(ITEMS)
    assert code != "PP" or values(b.select("Months").distinct(), "Months") == ["Annual value"]
    rows = a.orderBy(*canonical_order()).collect()
    assert rows == sorted(rows, key=lambda r: (r.Area, r.Item, r.Element, r.Year))
    for empty in (dict(areas=[]), dict(items=[]), dict(elements=[]), dict(items=["None such"])):
        assert prepared.query(code, **empty).isEmpty() and whole.query(code, **empty).isEmpty()


def test_options_agree(tables):
    whole, prepared = tables
    for areas in (None, AREAS, []):
        assert values(whole.available_items("QCL", areas), "Item") == values(prepared.available_items("QCL", areas), "Item")
    assert "PROMO" not in values(prepared.available_items("TCL"), "Item")
    assert "PROMO" in values(whole.available_items("TCL"), "Item")
    for code in ("QCL", "TCL"):
        assert values(whole.available_years(code, AREAS, ITEMS), "Year") == values(prepared.available_years(code, AREAS, ITEMS), "Year")
    assert values(prepared.available_years("PP", AREAS, ITEMS), "Year") == list(range(1995, 2002))
    assert values(whole.area_table(), "Area") == values(prepared.area_table(), "Area")
    assert values(prepared.dimensions().where("dimension = 'item'"), "member") == values(prepared.available_items(), "Item")


def test_metadata_counts_the_whole_domain(tables):
    whole, prepared = tables
    got = {r.code: r["rows"] for r in prepared.metadata().collect()}
    assert got == {code: whole.rows(code).count() for code in ("QCL", "PP", "TCL")}
    assert prepared.stale(whole.metadata().withColumn("updated", F.lit("2002"))).where("stale").count() == 3
    assert prepared.stale(whole.metadata()).where("stale").isEmpty()


def test_answers_stay_with_one_release(tables):
    _, prepared = tables
    before = prepared.release
    prepared.store.publish(star.observations(prepared.store.spark, FOLDER).where("Item = 'SMALL'"), prepared.metadata())
    assert prepared.store.current() != before
    assert values(prepared.available_items(), "Item") == ["ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD"]
    assert values(PreparedTables(prepared.store).available_items(), "Item") == ["SMALL"]


def test_unknown_domain(tables):
    for t in tables:
        with pytest.raises(ValueError, match="unknown"):
            t.query("XX")


def test_frames_of_all_domains(tables):
    whole, prepared = tables
    frames, problems = prepared.frames(AREAS, ITEMS, (1996, 1999))
    assert set(frames) == {"QCL", "PP", "TCL"} and problems.isEmpty()
    assert not any(frame.isEmpty() for frame in frames.values())
    assert values(frames["TCL"].select("Element").distinct(), "Element") == [
        "Export quantity", "Export value", "Import quantity", "Import value",
    ]


def test_key_figures_from_the_release_equal_those_from_the_source(spark, tables):
    _, prepared = tables
    got = reports.kpi_summary(
        prepared.rows("QCL"), prepared.rows("PP"), queries._countries(spark, FOLDER),
        [queries.KPI_AREA], [queries.KPI_ITEM], queries.PERIOD,
    )
    expected = queries.registry()["kpi_summary"](spark, FOLDER)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)
