"""Releases that follow each other, their trees of fingerprints, stored states and the search index."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from obsmill.operators import measures, partials, selection
from obsmill.plans import queries
from obsmill.schema import CROP_UNITS, PRODUCTION, YIELD
from obsmill.sources import grams, release, star
from obsmill.sources.domains import DomainStore
from obsmill.sources.workspace import new_folder
from obsmill.tables import PreparedTables
from tests.test_sources import folders, metadata, observations

CROPS = ["c1", "c2", "c3", "c4"]


def crops(spark, **values):
    """Many rows of four crops; a crop named in `values` has this value in all of them."""
    base = observations(spark).where("Domain = 'QCL' and Item = 'x/1' and Element <> 'Stocks'")
    names = F.explode(F.array(*(F.lit(c) for c in CROPS)))
    rows = base.drop("Item", "Year").withColumn("Item", names).withColumn("Year", F.explode(F.sequence(F.lit(1900), F.lit(2100))))
    value = F.col("Value")
    for crop, own in values.items():
        value = F.when(F.col("Item") == crop, F.lit(own)).otherwise(value)
    return rows.withColumn("Value", value).select(*observations(spark).columns)


def listed(store, name):
    return {(r.owner, r.name) for r in store.table("files", name).collect()}


@pytest.fixture
def many_files(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_an_update_writes_only_files_of_changed_crops(spark, many_files):
    store = release.ReleaseStore(spark, new_folder(spark, "store"))
    first = store.publish(crops(spark), metadata(spark))
    second = store.update(crops(spark, c3=7.5), metadata(spark, "2025"))
    leaves = store.table("leaves", first)
    untouched = {(r.owner, r.name) for r in leaves.collect()} - {(r.owner, r.name) for r in leaves.where("Item = 'c3'").collect()}
    assert untouched and listed(store, second) & listed(store, first) == untouched
    rows = store.open().select(*crops(spark).columns)
    assert store.current() == second and release.row_differences(rows, crops(spark, c3=7.5)).isEmpty()
    assert store.mismatches(second).isEmpty()
    assert [tuple(r)[:2] for r in store.differing_items(first, second).collect()] == [("QCL", "c3")]

    # The tree's answer is that of comparing all rows, and all parts of files with the items that differ.
    content = ["Domain", "Item", "n_rows", "first", "second"]
    wrong = {r.Item for r in release.row_differences(store.open(first), store.open(second).select(*store.open(first).columns)).collect()}
    ours, theirs = (store.table("leaves", r).where(F.col("Item").isin(wrong)) for r in (first, second))
    expected = {(first, *r) for r in ours.join(theirs.select(*content), content, "left_anti").select("owner", "name").collect()}
    expected |= {(second, *r) for r in theirs.join(ours.select(*content), content, "left_anti").select("owner", "name").collect()}
    found = store.differing_files(first, second)
    assert {(r.release, r.owner, r.name) for r in found.collect()} == expected and len(expected) >= 2

    # All that is derived is that of a release written as a whole.
    whole = release.ReleaseStore(spark, new_folder(spark, "store"))
    whole.publish(crops(spark, c3=7.5), metadata(spark, "2025"))
    for table in ("availability", "crop_states", "price_states", "year_bits", "dimensions", "manifest", "totals", "areas", "items"):
        a, b = (s.table(table) for s in (store, whole))
        assert a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty(), table

    third = store.update(crops(spark, c3=7.5), metadata(spark, "2026"))
    assert listed(store, third) == listed(store, second) and store.table("changed", third).isEmpty()
    gone = store.update(crops(spark, c3=7.5).where("Item <> 'c1'"), metadata(spark))
    assert {r.Item for r in store.open(gone).select("Item").distinct().collect()} == {"c2", "c3", "c4"}
    fourth = store.update(crops(spark), metadata(spark), most_owners=1)
    assert {owner for owner, _ in listed(store, fourth)} == {fourth}


def test_a_failing_update_leaves_nothing(spark, monkeypatch):
    store = release.ReleaseStore(spark, new_folder(spark, "store"))
    first = store.publish(crops(spark), metadata(spark))
    write = release.write_rows
    monkeypatch.setattr(release, "write_rows", lambda rows, path: write(rows.where("Year <> 2000"), path))
    with pytest.raises(ValueError, match="rows of its source"):
        store.update(crops(spark, c2=1.5), metadata(spark))
    assert store.current() == first and folders(store) == [first]


def test_rows_are_counted_by_the_job_that_writes_them(spark, tmp_path):
    header = "Area,Item,Element,Year,Unit,Value"
    for name, cell in (("good", "1.5"), ("bad", "x")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a_Normalized.csv").write_text(f"{header}\nA,C,Yield,2000,t,2\nA,C,Yield,2001,t,{cell}\n")
    store = DomainStore(spark, new_folder(spark, "domains"))
    meta = {"code": "QCL", "name": "n", "updated": "2024"}
    store.load(meta, str(tmp_path / "good"))
    assert store.record("QCL").rows == 2
    with pytest.raises(Exception, match="not of type double"):
        store.load(meta, str(tmp_path / "bad"))
    assert store.record("QCL").sequence == 0


def test_fingerprints_tell_doubles_apart(spark):
    values = [0.0, -0.0, 0.1, -0.1, 0.1 + 2**-56, 1e-12, 123456789.123, 2.0**80, 2.0**80 + 2**40, 1e300, 1e-300, float("inf"), None]
    rows = spark.createDataFrame([("D", str(i), v) for i, v in enumerate(values)], "Domain string, Item string, Value double")
    prints = rows.withColumn("Item", F.lit("I")).withColumn("Domain", F.col("Value").cast("string"))
    found = release.manifest(prints.withColumn("Domain", F.lit("D")).withColumn("Item", rows["Value"].cast("string"))).collect()
    assert len({r.fingerprint for r in found}) == len(set(map(str, values)))


def test_states_give_what_observations_give(spark):
    rows = crops(spark, c2=3.25).withColumn("Unit", F.when(F.col("Element") == YIELD, "t/ha").otherwise(F.col("Unit")))
    made = rows.where("Element = 'Yield'").withColumns({"Element": F.lit(PRODUCTION), "Unit": F.lit("t"), "Value": F.col("Year") / 3})
    rows = rows.unionByName(made).unionByName(made.limit(50).withColumn("Unit", F.lit("kg")))
    states = partials.crop_states(rows)
    for element in (PRODUCTION, "Area harvested", YIELD):
        for groups in (["Year"], ["Item"], ["Area", "Item", "Year"], []):
            expected = measures.aggregate(rows, element, groups).where(F.col("Unit") == CROP_UNITS[element])
            assert sorted(map(tuple, partials.merged(states, element, groups).collect())) == sorted(map(tuple, expected.collect()))


def test_key_figures_from_states_read_no_observations(spark):
    store = release.ReleaseStore(spark, new_folder(spark, "store"))
    store.publish(crops(spark), metadata(spark))
    countries = spark.createDataFrame([("A", 100, "AAA", "X", "Y")], "Area string, M49 int, ISO3 string, Continent string, Region string")
    tables = PreparedTables(store)
    frames = [
        tables.key_figures(countries, ["A"], ["c1"], (1999, 2000)),
        tables.ranking(countries, YIELD, (2000, 2000), ["A"]),
        tables.figures(YIELD, ["Year"], items=["c2"]),
    ]
    for frame in frames:
        assert frame.count() > 0
        files = frame.inputFiles()
        assert files and all("_states/" in f for f in files)


def test_a_reader_of_one_crop_skips_row_groups(spark):
    """Files clustered otherwise: only the Bloom filter of a row group tells that a crop isn't there."""
    rows = crops(spark).withColumn("Item", F.concat("Item", F.lit("-"), (F.col("Year") % 50).cast("string")))
    folder = new_folder(spark, "bloom")
    options = release.WRITTEN_WITH | {"parquet.block.size": "2000", "parquet.block.size.row.check.min": "50", "parquet.page.size.row.check.min": "50"}
    rows.coalesce(1).sortWithinPartitions("Year").write.options(**options).parquet(folder)
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "false")
    for crop, most in (("c1-7", 0.9), ("c1-absent", 0.0)):
        chosen = spark.read.parquet(folder).where(F.col("Item") == crop).select("Value")
        found = chosen.collect()
        scan = chosen._jdf.queryExecution().executedPlan().collectLeaves().head()
        read = scan.metrics().apply("numOutputRows").value()
        assert len(found) == rows.where(F.col("Item") == crop).count() and read <= most * rows.count()


@pytest.mark.parametrize("text", ["tion", "TION of", "ß", "sse", "ab", "", "x" * 200, "1234", "日本語", "q'q"])
def test_indexed_search_equals_the_scan(spark, text):
    rows = [(1, "a nation OF", 5.5), (2, "straße", 1234567890.25), (3, None, None), (None, "tion of it", 1.0), (4, "日本語の", 12.34), (4, "q'q", 0.5)]
    rows += [(5, "x" * 300, 1.0), (6, "", 2.0), (6, "tio", 3.0), (7, "ni on", 1234.0)]
    table = spark.createDataFrame(rows, "id long, text string, value double")
    folder = new_folder(spark, "grams")
    grams.write_grams(table, "id", folder)
    found = grams.indexed_search(table, spark.read.parquet(folder), "id", text)
    expected = selection.literal_search(table, text)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


@pytest.mark.parametrize("name", ["release_parity", "release_update", "stored_production"])
def test_observations_are_worked_out_once(spark, monkeypatch, name):
    """A release, its metadata, the update after it and the comparison read what one pass over the tables gave."""
    seen, rows = spark.sparkContext.accumulator(0), crops(spark)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(star, "observations", lambda *_: rows.mapInArrow(counted, rows.schema))
    queries.registry()[name](spark, "").collect()
    assert seen.value == rows.count()


@pytest.mark.parametrize("letters", ["AB", "ABCÄß😀\0日", "".join(map(chr, range(32, 0xD000)))])
@pytest.mark.parametrize("rows", [1, 60])
def test_strings_of_a_row(letters, rows):
    choose = random.Random(rows)
    columns = [["".join(choose.choices(letters, k=choose.choice([0, 1, 2, 3, 300]))) for _ in range(rows)] for _ in range(3)]
    row, strings = grams._found([pa.array(c, pa.string()) for c in columns])
    expected = {(i, t[k : k + 3]) for c in columns for i, t in enumerate(c) for k in range(len(t) - 2)}
    found = list(zip(row.tolist(), strings.to_pylist(), strict=True))
    assert len(found) == len(expected) and set(found) == expected


def test_one_row_group_is_indexed_by_many_tasks(spark, many_files, monkeypatch):
    tasks, inner = spark.sparkContext.accumulator(0), grams._listed

    def counted(batches):
        held = list(batches)
        tasks.add(any(b.num_rows for b in held))
        yield from inner(iter(held))

    monkeypatch.setattr(grams, "_listed", counted)
    folder = new_folder(spark, "grams")
    table = spark.range(5000, numPartitions=1).withColumn("text", F.concat(F.lit("text "), F.col("id")))
    grams.write_grams(table, "id", folder)
    assert tasks.value > 2  # one pass to find the ranges, one to write
    found = grams.indexed_search(table, spark.read.parquet(folder), "id", "T 49")
    assert found.count() == selection.literal_search(table, "T 49").count() == 111
