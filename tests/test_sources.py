import json
import warnings
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from obsmill.schema import M49_COLUMN
from obsmill.sources import bulk, catalog, domains, export, release
from obsmill.sources.workspace import new_folder, shared_folder

HEADER = "Area,Item,Element,Year,Unit,Value,Note\n"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


# ---- Bulk CSV ------------------------------------------------------------------------


def test_bulk_load_types_and_keeps_columns(spark, tmp_path):
    put(
        tmp_path / "test_NORMALIZED.csv",
        HEADER + '"Bolivia, State",Crop,Production,2024,t,12,"say ""hi"""\nB,Crop,Production,2024,t,,\nC,Crop,Yield,2024,t,"",007\n',
    )
    put(tmp_path / "readme.csv", "other\n")
    rows = {r.Area: r for r in bulk.load_bulk(spark, str(tmp_path)).collect()}
    assert rows["Bolivia, State"].Value == 12.0 and rows["Bolivia, State"].Note == 'say "hi"'
    assert rows["B"].Value is None and rows["C"].Value is None and rows["C"].Note == "007"
    assert rows["B"].Year == 2024


@pytest.mark.parametrize("names", [[], ["a_normalized.csv", "b_Normalized.CSV"], ["plain.csv"]])
def test_exactly_one_normalized_file(spark, tmp_path, names):
    put(tmp_path / "x.txt", "x")
    for name in names:
        put(tmp_path / name, HEADER)
    with pytest.raises(ValueError, match="exactly one"):
        bulk.find_normalized(spark, str(tmp_path))


def test_bulk_schema_and_values_are_strict(spark, tmp_path):
    put(tmp_path / "a" / "normalized.csv", "Area,Item\nA,B\n")
    with pytest.raises(ValueError, match="incomplete"):
        bulk.load_bulk(spark, str(tmp_path / "a"))
    put(tmp_path / "b" / "normalized.csv", HEADER + "A,Crop,Production,2024,t,INVALID,\n")
    with pytest.raises(Exception, match="INVALID"):
        bulk.load_bulk(spark, str(tmp_path / "b")).collect()


def test_bulk_round_trip(spark, sample):
    folder = new_folder(spark, "bulk")
    bulk.write_bulk(sample, folder, "x")
    back = bulk.load_bulk(spark, folder).select(*sample.columns)
    assert release.row_differences(sample, back).isEmpty()


def test_domains_load_into_one_frame(spark, tmp_path):
    put(tmp_path / "q" / "q_normalized.csv", HEADER + "A,Crop,Production,2024,t,1,n\n")
    put(tmp_path / "p" / "p_normalized.csv", HEADER.replace("Note", "Months") + "A,Crop,Producer Price (USD/tonne),2024,USD,2,M1\n")
    rows = bulk.load_domains(spark, {"QCL": str(tmp_path / "q"), "PP": str(tmp_path / "p")}).collect()
    assert {(r.Domain, r.Note, r.Months) for r in rows} == {("QCL", "n", None), ("PP", None, "M1")}
    with pytest.raises(ValueError, match="XX"):
        bulk.load_domains(spark, {"XX": str(tmp_path)})


# ---- Domain store --------------------------------------------------------------------

META = {"code": "QCL", "name": "n", "updated": "2024", "url": "u", "source": "s"}
LINE = "Test,Test,Production,2024,t,{},\n"


@pytest.fixture
def domain_store(spark):
    return domains.DomainStore(spark, new_folder(spark, "domains"))


def csv(tmp_path, value, name="a"):
    put(tmp_path / name / "test_Normalized.csv", HEADER + LINE.format(value))
    return str(tmp_path / name)


def test_versions_of_a_domain(domain_store, tmp_path):
    first = domain_store.ensure(META, csv(tmp_path, 12))
    assert domain_store.open("QCL").first().Value == 12.0
    assert domain_store.ensure(META, csv(tmp_path, 13, "unused")) == first
    newer = {**META, "updated": "2025"}
    assert domain_store.ensure(newer, csv(tmp_path, 25, "b")) != first
    assert domain_store.open("QCL").first().Value == 25.0
    assert [(r.updated, r.rows) for r in domain_store.metadata().collect()] == [("2025", 1)]
    assert [r.Domain for r in domain_store.observations().collect()] == ["QCL"]


def test_a_failed_load_keeps_the_old_version(domain_store, tmp_path):
    for value in ("INVALID", None):
        folder = csv(tmp_path, value) if value else str(tmp_path)
        with pytest.raises(ValueError, match="cannot be loaded"):
            domain_store.ensure(META, folder)
    assert domain_store.record("QCL") is None
    first = domain_store.ensure(META, csv(tmp_path, 12, "good"))
    with pytest.warns(UserWarning, match="stays at 2024"):
        assert domain_store.ensure({**META, "updated": "2025"}, csv(tmp_path, "INVALID", "bad")) == first
    assert domain_store.record("QCL").updated == "2024"
    # What failed loads had written is gone.
    assert [p.name for p in Path(domain_store.root, "QCL").glob("*")] == [first]


def test_line_breaks_in_quoted_cells(spark, tmp_path):
    put(tmp_path / "m" / "normalized.csv", HEADER + '"first\nsecond",Crop,Production,2024,t,12,x\n')
    folder = str(tmp_path / "m")
    (row,) = bulk.load_bulk(spark, folder, multi_line=True).collect()
    assert "first\nsecond" in tuple(row)
    with pytest.raises(Exception):  # noqa: B017
        bulk.load_bulk(spark, folder).collect()


def test_an_empty_bulk_file_is_an_error(domain_store, tmp_path):
    put(tmp_path / "e" / "normalized.csv", HEADER)
    with pytest.raises(ValueError, match="empty"):
        domain_store.load(META, str(tmp_path / "e"))


def test_a_damaged_version_is_loaded_again(spark, domain_store, tmp_path, sample):
    first = domain_store.ensure(META, csv(tmp_path, 12))
    sample.drop("Value").write.mode("overwrite").parquet(f"{domain_store.root}/QCL/{first}")
    with pytest.warns(UserWarning, match="cannot be read"):
        assert domain_store.ensure(META, csv(tmp_path, 20, "b")) != first
    assert domain_store.open("QCL").first().Value == 20.0


def test_unknown_and_unloaded_domains(domain_store):
    with pytest.raises(ValueError, match="unknown"):
        domain_store.open("XX")
    with pytest.raises(ValueError, match="never"):
        domain_store.open("PP")
    with pytest.raises(ValueError, match="nothing"):
        domain_store.observations()


# ---- Catalog -------------------------------------------------------------------------

HOST = "data.example.org"


def document(*entries):
    return json.dumps({"Datasets": {"Dataset": list(entries)}}, indent=1)


def test_catalog_defaults_and_metadata(spark, tmp_path):
    path = put(
        tmp_path / "c.json",
        document({"DatasetCode": "QCL", "FileLocation": f"https://{HOST.upper()}/q.zip", "Other": 1}, {"DatasetCode": "PP", "FileLocation": "http://x/"}),
    )
    rows = catalog.read_catalog(spark, path)
    assert [tuple(r) for r in rows.where("code = 'PP'").collect()] == [("PP", "Producer prices", catalog.UNKNOWN_DATE, "http://x/")]
    assert catalog.domain_metadata(rows, "QCL", HOST)["name"] == "Production"
    for code, message in (("PP", "https"), ("TCL", "not in"), ("ZZ", "unknown")):
        with pytest.raises(ValueError, match=message):
            catalog.domain_metadata(rows, code, HOST)


@pytest.mark.parametrize("text", ["{}", '{"Datasets": {"Dataset": {"a": 1}}}', "not json"])
def test_bad_catalog_does_not_replace_a_good_one(spark, tmp_path, text):
    bad, good = put(tmp_path / "bad.json", text), put(tmp_path / "good.json", document({"DatasetCode": "QCL"}))
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, bad)
    with pytest.warns(UserWarning, match="stored copy"):
        assert catalog.current_catalog(spark, bad, good).count() == 1
    with pytest.raises(ValueError, match="no catalog"):
        catalog.current_catalog(spark, bad)


@pytest.mark.parametrize(
    "url, good",
    [
        (f"https://{HOST}/a", True), (f"HTTPS://{HOST}:443/a?b#c", True), (f"https://user@{HOST}", True), (f"http://{HOST}/a", False),
        (f"https://{HOST}.evil.org/a", False), (f"https://evil.org/{HOST}", False), (f"https://evil.org?@{HOST}", False), ("", False), (None, False),
    ],
)
def test_url_check(spark, url, good):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(catalog.accepted_url(F.col("u"), HOST).alias("x")).first().x is good


def test_stale_domains(spark):
    now = spark.createDataFrame([("QCL", "2025"), ("PP", "2025"), ("TCL", "2025")], "code string, updated string")
    held = spark.createDataFrame([("QCL", "2025"), ("PP", "2024")], "code string, updated string")
    got = {r.code: r.stale for r in catalog.stale_domains(now, held).collect()}
    assert got == {"QCL": False, "PP": True, "TCL": True}


def test_foreign_data_sets_are_not_stale(spark):
    now = spark.createDataFrame([("QCL", "2025"), ("FBS", "2030"), (None, "2030")], "code string, updated string")
    held = spark.createDataFrame([("QCL", "2025")], "code string, updated string")
    assert [tuple(r) for r in catalog.stale_domains(now, held).select("code", "stale").collect()] == [("QCL", False)]


# ---- Releases ------------------------------------------------------------------------


def observations(spark, value=1.0):
    rows = [
        ("QCL", "A", "'100", "x/1", "'0111", "Area harvested", 2000, None, "ha", value),
        ("QCL", "A", "'100", "x/1", "'0111", "Yield", 2000, None, "kg/ha", 2.0),
        ("QCL", "A", "'100", "x/1", "'0111", "Stocks", 2000, None, "t", 3.0),
        ("QCL", "B", "'200", "007", "'0112", "Area harvested", 2001, None, "ha", 4.0),
        ("QCL", "B", "'200", "Group", "'F1", "Area harvested", 2001, None, "ha", 5.0),
        ("PP", "A", "'100", "x/1", "'0111", "Producer Price (USD/tonne)", 2000, "Annual value", "USD", 6.0),
        ("PP", "A", "'100", "x/1", "'0111", "Producer Price (USD/tonne)", 2000, "M1", "USD", 7.0),
        ("TCL", "A", "'100", "007", "'0112", "Export value", 2000, None, "1000 USD", None),
        ("TCL", "A", "'100", "Group", "'F1", "Export value", 2000, None, "1000 USD", 9.0),
    ]
    return spark.createDataFrame(
        rows,
        f"Domain string, Area string, `{M49_COLUMN}` string, Item string, `Item Code (CPC)` string, "
        "Element string, Year int, Months string, Unit string, Value double",
    )


def metadata(spark, updated="2024"):
    return spark.createDataFrame([(c, updated) for c in ("QCL", "PP", "TCL")], "code string, updated string")


@pytest.fixture
def store(spark):
    return release.ReleaseStore(spark, new_folder(spark, "store"))


def test_release_keeps_primary_crops_and_annual_prices(spark, store):
    rows = observations(spark)
    store.publish(rows, metadata(spark))
    got = store.open().select(*rows.columns)
    assert sorted((r.Domain, r.Item, r.Element) for r in got.collect()) == [
        ("PP", "x/1", "Producer Price (USD/tonne)"), ("QCL", "007", "Area harvested"),
        ("QCL", "x/1", "Area harvested"), ("QCL", "x/1", "Yield"), ("TCL", "007", "Export value"),
    ]
    assert release.row_differences(got, release.release_rows(rows)).isEmpty()
    assert {r.Item for r in store.table("items").collect()} == {"x/1", "007"}
    assert {r.Area for r in store.table("areas").collect()} == {"A", "B"}
    assert store.table("availability").where("Item = 'x/1'").first().Years == [2000]
    assert store.open(domain="TCL").count() == 1
    with pytest.raises(ValueError, match="unknown"):
        store.open(domain="XX")


def test_domain_filter_prunes_partitions(spark, store):
    store.publish(observations(spark), metadata(spark))
    rows = store.open(domain="QCL").where("Item = '007'").select("Value")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Domain" in plan and "EqualTo(Item,007)" in plan


def test_new_versions_replace_old_ones(spark, store):
    assert store.current() is None
    first = store.publish(observations(spark), metadata(spark))
    second = store.publish(observations(spark, 25.0), metadata(spark, "2025"))
    assert store.current() == second != first
    assert store.open().where("Element = 'Area harvested' and Area = 'A'").first().Value == 25.0


def test_failed_update_keeps_the_old_release(spark, store):
    with pytest.raises(ValueError, match="no release"):
        store.ensure(lambda: (observations(spark).drop("Value"), metadata(spark)))
    first = store.publish(observations(spark), metadata(spark))
    newer = metadata(spark, "2025")

    def broken():
        bad = observations(spark).withColumn("Value", F.lit("INVALID").cast("double"))
        return bad, newer

    with pytest.warns(UserWarning, match="stays in use"):
        assert store.ensure(broken, newer) == first
    assert store.current() == first


def test_an_empty_release_is_not_published(spark, store):
    with pytest.raises(ValueError, match="without rows"):
        store.publish(observations(spark).where("Item = 'Group'"), metadata(spark))
    assert store.current() is None


def test_current_release_is_reused_and_a_damaged_one_rebuilt(spark, store):
    build = lambda: (observations(spark), metadata(spark))
    first = store.ensure(build)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert store.ensure(build) == first
        assert store.ensure(build, metadata(spark)) == first
    observations(spark).drop("Value").write.mode("overwrite").partitionBy("Domain").parquet(store.path(first, "observations"))
    with pytest.warns(UserWarning, match="damaged"):
        assert store.ensure(build) != first


def folders(store):
    return sorted(p.name for p in Path(store.root, "releases").glob("*"))


def test_a_write_that_loses_rows_is_not_published(spark, store, monkeypatch):
    first = store.publish(observations(spark), metadata(spark))
    write = release.write_rows
    monkeypatch.setattr(release, "write_rows", lambda rows, path: write(rows.where("Area <> 'A'"), path))
    with pytest.raises(ValueError, match="rows of its source"):
        store.publish(observations(spark), metadata(spark))
    assert store.current() == first and folders(store) == [first]


def test_a_lost_file_is_noticed(spark, store):
    build = lambda: (observations(spark), metadata(spark))
    first = store.ensure(build)
    next(Path(store.path(first, "observations")).rglob("part-*.parquet")).unlink()
    with pytest.raises(ValueError, match="lacks 1 of its files"):
        store.open()
    with pytest.warns(UserWarning, match="damaged"):
        assert store.ensure(build) != first


def test_a_catalog_with_foreign_data_sets_rebuilds_nothing(spark, store):
    build = lambda: (observations(spark), metadata(spark))
    first = store.ensure(build)
    foreign = spark.createDataFrame([("FBS", "2030"), ("RL", "2030")], "code string, updated string")
    assert store.ensure(build, metadata(spark).select("code", "updated").unionByName(foreign)) == first


def test_stale_release_is_rebuilt(spark, store):
    first = store.ensure(lambda: (observations(spark), metadata(spark)))
    assert store.ensure(lambda: (observations(spark), metadata(spark, "2025")), metadata(spark, "2025")) != first


def test_unknown_layout_version(spark, store):
    row = [(0, "release-x", 2, 0.0)]
    spark.createDataFrame(row, release.LOG_SCHEMA).write.json(f"{store.root}/published")
    with pytest.raises(ValueError, match="layout 2"):
        store.current()


def test_manifest_notices_every_change(spark, store):
    rows = release.release_rows(observations(spark))
    held = release.manifest(rows)
    problems = lambda df: {(r.Domain, r.Item, r.problem) for r in release.manifest_mismatches(held, release.manifest(df)).collect()}
    assert problems(rows) == set()
    assert problems(rows.where("Domain <> 'PP'")) == {("PP", "x/1", "missing")}
    assert problems(rows.unionByName(rows.where("Item = '007' and Domain = 'QCL'"))) == {("QCL", "007", "rows")}
    changed = rows.withColumn("Value", F.when(F.col("Value") == 6, 6.5).otherwise(F.col("Value")))
    assert problems(changed) == {("PP", "x/1", "content")}
    filled = rows.withColumn("Value", F.coalesce("Value", F.lit(0.0)))
    assert problems(filled) == {("TCL", "007", "content")}
    assert problems(observations(spark)) == {
        ("QCL", "x/1", "rows"), ("QCL", "Group", "extra"), ("PP", "x/1", "rows"), ("TCL", "Group", "extra"),
    }


def test_null_and_value_do_not_swap_unnoticed(spark):
    schema = "Domain string, Item string, p string, q string"
    a = spark.createDataFrame([("D", "I", None, "x")], schema)
    b = spark.createDataFrame([("D", "I", "x", None)], schema)
    assert not release.manifest_mismatches(release.manifest(a), release.manifest(b)).isEmpty()


def test_parity_counts_copies(spark):
    a = spark.createDataFrame([("D", 1), ("D", 1), ("D", 2)], "Domain string, v int")
    b = spark.createDataFrame([("D", 1), ("D", 3)], "Domain string, v int")
    assert [tuple(r) for r in release.parity(a, b).collect()] == [("D", 3, 2, 2, 1)]
    assert {(r.v, r.surplus) for r in release.row_differences(a, b).collect()} == {(1, 1), (2, 1), (3, -1)}


def test_failing_domains_are_empty_and_reported(spark, tmp_path, sample):
    openers = {
        "PP": lambda: spark.read.parquet(str(tmp_path / "absent")),
        "TCL": lambda: sample,
        "QCL": lambda: sample.drop("Unit"),
    }
    frames, problems = release.opened(spark, openers, like=sample)
    assert frames["PP"].isEmpty() and frames["PP"].columns == sample.columns and frames["TCL"].count() == 6
    messages = {r.domain: r.message for r in problems.collect()}
    assert set(messages) == {"PP", "QCL"} and "Unit" in messages["QCL"]
    assert release.opened(spark, {"TCL": lambda: sample}, like=sample)[1].isEmpty()


# ---- Exports -------------------------------------------------------------------------


def test_csv_export_is_safe_marked_and_keeps_missing_empty(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", None, ""), (None, -1.0, 'q"u')], "text string, value double, other string")
    export.write_csv(df.coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    text = part.read_bytes()
    assert text.startswith(b"\xef\xbb\xbftext,value,other")
    assert text.decode("utf-8-sig").splitlines()[1:] == ["'=1+1,,", ',-1.0,"q""u"']


def test_export_parts(spark):
    df = spark.createDataFrame([("QCL",)] * 7 + [("PP",)] * 6, "Domain string")
    got = [(r.sheet, r.n_rows) for r in export.export_parts(df, limit=3).orderBy("sheet").collect()]
    assert got == [("PP_1", 3), ("PP_2", 3), ("QCL_1", 3), ("QCL_2", 3), ("QCL_3", 1), ("TCL_1", 0)]


def test_sheets_split_and_reunite(spark, tmp_path, sample):
    rows = sample.withColumn("Domain", F.lit("QCL"))
    export.write_sheets(rows, str(tmp_path / "s"), limit=2)
    files = list((tmp_path / "s" / "Domain=QCL").glob("part-*.csv"))
    assert len(files) >= 3 and all(len(f.read_text().splitlines()) <= 3 for f in files)
    for code in ("PP", "TCL"):
        (empty,) = (tmp_path / "s" / f"Domain={code}").glob("part-*.csv")
        assert empty.read_text().strip() == ",".join(sample.columns)
    back = spark.read.schema(sample.schema).csv(str(tmp_path / "s" / "Domain=QCL"), header=True, enforceSchema=True)
    assert release.row_differences(sample, back).isEmpty()


@pytest.mark.parametrize("limit", [1, 3, 7, 100])
def test_named_sheets_come_back(spark, tmp_path, limit):
    """Every sheet is one file of its name, filled in canonical order, and no row is lost."""
    schema = "Domain string, Area string, Item string, Element string, Year int, Unit string, Value double, Note string"
    rows = [
        (d, a, "Crop", "Yield", y, "t", v, n)
        for d, k in (("QCL", 5), ("PP", 2))
        for a in ("B", "A", None, "A")
        for y, v, n in [(2000 + i % 3, i / 4, ["x", " y ", "two\nlines", 'a "b", c', "=1+1"][i % 5]) for i in range(k)]
    ]
    df = spark.createDataFrame(rows, schema).repartition(5)
    export.write_named_sheets(df, str(tmp_path / "s"), limit=limit)
    got = export.read_named_sheets(spark, str(tmp_path / "s"), df.schema).collect()

    def last(value):
        return value is None, value if value is not None else 0

    expected = []
    for domain in ("QCL", "PP"):
        own = [(*r[:-1], "'=1+1" if r[-1] == "=1+1" else r[-1]) for r in rows if r[0] == domain]
        own.sort(key=lambda r: [last(v) for v in (*r[1:5], *r[5:])])
        expected += [(*r, f"{domain}_{i // limit + 1}") for i, r in enumerate(own)]
    assert sorted(map(repr, (tuple(r)[:-1] for r in got))) == sorted(map(repr, expected))
    assert len({(r.sheet, r.file) for r in got}) == len({r.sheet for r in got})
    (empty,) = (tmp_path / "s" / "sheet=TCL_1").glob("part-*.csv")
    assert empty.read_text().strip() == ",".join(df.columns[1:])
    report = {r.sheet: (r.n_files, r.n_rows) for r in export.sheet_report(export.read_named_sheets(spark, str(tmp_path / "s"), df.schema)).collect()}
    assert all(files == 1 and count <= limit for files, count in report.values()) and sum(n for _, n in report.values()) == len(rows)


def test_named_sheets_of_an_empty_table_and_of_a_clashing_name(spark, tmp_path, sample):
    none = sample.withColumn("Domain", F.lit("QCL")).limit(0)
    export.write_named_sheets(none, str(tmp_path / "s"), limit=2)
    assert sorted(p.name for p in (tmp_path / "s").glob("sheet=*")) == ["sheet=PP_1", "sheet=QCL_1", "sheet=TCL_1"]
    assert export.read_named_sheets(spark, str(tmp_path / "s"), none.schema).isEmpty()
    with pytest.raises(ValueError, match="sheet"):
        export.named_sheets(none.withColumn("sheet", F.lit(1)))


def test_provenance_and_summary(spark):
    meta = spark.createDataFrame([("QCL", "n", "2024", "s", 5, "f")], "code string, name string, updated string, source string, rows bigint, file string")
    row = export.provenance(meta, (2000, 2024), ["A", "B"], ["Crop"]).first()
    assert (row.period, row.areas, row["items"], row.file) == ("2000–2024", "A, B", "Crop", "f")
    assert export.domain_summary(meta).columns == ["code", "name", "updated", "source", "rows"]


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
