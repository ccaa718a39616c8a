"""The registered queries: each operator over the star tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsmill.functions import text
from obsmill.functions.values import exact_sum
from obsmill.operators import bitmaps, change, geography, measures, partials, ranking, selection, trade
from obsmill.operators.selection import Selection
from obsmill.plans import reports
from obsmill.schema import (
    AREA_HARVESTED,
    CROP_ELEMENTS,
    EXPORT_VALUE,
    IMPORT_VALUE,
    PRODUCTION,
    WORLD,
    YIELD,
    bad_cells,
    typed,
)
from obsmill.session import sound_unions, union_all
from obsmill.sources import bulk, catalog, domains, export, grams, release, star
from obsmill.sources.workspace import new_folder, stored
from obsmill.tables import PreparedTables

Query = Callable[[SparkSession, str], DataFrame]

# The selections a user would make; the same literals stand in the oracle SQL.
AREAS = ["NATION_3", "NATION_8", "NATION_15", "NATION_20", "NATION_21"]
ITEMS = ["ECONOMY", "LARGE", "PROMO", "SMALL"]
PERIOD = (1996, 1999)
KPI_AREA, KPI_ITEM = "NATION_20", "ECONOMY"
YEAR = 1999
FOREIGN = [("FBS", "Food balances", "2030-01-01", "https://data.example.org/FBS.zip"), ("RL", "Land use", None, None)]
HOST = "blog.tionsh.example.net"
SEARCH = "tion of"
QUESTIONS = (
    "¿Cuál fue el mayor productor? ",
    "¿Cuánto creció el rendimiento? ",
    "Ranking por favor. ",
    "¿Ha aumentado? ",
    "",
)

_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sound_unions(spark)
        return function(spark, sf_dir)

    _REGISTRY[function.__name__] = run
    return run


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _crops(spark: SparkSession, sf: str, *elements: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Crop observations of countries and other areas, without the World rows."""
    return star.crops(spark, sf, elements or CROP_ELEMENTS, years).where(F.col("Area") != WORLD)


def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    return geography.geography_lookup(star.geography_source(spark, sf))


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    return selection.area_table(star.crops(spark, sf, [PRODUCTION]))


def _countries(spark: SparkSession, sf: str) -> DataFrame:
    """Countries among all areas of the dimension, for joins with the facts."""
    areas = star.area_codes(spark, sf)
    return geography.country_areas(geography.enrich_geography(areas, _lookup(spark, sf)))


def _countries_on_record(spark: SparkSession, sf: str) -> DataFrame:
    """Countries among the areas that have crop observations."""
    enriched = geography.enrich_geography(_areas(spark, sf), _lookup(spark, sf))
    return geography.country_areas(enriched)


def _chosen(*elements: str) -> Selection:
    return Selection(AREAS, ITEMS, list(elements) or None, PERIOD)


# ---- Ingest, catalog, release ----------------------------------------------------


@query
def ingest_csv(spark, sf):
    folder = new_folder(spark, "bulk")
    bulk.write_bulk(star.observations(spark, sf), folder, "observations")
    return bulk.load_bulk(spark, folder)


@query
def domain_store(spark, sf):
    """Each domain written as bulk CSV, loaded, typed, versioned and read back."""
    store = domains.DomainStore(spark, new_folder(spark, "domains"))
    loaders = {"QCL": star.crops, "PP": star.prices, "TCL": star.trade}
    for code, rows in loaders.items():
        folder = new_folder(spark, code)
        bulk.write_bulk(rows(spark, sf).drop("Domain"), folder, code)
        store.ensure({"code": code, "name": f"Domain {code}", "updated": "2001-12-31"}, folder)
    return store.observations()


@query
def typed_observations(spark, sf):
    rows = star.observations(spark, sf)
    return typed(rows.select([F.col(f"`{c}`").cast("string") for c in rows.columns]))


@query
def bad_value_report(spark, sf):
    raw = star.table(spark, sf, "documents").select(
        "doc_id",
        F.col("lang").alias("Area"),
        F.col("source").alias("Item"),
        F.lit("Text").alias("Element"),
        F.col("n_chars").cast("string").alias("Year"),
        F.lit("").alias("Unit"),
        F.col("text").alias("Value"),
    )
    return bad_cells(raw).select("doc_id", "bad_column", "bad_cell")


def _metadata(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Metadata of the derived domains: as many rows as there are domains."""
    rows = star.observations(spark, sf) if rows is None else rows
    return rows.groupBy("Domain").agg(F.count("*").alias("rows"), F.max("Year").alias("y")).select(
        F.col("Domain").alias("code"),
        F.concat(F.lit("Domain "), "Domain").alias("name"),
        F.concat(F.col("y").cast("string"), F.lit("-12-31")).alias("updated"),
        F.lit("star tables").alias("source"),
        F.concat(F.lit("https://data.example.org/"), "Domain", F.lit(".zip")).alias("url"),
        "rows",
    )


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    entry = F.struct(
        F.col("code").alias("DatasetCode"),
        F.when(F.col("code") != "PP", F.col("name")).alias("DatasetName"),
        F.col("updated").alias("DateUpdate"),
        F.col("url").alias("FileLocation"),
    )
    # A catalog lists other data sets too.
    others = spark.createDataFrame(FOREIGN, "code string, name string, updated string, url string")
    known = _metadata(spark, sf).select(*others.columns)
    document = union_all(known, others).agg(F.collect_list(entry).alias("Dataset"))
    path = new_folder(spark, "catalog")
    document.select(F.struct("Dataset").alias("Datasets")).coalesce(1).write.json(path)
    return catalog.read_catalog(spark, path)


@query
def catalog_rows(spark, sf):
    return _catalog(spark, sf)


@query
def stale_domains(spark, sf):
    rows = star.observations(spark, sf)
    earlier = rows.where((F.col("Domain") == "PP") | (F.col("Year") <= 2000))
    return catalog.stale_domains(_catalog(spark, sf), _metadata(spark, sf, earlier))


@query
def url_host_filter(spark, sf):
    url = F.col("url")
    return star.table(spark, sf, "pages").select(
        "page_id",
        "url",
        catalog.url_scheme(url).alias("scheme"),
        catalog.url_host(url).alias("host"),
        catalog.accepted_url(url, HOST).alias("accepted"),
    )


@query
def release_rows(spark, sf):
    return release.release_rows(star.observations(spark, sf))


@query
def primary_items(spark, sf):
    return selection.primary_items(star.crops(spark, sf))


@query
def area_table(spark, sf):
    return _areas(spark, sf)


@query
def availability(spark, sf):
    return selection.availability(star.crops(spark, sf)).withColumn(
        "Years", F.array_join("Years", ",")
    )


@query
def partition_manifest(spark, sf):
    rows = release.release_rows(star.observations(spark, sf))
    return release.manifest(rows).select("Domain", "Item", "n_rows")


@query
def partition_fingerprint(spark, sf):
    return release.manifest(release.release_rows(star.observations(spark, sf)))


@query
def manifest_mismatches(spark, sf):
    """One item lost, one doubled, one changed in a single value, one that does not belong."""
    rows = star.observations(spark, sf)
    kept = release.release_rows(rows)
    domain, item = F.col("Domain"), F.col("Item")
    edited = (domain == "TCL") & (item == "SMALL") & (F.col("Area") == "NATION_3") & (F.col("Element") == EXPORT_VALUE)
    changed = kept.where(~((domain == "PP") & (item == "ECONOMY"))).withColumn(
        "Value", F.when(edited, F.col("Value") + 1).otherwise(F.col("Value"))
    )
    doubled = kept.where((domain == "QCL") & (item == "LARGE"))
    foreign = rows.where((domain == "TCL") & (item == "PROMO"))
    actual = release.manifest(union_all(changed, doubled, foreign))
    return release.manifest_mismatches(release.manifest(kept), actual)


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    """All observations, worked out from the star tables once for a release, its metadata and comparisons, which all read them."""
    return stored(star.observations(spark, sf), "observations", compression="zstd")


@query
def release_parity(spark, sf):
    rows = _observations(spark, sf)
    store = release.ReleaseStore(spark, new_folder(spark, "store"))
    store.publish(rows, _metadata(spark, sf, rows))
    prepared = store.open().select(*rows.columns)
    return release.parity(prepared, release.release_rows(rows))


def _prepared(spark: SparkSession, sf: str) -> PreparedTables:
    """The star tables as a published release."""
    rows = _observations(spark, sf)
    store = release.ReleaseStore(spark, new_folder(spark, "store"))
    store.publish(rows, _metadata(spark, sf, rows))
    return PreparedTables(store)


def _edited(rows: DataFrame) -> DataFrame:
    """The exports of one crop are one higher in one area, another crop has no prices."""
    changed = (F.col("Domain") == "TCL") & (F.col("Item") == "SMALL") & (F.col("Area") == "NATION_3") & (F.col("Element") == EXPORT_VALUE)
    kept = rows.where(~((F.col("Domain") == "PP") & (F.col("Item") == "ECONOMY")))
    return kept.withColumn("Value", F.when(changed, F.col("Value") + 1).otherwise(F.col("Value")))


def _updated(spark: SparkSession, sf: str) -> tuple[release.ReleaseStore, str, str, DataFrame]:
    """A release of the star tables and the one that follows it after an edit."""
    rows = _observations(spark, sf)
    store, metadata = release.ReleaseStore(spark, new_folder(spark, "store")), _metadata(spark, sf, rows)
    first = store.publish(rows, metadata)
    return store, first, store.update(_edited(rows), metadata), rows


@query
def release_update(spark, sf):
    """A release that rewrites only the files of changed crops has the rows of one that was written as a whole."""
    store, _, second, rows = _updated(spark, sf)
    return release.parity(store.open(second).select(*rows.columns), release.release_rows(_edited(rows)))


@query
def differing_items(spark, sf):
    """Where two releases differ, by their trees of fingerprints."""
    store, first, second, _ = _updated(spark, sf)
    return store.differing_items(first, second)


@query
def stored_kpi_summary(spark, sf):
    """Key figures from the states a release stores."""
    return _prepared(spark, sf).key_figures(_countries(spark, sf), [KPI_AREA], [KPI_ITEM], PERIOD)


@query
def stored_yields(spark, sf):
    """Weighted yields of all primary crops from stored states."""
    states = _prepared(spark, sf).states().where(F.col("Area") != WORLD)
    return partials.merged(states, YIELD, ["Area", "Year"])


@query
def stored_production(spark, sf):
    """Production of primary crops, World rows among them, from stored states."""
    return _prepared(spark, sf).figures(PRODUCTION, ["Item", "Year"])


@query
def release_differences(spark, sf):
    rows = star.observations(spark, sf)
    return release.row_differences(rows, release.release_rows(rows))


# ---- Selection ---------------------------------------------------------------------


@query
def select_observations(spark, sf):
    crops = star.crops(spark, sf, [PRODUCTION, YIELD], PERIOD)
    rows = selection.select_observations(crops, "QCL", _chosen(PRODUCTION, YIELD))
    return rows.orderBy(*selection.canonical_order())


@query
def select_empty_items(spark, sf):
    return selection.select_observations(star.observations(spark, sf), "QCL", Selection(AREAS, []))


@query
def annual_prices(spark, sf):
    return selection.select_observations(star.prices(spark, sf, PERIOD), "PP", _chosen())


@query
def available_items(spark, sf):
    return selection.available_items(selection.availability(star.crops(spark, sf)), AREAS)


@query
def items_with_rows(spark, sf):
    return selection.items_with_rows(release.release_rows(star.observations(spark, sf)).where("Domain = 'TCL'"))


@query
def available_years(spark, sf):
    return selection.available_years(
        selection.availability(star.crops(spark, sf)), AREAS[:2], ITEMS
    )


@query
def years_on_record(spark, sf):
    chosen = Selection(AREAS, ITEMS, [IMPORT_VALUE], None)
    return selection.years_on_record(star.trade(spark, sf, [IMPORT_VALUE]), chosen)


@query
def domain_dimensions(spark, sf):
    return selection.dimensions(star.observations(spark, sf), ["Domain"])


@query
def bitmap_items(spark, sf):
    """The crops offered in some areas, from the item bitmaps a release stores."""
    return _prepared(spark, sf).available_items("QCL", AREAS)


@query
def bitmap_years(spark, sf):
    """The years offered for some areas and crops, from stored year bitmaps."""
    return _prepared(spark, sf).available_years("QCL", AREAS[:2], ITEMS)


@query
def bitmap_trade_years(spark, sf):
    """The same for one element of another domain."""
    return _prepared(spark, sf).available_years("TCL", AREAS, ITEMS, [IMPORT_VALUE])


@query
def bitmap_items_in_period(spark, sf):
    """Traded crops of one area in a period, the period as a mask."""
    words = bitmaps.year_bits(star.trade(spark, sf), ["Area", "Item", "Element"])
    return bitmaps.items_offered(words, Selection(AREAS[:1], None, [EXPORT_VALUE], PERIOD))


@query
def bitmap_members(spark, sf):
    """Members of each dimension with their years and how many, from bitmaps of all observations."""
    words = bitmaps.year_bits(star.observations(spark, sf), ["Domain", "Area", "Item", "Element"])
    return bitmaps.member_years(words, ["Domain"])


@query
def scope_areas(spark, sf):
    return geography.scope_areas(_countries_on_record(spark, sf), "EUROPE", "EUROPE-1")


@query
def default_period(spark, sf):
    rows = _crops(spark, sf, AREA_HARVESTED)
    return selection.default_period(rows, ["Area"])


@query
def default_item(spark, sf):
    index = selection.availability(star.crops(spark, sf)).where("harvested")
    return selection.default_item(index, "MEDIUM", ["Area"])


@query
def literal_search(spark, sf):
    return selection.literal_search(star.table(spark, sf, "documents"), SEARCH)


@query
def indexed_search(spark, sf):
    """The same rows by an index of three-letter strings."""
    documents, folder = star.table(spark, sf, "documents"), new_folder(spark, "grams")
    grams.write_grams(documents, "doc_id", folder)
    return grams.indexed_search(documents, spark.read.parquet(folder), "doc_id", SEARCH)


@query
def literal_search_observations(spark, sf):
    return selection.literal_search(star.observations(spark, sf), "33.3")


@query
def literal_search_digits(spark, sf):
    """All digits are searched: sevenths of quantities, down to the last one."""
    lines = star.table(spark, sf, "lineitem")
    parts = lines.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 7).alias("part"))
    return selection.literal_search(parts, "285714285714286")


@query
def total_of_small_values(spark, sf):
    """Sums of values beyond the twelfth digit and of very unequal size, to thirteen digits."""
    lines = star.table(spark, sf, "lineitem")
    tiny, third = F.col("l_quantity") * 1e-13, F.col("l_quantity") / 3
    totals = lines.groupBy("l_returnflag").agg(
        exact_sum(tiny).alias("tiny"), exact_sum(third).alias("third"), exact_sum(third * 1e16).alias("huge")
    )
    digits = {c: F.format_string("%.12e", c) for c in ("tiny", "third", "huge")}
    return totals.withColumns(digits)


# ---- Measures ------------------------------------------------------------------------


@query
def paired_yield_area(spark, sf):
    return measures.paired_yield_area(_crops(spark, sf))


@query
def duplicate_observations(spark, sf):
    rows = _crops(spark, sf)
    # A second source that reports the same yields in kg/ha.
    second = measures.normalize_yields(rows.where(F.col("Element") == YIELD))
    return measures.duplicate_observations(union_all(rows, second))


@query
def kpi_totals(spark, sf):
    return reports.kpi_totals(_crops(spark, sf))


@query
def production_by_area_year(spark, sf):
    return measures.aggregate(_crops(spark, sf, PRODUCTION), PRODUCTION, ["Area", "Year"])


@query
def area_by_item_year(spark, sf):
    return measures.aggregate(_crops(spark, sf, AREA_HARVESTED), AREA_HARVESTED, ["Item", "Year"])


@query
def total_by_year(spark, sf):
    return measures.aggregate(_crops(spark, sf, PRODUCTION), PRODUCTION, ["Year"])


@query
def normalized_yields(spark, sf):
    return measures.normalize_yields(_crops(spark, sf))


@query
def weighted_yield_by_year(spark, sf):
    return measures.aggregate(_crops(spark, sf), YIELD, ["Year"])


@query
def weighted_yield_by_area(spark, sf):
    return measures.aggregate(_crops(spark, sf), YIELD, ["Area"])


@query
def weighted_yield_by_area_year(spark, sf):
    return measures.aggregate(_crops(spark, sf), YIELD, ["Area", "Year"])


@query
def weighted_yield_by_item_year(spark, sf):
    return measures.aggregate(_crops(spark, sf), YIELD, ["Item", "Year"])


@query
def yield_coverage(spark, sf):
    return measures.yield_coverage(_crops(spark, sf), ["Year"])


@query
def series_guard(spark, sf):
    return reports.series_guard(star.observations(spark, sf), ["Domain", "Element"])


@query
def selection_count(spark, sf):
    rows = selection.apply_selection(star.observations(spark, sf), _chosen())
    return rows.groupBy("Domain").agg(F.count("*").alias("n_rows"))


@query
def observation_coverage(spark, sf):
    return measures.observation_coverage(
        star.observations(spark, sf), ["Domain", "Element", "Item"]
    )


# ---- Change over time ------------------------------------------------------------------


@query
def yoy_change(spark, sf):
    yearly = measures.aggregate(_crops(spark, sf), YIELD, ["Area", "Year"])
    return change.yoy_change(yearly, ["Area", "Unit"])


@query
def yoy_change_production(spark, sf):
    yearly = measures.aggregate(_crops(spark, sf, PRODUCTION), PRODUCTION, ["Area", "Item", "Year"])
    return change.yoy_change(yearly, ["Area", "Item", "Unit"])


@query
def period_change(spark, sf):
    yearly = measures.aggregate(_crops(spark, sf), YIELD, ["Area", "Year"])
    return change.period_change(yearly, ["Area"])


@query
def series_cagr(spark, sf):
    yearly = measures.aggregate(_crops(spark, sf, PRODUCTION), PRODUCTION, ["Item", "Year"])
    return change.series_growth(yearly, ["Item"]).withColumn("cagr_pct", F.round("cagr_pct", 6))


# ---- Geography -----------------------------------------------------------------------


@query
def geo_lookup(spark, sf):
    return _lookup(spark, sf)


@query
def enriched_geography(spark, sf):
    return geography.enrich_geography(_areas(spark, sf), _lookup(spark, sf))


@query
def country_areas(spark, sf):
    return _countries_on_record(spark, sf)


@query
def map_values(spark, sf):
    values = measures.aggregate(_crops(spark, sf), YIELD, ["Area", "Year"])
    return reports.map_values(values, _countries(spark, sf))


# ---- Rankings and shares -------------------------------------------------------------


@query
def world_ranking(spark, sf):
    return reports.world_ranking(
        star.crops(spark, sf, years=(YEAR, YEAR)), _countries(spark, sf), YIELD, (YEAR, YEAR), AREAS
    )


@query
def rank_all_years(spark, sf):
    years = (1900, 2100)
    return reports.world_ranking(
        star.crops(spark, sf, [AREA_HARVESTED]), _countries(spark, sf), AREA_HARVESTED, years, AREAS
    )


@query
def scope_ranking(spark, sf):
    chosen = selection.apply_selection(_crops(spark, sf, PRODUCTION, years=(YEAR, YEAR)), _chosen(PRODUCTION))
    latest = measures.aggregate(chosen, PRODUCTION, ["Area", "Year"])
    # One row per chosen area: as many as there are literals.
    return ranking.with_rank(latest, ["Year", "Unit"], small=True)


@query
def shares_and_ranks(spark, sf):
    rows = _crops(spark, sf, AREA_HARVESTED).select("Area", "Item", "Year", "Unit", "Value")
    return ranking.shares_and_ranks(rows, ["Item", "Year", "Unit"])


@query
def top_n_ranking(spark, sf):
    values = measures.aggregate(_crops(spark, sf, AREA_HARVESTED), AREA_HARVESTED, ["Area", "Year"])
    return ranking.top_rows(values, ["Year", "Unit"], 5)


@query
def production_share(spark, sf):
    return reports.production_share(star.crops(spark, sf, [PRODUCTION]), _countries(spark, sf))


@query
def top_n_share(spark, sf):
    shares = reports.production_share(star.crops(spark, sf, [PRODUCTION]), _countries(spark, sf))
    return reports.top_shares(shares, 5)


@query
def top_area(spark, sf):
    values = measures.aggregate(_crops(spark, sf, AREA_HARVESTED), AREA_HARVESTED, ["Area", "Year"])
    return ranking.top_area(values, ["Year", "Unit"])


@query
def kpi_price(spark, sf):
    return reports.kpi_price(
        selection.select_observations(star.prices(spark, sf), "PP", Selection(AREAS, ITEMS)),
        ["Area", "Item", "Year"],
    )


@query
def kpi_price_by_area(spark, sf):
    """Several items per area: a price only where a single one is reported."""
    prices = selection.select_observations(
        star.prices(spark, sf), "PP", Selection(AREAS, ["ECONOMY"])
    )
    return reports.kpi_price(prices, ["Area"])


# ---- Trade and prices ------------------------------------------------------------------


@query
def trade_balance(spark, sf):
    return trade.trade_balance(star.trade(spark, sf))


@query
def trade_by_item(spark, sf):
    return trade.trade_by_item(star.trade(spark, sf))


@query
def trade_series(spark, sf):
    return reports.trade_series(star.trade(spark, sf))


@query
def trade_series_rollup(spark, sf):
    return reports.trade_series(star.trade(spark, sf), level="item")


@query
def price_series(spark, sf):
    return reports.price_series(
        selection.select_observations(star.prices(spark, sf), "PP", Selection())
    )


# ---- Reports ---------------------------------------------------------------------------


@query
def history_series(spark, sf):
    rows = selection.apply_selection(_crops(spark, sf, YIELD, years=PERIOD), _chosen(YIELD))
    return reports.history_series(rows, YIELD)


@query
def history_series_all(spark, sf):
    return reports.history_series(_crops(spark, sf, YIELD), YIELD)


@query
def history_series_rollup(spark, sf):
    return reports.history_series(_crops(spark, sf), YIELD, level="item")


@query
def kpi_summary(spark, sf):
    return reports.kpi_summary(
        star.crops(spark, sf, years=(PERIOD[1] - 1, PERIOD[1])),
        star.prices(spark, sf, (PERIOD[1], PERIOD[1])),
        _countries(spark, sf),
        [KPI_AREA],
        [KPI_ITEM],
        PERIOD,
    )


@query
def kpi_summary_scope(spark, sf):
    return reports.kpi_summary(
        star.crops(spark, sf, years=(YEAR, YEAR)),
        star.prices(spark, sf, (YEAR, YEAR)),
        _countries(spark, sf),
        AREAS,
        ITEMS,
        (YEAR, YEAR),
    )


@query
def country_comparison(spark, sf):
    return reports.country_comparison(_crops(spark, sf))


@query
def crop_comparison(spark, sf):
    return reports.crop_comparison(_crops(spark, sf, YIELD), YIELD)


@query
def missing_items(spark, sf):
    requested = selection.primary_items(star.crops(spark, sf))
    facts = _crops(spark, sf, YIELD).where("Area = 'NATION_3' and Year = 1998")
    return reports.missing_items(requested, facts)


@query
def missing_items_by_domain(spark, sf):
    requested = selection.primary_items(star.crops(spark, sf))
    facts = (
        union_all(star.trade(spark, sf, [IMPORT_VALUE]), selection.annual_only(star.prices(spark, sf)))
        .where("Area = 'NATION_5'")
    )
    return reports.missing_items_by_domain(requested, facts, ["TCL", "PP"])


def _user_questions(spark: SparkSession, sf: str) -> DataFrame:
    ask = F.element_at(
        F.array(*[F.lit(q) for q in QUESTIONS]), (F.col("conv_id") % 5 + 1).cast("int")
    )
    return (
        star.table(spark, sf, "conversations")
        .where(F.col("role") == "user")
        .select("conv_id", "turn", F.concat(ask, F.col("text")).alias("question"))
    )


@query
def question_intents(spark, sf):
    return reports.answered_questions(
        _user_questions(spark, sf), "question", _crops(spark, sf), AREA_HARVESTED, YEAR
    ).drop("question")


@query
def domain_union(spark, sf):
    frames = {
        "QCL": star.crops(spark, sf).drop("Months", "Domain"),
        "PP": star.prices(spark, sf).drop("Domain"),
        "TCL": star.trade(spark, sf).drop("Months", "Domain"),
    }
    return bulk.domain_union(frames)


# ---- Exports ---------------------------------------------------------------------------


@query
def formula_safe(spark, sf):
    start = F.substring(F.lit("=+-@x"), (F.lit(1) + F.col("doc_id") % 5).cast("int"), F.lit(1))
    cell = F.concat(start, F.col("text"))
    return star.table(spark, sf, "documents").select("doc_id", text.formula_safe(cell).alias("text"))


@query
def formula_safe_cells(spark, sf):
    return export.safe_cells(star.table(spark, sf, "conversations"))


@query
def csv_export(spark, sf):
    path = new_folder(spark, "export")
    rows = star.table(spark, sf, "conversations")
    export.write_csv(rows, path, byte_order_mark=False)
    schema = "conv_id bigint, turn bigint, role string, text string"
    return spark.read.schema(schema).options(**bulk.CSV_OPTIONS, multiLine=True).csv(path)


@query
def export_parts(spark, sf):
    return export.export_parts(star.observations(spark, sf), limit=1000)


@query
def export_sheets(spark, sf):
    """All observations written as sheets of at most 1000 rows and read back."""
    path, rows = new_folder(spark, "sheets"), star.observations(spark, sf)
    export.write_named_sheets(rows, path, limit=1000)
    return export.sheet_report(export.read_named_sheets(spark, path, rows.schema))


@query
def provenance(spark, sf):
    return export.provenance(_metadata(spark, sf), PERIOD, AREAS, ITEMS)


@query
def domain_summary(spark, sf):
    return export.domain_summary(_metadata(spark, sf))
