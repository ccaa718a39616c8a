"""Observations derived from the star tables (lineitem, part, supplier, ...).

Every loader makes one pass over lineitem: it joins what it needs, aggregates
to (nation, type, year) cells, and only then turns cells into observations.
Some cells get no area or no yield, and one nation no imports: the model is
sparse, and the operators have to show that they keep what is missing missing.

No join carries a broadcast hint: Catalyst broadcasts a side when its measured
size is under spark.sql.autoBroadcastJoinThreshold and otherwise sorts and
merges, where adaptive execution splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsmill.schema import (
    ANNUAL,
    AREA_HARVESTED,
    CPC_COLUMN,
    CROP_ELEMENTS,
    EXPORT_QUANTITY,
    EXPORT_VALUE,
    IMPORT_QUANTITY,
    IMPORT_VALUE,
    M49_COLUMN,
    MONTHS_COLUMN,
    PRICE_ELEMENT,
    PRODUCTION,
    TRADE_ELEMENTS,
    WORLD,
    YIELD,
)
from obsmill.session import union_all

COLUMNS = (
    "Domain",
    "Area",
    M49_COLUMN,
    "Item",
    CPC_COLUMN,
    "Element",
    "Year",
    MONTHS_COLUMN,
    "Unit",
    "Value",
)


# The schemas of the star tables.  Given to the reader, so that
# opening a table starts no job to read file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _hundredths(name: str) -> Column:
    """A two-decimal amount as a whole number: sums are exact and stay in longs."""
    return F.rint(F.col(name) * 100).cast("bigint")


def _amount(hundredths: Column) -> Column:
    return hundredths.cast("double") / 100


def _shipped(lines: DataFrame, years: tuple[int, int] | None) -> DataFrame:
    """Lines of some years, by bounds on the date itself, so that files are pruned by them."""
    if years is None:
        return lines
    first, after = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (years[0], years[1] + 1))
    return lines.where((F.col("l_shipdate") >= first) & (F.col("l_shipdate") < after))


def _lines(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("Item"))
    lines = _shipped(table(spark, sf_dir, "lineitem"), years).select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.year("l_shipdate").alias("Year"),
        F.month("l_shipdate").alias("month"),
        _hundredths("l_quantity").alias("q"),
        _hundredths("l_extendedprice").alias("p"),
    )
    return lines.join(part, lines.l_partkey == part.p_partkey)


def _with_supplier(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("nk")
    )
    return lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)


def _named(cells: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nk"), F.col("n_name").alias("Area")
    )
    return cells.join(nation, "nk")


def _observation(element: str, unit: Column | str, value: Column, kept: Column | None = None) -> Column:
    row = F.struct(
        F.lit(element).alias("Element"),
        (F.lit(unit) if isinstance(unit, str) else unit).alias("Unit"),
        value.alias("Value"),
    )
    return row if kept is None else F.when(kept, row)


def _area_code(nk: Column) -> Column:
    return F.concat(F.lit("'"), F.lpad((nk + 100).cast("string"), 3, "0"))


def _finish(cells: DataFrame, domain: str, rows: Iterable[Column], months: Column) -> DataFrame:
    """One cell to its observations; nk -1 is the World row."""
    code = F.when(F.col("nk") < 0, F.lit("'001")).otherwise(_area_code(F.col("nk")))
    cpc = F.when(F.col("Item") == "PROMO", F.lit("'F1")).otherwise(
        F.concat(F.lit("'01"), F.substring("Item", 1, 1))
    )
    return cells.select(
        F.lit(domain).alias("Domain"),
        "Area",
        code.alias(M49_COLUMN),
        "Item",
        cpc.alias(CPC_COLUMN),
        "Year",
        months.alias(MONTHS_COLUMN),
        F.explode(F.array_compact(F.array(*rows))).alias("_o"),
    ).select(
        "Domain",
        "Area",
        M49_COLUMN,
        "Item",
        CPC_COLUMN,
        F.col("_o.Element").alias("Element"),
        "Year",
        MONTHS_COLUMN,
        F.col("_o.Unit").alias("Unit"),
        F.col("_o.Value").alias("Value"),
    )


def crops(
    spark: SparkSession,
    sf_dir: str,
    elements: Iterable[str] = CROP_ELEMENTS,
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """QCL: production, area harvested and yield, of some years or all.

    The distinct count of orders is the costly part, so it is left out when
    the wanted elements do not need it.
    """
    wanted = set(elements)
    lines = _with_supplier(_lines(spark, sf_dir, years), spark, sf_dir)
    sums = [F.sum("q").alias("q")]
    if wanted & {AREA_HARVESTED, YIELD}:
        # One row per order and cell first: a third faster than a distinct
        # aggregate, and the shuffle on the order key has no hot cell in it.
        lines = lines.groupBy("l_orderkey", "nk", "Item", "Year").agg(F.sum("q").alias("q"))
        sums.append(F.count("l_orderkey").cast("double").alias("harv"))
    cells = _named(lines.groupBy("nk", "Item", "Year").agg(*sums), spark, sf_dir)

    nk, year = F.col("nk"), F.col("Year")
    own = nk >= 0
    prod = _amount(F.col("q"))
    rows = []
    if PRODUCTION in wanted:
        # World is one more area of each cell; the sum stays a sum of whole numbers.
        both = F.array(
            F.struct(F.col("Area").alias("Area"), nk.alias("nk")),
            F.struct(F.lit(WORLD).alias("Area"), F.lit(-1).alias("nk")),
        )
        keep = [F.max("harv").alias("harv")] if len(sums) > 1 else []
        cells = (
            cells.withColumn("_a", F.explode(both))
            .groupBy("_a", "Item", "Year")
            .agg(F.sum("q").alias("q"), *keep)
            .select("_a.Area", "_a.nk", "*")
        )
        rows.append(_observation(PRODUCTION, "t", prod))
    if AREA_HARVESTED in wanted:
        rows.append(
            _observation(
                AREA_HARVESTED, "ha", F.col("harv"), own & ~((nk % 10 == 4) & (year % 4 == 0))
            )
        )
    if YIELD in wanted:
        published = F.floor(prod * 1000 / F.col("harv")).cast("double")
        value = (
            F.when(nk % 3 == 0, published * 10).when(nk % 3 == 1, published / 1000).otherwise(published)
        )
        unit = F.when(nk % 3 == 0, "hg/ha").when(nk % 3 == 1, "t/ha").otherwise("kg/ha")
        rows.append(
            _observation(YIELD, unit, value, own & ~((nk % 10 == 3) & (year % 3 == 0)))
        )
    return _finish(cells, "QCL", rows, F.lit(None).cast("string"))


def prices(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """PP: one annual price and monthly prices, from one pass by month."""
    lines = _with_supplier(_lines(spark, sf_dir, years), spark, sf_dir)
    cells = (
        lines.groupBy("nk", "Item", "Year", "month")
        .agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
        .withColumn(
            "months",
            F.explode(F.array(F.lit(ANNUAL), F.concat(F.lit("M"), F.col("month").cast("string")))),
        )
        .groupBy("nk", "Item", "Year", "months")
        .agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
    )
    price = _amount(F.col("p")) / _amount(F.col("q"))
    return _finish(
        _named(cells, spark, sf_dir), "PP", [_observation(PRICE_ELEMENT, "USD", price)], F.col("months")
    )


def trade(
    spark: SparkSession, sf_dir: str, elements: Iterable[str] = TRADE_ELEMENTS
) -> DataFrame:
    """TCL: exports by the supplier's nation, imports by the customer's.

    Both sides come from the same joined lines, aggregated first to
    (exporter, importer, type, year) and then once per side.
    """
    wanted = set(elements)
    lines = _lines(spark, sf_dir)
    sides = []
    if wanted & {EXPORT_QUANTITY, EXPORT_VALUE}:
        lines = _with_supplier(lines, spark, sf_dir).withColumnRenamed("nk", "exporter")
        sides.append(("Export", "exporter"))
    if wanted & {IMPORT_QUANTITY, IMPORT_VALUE}:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        customer = table(spark, sf_dir, "customer").select(
            "c_custkey", F.col("c_nationkey").alias("importer")
        )
        # Orders meet their customers first: there are several lines per order,
        # so this spares a shuffle of all lines on the customer key.
        importers = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
            "o_orderkey", "importer"
        )
        lines = lines.join(importers, lines.l_orderkey == importers.o_orderkey)
        sides.append(("Import", "importer"))
    nations = [column for _, column in sides]
    flow = F.array(
        *[
            F.struct(F.lit(name).alias("flow"), F.col(column).alias("nk"))
            for name, column in sides
        ]
    )
    cells = (
        lines.groupBy(*nations, "Item", "Year")
        .agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
        .withColumn("_f", F.explode(flow))
        .groupBy("_f", "Item", "Year")
        .agg(F.sum("q").alias("q"), F.sum("p").alias("p"))
        .select("_f.flow", "_f.nk", "Item", "Year", "q", "p")
        .where(~((F.col("flow") == "Import") & (F.col("nk") == 5)))
    )
    rows = []
    for name, _ in sides:
        here = F.col("flow") == name
        if f"{name} quantity" in wanted:
            rows.append(_observation(f"{name} quantity", "t", _amount(F.col("q")), here))
        if f"{name} value" in wanted:
            rows.append(_observation(f"{name} value", "1000 USD", _amount(F.col("p")), here))
    return _finish(_named(cells, spark, sf_dir), "TCL", rows, F.lit(None).cast("string"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three domains in one frame; a filter on Domain drops the other branches."""
    return union_all(crops(spark, sf_dir), prices(spark, sf_dir), trade(spark, sf_dir))


def area_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All areas with their codes, from the nation dimension instead of the facts."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("Area"), _area_code(F.col("n_nationkey")).alias(M49_COLUMN)
    )


def geography_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw geography rows of the nations, with the flaws a lookup has to settle."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    nk = F.col("n_nationkey")
    known = (
        nation.join(region, nation.n_regionkey == region.r_regionkey)
        .where(nk <= 22)
        .select(
            F.when(nk != 22, nk + 100).cast("int").alias("UNcode"),
            F.when(nk == 22, F.lit(122)).cast("int").alias("ISOnumeric"),
            F.concat(F.lit("N"), F.lpad(nk.cast("string"), 2, "0")).alias("ISO3"),
            F.col("r_name").alias("continent"),
            F.concat("r_name", F.lit("-"), (nk % 2).cast("string")).alias("UNregion"),
        )
    )
    twice = known.where(F.col("UNcode") == 100).withColumn("ISO3", F.lit("ZZZ"))
    codeless = known.where(F.col("UNcode") == 101).withColumns(
        {"UNcode": F.lit(None).cast("int"), "ISO3": F.lit("NIL")}
    )
    return union_all(known, twice, codeless)
