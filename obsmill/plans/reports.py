"""The datasets behind each report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsmill.functions.text import series_name
from obsmill.functions.values import exact_sum, percent_change, safe_ratio
from obsmill.operators.change import period_change
from obsmill.operators.geography import in_scope
from obsmill.operators.measures import (
    aggregate,
    key_cells,
    normalize_yields,
    sum_by,
    weighted_yield,
    yield_of,
)
from obsmill.operators.partials import merged, price_states, prices_of
from obsmill.operators.ranking import (
    match_keys,
    shares_and_ranks,
    top_area,
    top_rows,
)
from obsmill.operators.selection import Selection, apply_selection, select_observations
from obsmill.operators.trade import trade_by_item
from obsmill.schema import (
    AGGREGATE_FLAG,
    AREA_HARVESTED,
    CROP_ELEMENTS,
    CROP_UNITS,
    PRICE_ELEMENT,
    PRODUCTION,
    TRADE_ELEMENTS,
    WORLD,
    YIELD,
)
from obsmill.session import union_all

# ---- Series ------------------------------------------------------------------

SERIES_COLUMNS = ("Element", "series", "Area", "Item", "Year", "Unit", "Value", "flag")


def _flag(df: DataFrame) -> Column:
    return F.col("Flag") if "Flag" in df.columns else F.lit(None).cast("string")


def series_rows(df: DataFrame) -> DataFrame:
    """One line per area and item, with normalised yields."""
    return (
        normalize_yields(df)
        .withColumns({"series": series_name(), "flag": _flag(df)})
        .select(*SERIES_COLUMNS)
    )


def _as_series(by_item: DataFrame) -> DataFrame:
    return by_item.withColumns(
        {
            "series": F.col("Item"),
            "Area": F.lit(None).cast("string"),
            "flag": F.lit(AGGREGATE_FLAG),
        }
    ).select(*SERIES_COLUMNS)


def rolled_up_series(df: DataFrame, element: str) -> DataFrame:
    """One line per item: the element aggregated over the areas."""
    return _as_series(aggregate(df, element, ["Item", "Year"]).withColumn("Element", F.lit(element)))


def series_guard(df: DataFrame, by: Sequence[str] = ("Element",)) -> DataFrame:
    """Counts the report rules look at.  Missing names are not counted.

    The series are made distinct first, so the distinct counts run over few rows.
    """
    series = normalize_yields(df).groupBy(*by, "Area", "Item", "Unit").agg(
        F.count("Value").alias("n")
    )
    return series.groupBy(*by).agg(
        F.count_distinct(series_name()).alias("n_series"),
        F.count_distinct("Unit").alias("n_units"),
        F.count_distinct("Area").alias("n_areas"),
        F.count_distinct("Item").alias("n_items"),
        F.sum("n").alias("n_values"),
    )


def _by_area(level: str) -> bool:
    if level not in ("area", "item"):
        raise ValueError(f"unknown level {level}")
    return level == "area"


def history_series(df: DataFrame, element: str, level: str = "area") -> DataFrame:
    """Series of one element: a line per area and item, or at level "item" one per item.

    `series_guard` counts the lines, for callers that show only so many.
    """
    if _by_area(level):
        return series_rows(df.where(F.col("Element") == element))
    return rolled_up_series(df, element)


def trade_series(trade: DataFrame, level: str = "area") -> DataFrame:
    """The same for all trade flows; an empty flow has no rows."""
    flows = trade.where(F.col("Element").isin(*TRADE_ELEMENTS))
    return series_rows(flows) if _by_area(level) else _as_series(trade_by_item(flows))


def price_series(prices: DataFrame) -> DataFrame:
    """Annual prices per area and item; prices are never added up."""
    return series_rows(prices)


# ---- Rankings, shares, comparisons ---------------------------------------------


def world_ranking(
    crops: DataFrame, countries: DataFrame, indicator: str, years: tuple[int, int], scope: Sequence[str]
) -> DataFrame:
    """All countries ranked per year in the indicator's unit, the selected ones marked.

    A year and unit has one row per country, of which there are a few hundred
    whatever the facts, so a plain window ranks them.
    """
    population = in_scope(crops.where(F.col("Year").between(*years)), countries)
    values = aggregate(population, indicator, ["Area", "Year"])
    return _ranked(values.where(F.col("Unit") == CROP_UNITS[indicator]), scope)


def world_ranking_of_states(
    states: DataFrame, countries: DataFrame, indicator: str, years: tuple[int, int], scope: Sequence[str]
) -> DataFrame:
    """The same from stored states, without a look at the observations."""
    population = in_scope(states.where(F.col("Year").between(*years)), countries)
    return _ranked(merged(population, indicator, ["Area", "Year"]), scope)


def _ranked(values: DataFrame, scope: Sequence[str]) -> DataFrame:
    ranked = shares_and_ranks(values, ["Year", "Unit"], small=True)
    return ranked.withColumn("in_selection", F.coalesce(F.col("Area").isin(list(scope)), F.lit(False)))


def production_share(crops: DataFrame, countries: DataFrame) -> DataFrame:
    """Production per area and year against the published World total of the year."""
    made = crops.where((F.col("Element") == PRODUCTION) & (F.col("Unit") == CROP_UNITS[PRODUCTION]))
    world = (
        made.where(F.col("Area") == WORLD)
        .groupBy("Year")
        .agg(exact_sum(F.col("Value")).alias("world_value"))
    )
    own = sum_by(in_scope(made, countries), PRODUCTION, ["Area", "Year"])
    share = safe_ratio(F.col("Value"), F.when(F.col("world_value") > 0, F.col("world_value"))) * 100
    # The null-safe join adds no filter to one side only, so both sides can
    # share one scan and shuffle of the facts.
    return match_keys(own.where(F.col("Value").isNotNull()), world, ["Year"], "left").withColumn(
        "share_pct", share
    )


def top_shares(shares: DataFrame, n: int) -> DataFrame:
    """The n greatest producers of each year; their shares stay shares of the world."""
    return top_rows(shares, ["Year"], n)


def country_comparison(crops: DataFrame) -> DataFrame:
    """Three indicators per area, for years in which two areas or more are on record."""
    wide = crops.groupBy("Year").agg(F.count_distinct("Area").alias("n")).where("n >= 2")
    rows = crops.join(wide, "Year", "left_semi")
    each = [
        aggregate(rows, e, ["Area", "Year"]).select(
            F.lit(e).alias("Element"), "Area", "Year", "Unit", "Value"
        )
        for e in CROP_ELEMENTS
    ]
    return union_all(*each).where(F.col("Value").isNotNull())


def crop_comparison(crops: DataFrame, indicator: str) -> DataFrame:
    """The indicator by item and area, for years in which two items or more have it."""
    rows = normalize_yields(crops.where(F.col("Element") == indicator))
    wide = rows.groupBy("Year").agg(F.count_distinct("Item").alias("n")).where("n >= 2")
    return rows.join(wide, "Year", "left_semi").select("Item", "Area", "Year", "Unit", "Value")


def map_values(values: DataFrame, countries: DataFrame) -> DataFrame:
    """Values of countries with an ISO3 code and the top of the year's colour range."""
    coded = values.where(F.col("Value").isNotNull()).join(
        countries.where(F.col("ISO3").isNotNull()).select("Area", "ISO3"), "Area"
    )
    top = coded.groupBy("Year").agg(F.greatest(F.max("Value"), F.lit(1.0)).alias("color_max"))
    return match_keys(coded, top, ["Year"])


# ---- What is missing -------------------------------------------------------------


def missing_items(requested: DataFrame, facts: DataFrame) -> DataFrame:
    """Requested items without a single value."""
    return requested.join(
        facts.where(F.col("Value").isNotNull()).select("Item").distinct(), "Item", "left_anti"
    )


def missing_items_by_domain(requested: DataFrame, facts: DataFrame, domains: Sequence[str]) -> DataFrame:
    wanted = requested.withColumn("Domain", F.explode(F.array(*[F.lit(d) for d in domains])))
    present = facts.where(F.col("Value").isNotNull()).select("Domain", "Item").distinct()
    return wanted.join(present, ["Domain", "Item"], "left_anti")


# ---- Key figures -------------------------------------------------------------------


def kpi_totals(crops: DataFrame) -> DataFrame:
    """Totals per year in the reporting units, side by side; null where nothing is reported."""

    def of(element: str) -> Column:
        here = (F.col("Element") == element) & (F.col("Unit") == CROP_UNITS[element])
        return exact_sum(F.when(here, F.col("Value")))

    return crops.groupBy("Year").agg(
        of(PRODUCTION).alias("production_t"), of(AREA_HARVESTED).alias("harvested_ha")
    )


def kpi_price(prices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The price where exactly one row has a value, otherwise null."""
    value = F.col("Value")
    return prices.groupBy(*by).agg(F.when(F.count(value) == 1, F.max(value)).alias("price"))


def _areas_by_year(cells: DataFrame) -> DataFrame:
    """Per area and year what key figures need: sums, and the parts of a weighted yield."""
    y, a = F.col("yield_kg_ha"), F.col("harvested_ha")
    return cells.groupBy("Area", "Year").agg(
        exact_sum(F.col("production_t")).alias("made"),
        exact_sum(F.col("area_ha")).alias("cut"),
        F.count("*").alias("n_rows"),
        F.count(y).alias("n_yield"),
        F.count(F.when(a > 0, 1)).alias("n_positive_area"),
        F.max(y).alias("only_yield"),
        exact_sum(y * a).alias("weighted"),
        exact_sum(a).alias("harvested"),
    )


def kpi_summary(
    crops: DataFrame,
    prices: DataFrame,
    countries: DataFrame,
    areas: Sequence[str],
    items: Sequence[str],
    years: tuple[int, int],
    indicator: str = PRODUCTION,
) -> DataFrame:
    """Key figures of a selection in its last year, one row per figure.

    The last year is the one asked for, never an earlier one that happens to
    have data; the change needs the year before inside the selected period.
    Crops are read once: sums, yields and the rank among all countries follow
    from one row per area and year.
    """
    paid = select_observations(prices, "PP", Selection(areas, items, [PRICE_ELEMENT], (years[1], years[1])))
    recent = crops.where(F.col("Item").isin(list(items)) & F.col("Year").isin(years[1] - 1, years[1]))
    return kpi_of_cells(key_cells(recent), price_states(paid), countries, areas, items, years, indicator)


def kpi_of_cells(
    cells: DataFrame,
    prices: DataFrame,
    countries: DataFrame,
    areas: Sequence[str],
    items: Sequence[str],
    years: tuple[int, int],
    indicator: str = PRODUCTION,
) -> DataFrame:
    """The same from one row per area, item and year, as `key_cells` or stored states give them."""
    last = years[1]
    before = last - 1 if last - 1 >= years[0] else None
    one_area = len(areas) == 1
    recent = cells.where(
        F.col("Item").isin(list(items)) & F.col("Year").isin([y for y in (before, last) if y is not None])
    )
    if not one_area:  # nothing is ranked
        recent = recent.where(F.col("Area").isin([*areas, WORLD]))
    rows = _areas_by_year(recent)

    col, number = F.col, F.lit(None).cast("double")
    if one_area:
        # A few hundred areas in two years, whatever the facts.
        listed = countries.select("Area").distinct().withColumn("_listed", F.lit(True))
        value = {PRODUCTION: col("made"), AREA_HARVESTED: col("cut"), YIELD: yield_of(col)}[indicator]
        ranked = rows.join(listed, "Area", "left").withColumn("_value", F.when(col("_listed"), value))
        own = F.max(F.when(col("Area") == areas[0], col("_value"))).over(Window.partitionBy("Year"))
        rows = ranked.withColumn("_own", own)

    def over(name: str, year: int | None, where: Column, aggregate=exact_sum) -> Column:
        here = where & (col("Year") == F.lit(year).cast("int"))
        return aggregate(F.when(here, col(name)))

    def yielded(year: int | None) -> Column:
        kinds = {"only_yield": F.max, "n_rows": F.sum, "n_yield": F.sum, "n_positive_area": F.sum}
        return yield_of(lambda name: over(name, year, chosen, kinds.get(name, exact_sum)))

    chosen, world = col("Area").isin(list(areas)), col("Area") == WORLD
    above = F.count(F.when((col("Year") == last) & (col("_value") > col("_own")), 1)) if one_area else number
    has_rank = F.max(F.when(col("Year") == last, col("_own"))).isNotNull() if one_area else F.lit(False)
    sums = rows.agg(
        over("made", last, chosen).alias("made"),
        over("made", before, chosen).alias("made_before"),
        over("cut", last, chosen).alias("cut"),
        over("cut", before, chosen).alias("cut_before"),
        over("made", last, world).alias("world"),
        yielded(last).alias("y"),
        yielded(before).alias("y_before"),
        F.when(has_rank, above + 1).cast("double").alias("rank"),
    )

    def figure(name: str, value: Column, unit: str, previous: Column | None = None) -> Column:
        change = number if previous is None else percent_change(value, previous)
        return F.struct(
            F.lit(name).alias("kpi"), value.alias("value"), F.lit(unit).alias("unit"), change.alias("change_pct")
        )

    def listed_rows(one: DataFrame, *figures: Column) -> DataFrame:
        return one.select(F.inline(F.array(*figures)))

    # The price needs one area in scope and one item, the rank one area.
    has_price = one_area and len(items) == 1
    figures = [
        figure("production", col("made"), "t", col("made_before")),
        figure("harvested_area", col("cut"), "ha", col("cut_before")),
        figure("world_production_share", safe_ratio(col("made"), col("world")) * 100, "%"),
        figure("yield", col("y"), "kg/ha", col("y_before")),
        figure("world_rank", col("rank"), "rank"),
    ]
    price = "producer_price", "USD/t"
    if not has_price:
        return listed_rows(sums, *figures, figure(price[0], number, price[1]))
    paid = prices_of(apply_selection(prices, Selection(areas, items, None, (last, last))))
    return union_all(listed_rows(sums, *figures), listed_rows(paid, figure(price[0], col("price"), price[1])))


# ---- Questions answered by rules ---------------------------------------------------

# ---- Fixed values: the word stems the rules look for, in the order of the rules
PRODUCTION_WORD = "productor"
YIELD_WORD = "rendimiento"
GROWTH_WORDS = ("creci", "aument")
TOP_WORDS = ("mayor", "ranking", "rendimiento")
# ------------------------------------------------------------------------------------


def question_intents(questions: DataFrame, text: str, indicator: str) -> DataFrame:
    """What each question asks for: an element and one of growth, top or count."""
    asked = F.lower(F.col(text))

    def mentions(words: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(asked, F.lit(w)) for w in words])

    element = (
        F.when(mentions([PRODUCTION_WORD]), PRODUCTION)
        .when(mentions([YIELD_WORD]), YIELD)
        .otherwise(indicator)
    )
    intent = F.when(mentions(GROWTH_WORDS), "growth").when(mentions(TOP_WORDS), "top").otherwise("count")
    return questions.where(F.col(text).rlike(r"(?U)\S")).withColumns(
        {"element": element, "intent": intent}
    )


ANSWERS = {
    "answer_area": "string",
    "answer_value": "double",
    "answer_unit": "string",
    "from_year": "int",
    "to_year": "int",
    "change_pct": "double",
    "n_rows": "bigint",
}


def rule_answers(crops: DataFrame, indicator: str, year: int) -> DataFrame:
    """One row per (intent, element): the answers questions can have over a selection."""
    elements = list(dict.fromkeys([PRODUCTION, YIELD, indicator]))
    summed = [e for e in elements if e != YIELD]

    def values(df: DataFrame, groups: list[str]) -> DataFrame:
        sums = (
            df.where(F.col("Element").isin(summed))
            .groupBy("Element", *groups, "Unit")
            .agg(exact_sum(F.col("Value")).alias("Value"))
        )
        return union_all(sums, weighted_yield(df, groups).withColumn("Element", F.lit(YIELD)))

    def answers(df: DataFrame, intent: str, **given: Column) -> DataFrame:
        columns = [
            (given[name] if name in given else F.lit(None)).cast(kind).alias(name)
            for name, kind in ANSWERS.items()
        ]
        return df.select(F.lit(intent).alias("intent"), "Element", *columns)

    col = F.col
    changes = period_change(values(crops, ["Year"]), ["Element"])
    growth = answers(
        changes.where(col("change_pct").isNotNull()), "growth",
        from_year=col("first_year"), to_year=col("last_year"), change_pct=col("change_pct"),
    )
    latest = values(crops.where(col("Year") == year), ["Area", "Year"])
    top = answers(
        top_area(latest, ["Element", "Year"], keep=["Unit"]), "top",
        answer_area=col("Area"), answer_value=col("Value"), answer_unit=col("Unit"), to_year=col("Year"),
    )
    size = crops.agg(F.count("*").alias("n")).withColumn(
        "Element", F.explode(F.array(*[F.lit(e) for e in elements]))
    )
    return union_all(growth, top, answers(size, "count", n_rows=col("n"))).withColumnRenamed(
        "Element", "element"
    )


def answered_questions(
    questions: DataFrame, text: str, crops: DataFrame, indicator: str, year: int
) -> DataFrame:
    """Questions with their answers; a question without enough data keeps nulls.

    The answers are at most nine rows whatever the data, so they are broadcast.
    """
    return question_intents(questions, text, indicator).join(
        F.broadcast(rule_answers(crops, indicator, year)), ["intent", "element"], "left"
    )
