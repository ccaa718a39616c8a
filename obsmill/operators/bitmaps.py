"""Options as bitmaps: which years and which items there are, in words of bits that merge by `or`.

A set of years is some rows (word, bits): year y is bit y mod 32 of word y div 32.
Sets of any selection are merged word by word, so the work follows the stored
words and not the years, and only what has been merged is written out as years.
Items have numbers of their own, and an area's items are words of the same kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.operators.selection import Selection, apply_selection

# Half of a long, so that no sum or negation of a word overflows.
SHIFT = 5
WIDTH = 1 << SHIFT


def _one(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _word(number: Column) -> Column:
    return F.shiftright(number.cast("long"), SHIFT)


def _place(number: Column) -> Column:
    return number.cast("long").bitwiseAND(F.lit(WIDTH - 1).cast("long"))


def year_bits(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, word, bits): the years on record of each group; a group's null years are a row without word and bits."""
    year = F.col("Year")
    return rows.groupBy(*by, _word(year).alias("word")).agg(F.bit_or(_one(_place(year))).alias("bits"))


def merged_bits(words: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The union of the sets of each group."""
    return words.groupBy(*by, "word").agg(F.bit_or("bits").alias("bits"))


def numbers_of(words: DataFrame, name: str = "Year") -> DataFrame:
    """The members of a merged set, one row each; at most 32 for a word."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.getbit("bits", i) == 1)
    listed = words.where(F.col("bits").isNotNull()).select("word", F.explode(places).alias("place"))
    return listed.select((F.col("word") * WIDTH + F.col("place")).cast("int").alias(name))


def with_range(words: DataFrame, first: str, last: str) -> DataFrame:
    """Words with the smallest and the largest year of each; null where there is none."""
    bits, start = F.col("bits"), F.col("word") * WIDTH
    lowest = F.bit_count(bits.bitwiseAND(-bits) - 1)
    highest = F.char_length(F.bin(bits)) - 1
    return words.withColumns({first: (start + lowest).cast("int"), last: (start + highest).cast("int")})


def period_bits(first: int, last: int) -> Column:
    """The bits of a word's years from `first` to `last`."""
    start = F.col("word") * WIDTH
    low = F.greatest(F.lit(first) - start, F.lit(0))
    high = F.least(F.lit(last) - start, F.lit(WIDTH - 1))
    below = _one(F.greatest(F.lit(0), F.least(low, F.lit(WIDTH)))) - 1
    until = _one(F.greatest(F.lit(0), high + 1)) - 1
    return F.when((low > WIDTH - 1) | (high < 0) | F.lit(first > last), F.lit(0).cast("long")).otherwise(until - below)


def years_offered(words: DataFrame, selection: Selection) -> DataFrame:
    """Years on record of a selection: the words of its areas, items and elements, merged; of these the ones in its period."""
    chosen = apply_selection(words, Selection(selection.areas, selection.items, selection.elements))
    merged = merged_bits(chosen)
    if selection.years is not None:
        merged = merged.withColumn("bits", F.col("bits").bitwiseAND(period_bits(*selection.years)))
    return numbers_of(merged)


def items_offered(words: DataFrame, selection: Selection) -> DataFrame:
    """Items that have any year of a selection's period on record there; without a period, any row."""
    chosen = apply_selection(words, Selection(selection.areas, selection.items, selection.elements))
    if selection.years is not None:
        chosen = chosen.where(F.col("bits").bitwiseAND(period_bits(*selection.years)) != 0)
    return chosen.where(F.col("Item").isNotNull()).select("Item").distinct()


def member_years(words: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, dimension, member, min_year, max_year, n_years): each area, item and element, and "all", with how many different
    years it has."""
    by = list(by)
    kinds = {kind: F.col(kind.capitalize()).cast("string") for kind in ("area", "item", "element")}
    members = F.array(*(F.struct(F.lit(k).alias("dimension"), c.alias("member")) for k, c in {"all": F.lit(None).cast("string"), **kinds}.items()))
    # Few words are left for each member before years are counted.
    listed = words.select(*by, "word", "bits", F.inline(members)).where(F.col("member").isNotNull() | (F.col("dimension") == "all"))
    own = with_range(merged_bits(listed, [*by, "dimension", "member"]), "first", "last")
    return own.groupBy(*by, "dimension", "member").agg(
        F.min("first").alias("min_year"),
        F.max("last").alias("max_year"),
        F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n_years"),
    )


def numbered(items: DataFrame) -> DataFrame:
    """(Item, number): a number for each distinct item.  Write it before use, as another run may number otherwise."""
    named = items.where(F.col("Item").isNotNull()).select("Item").distinct()
    return named.select("Item", F.monotonically_increasing_id().alias("number"))


def item_bits(index: DataFrame, numbers: DataFrame) -> DataFrame:
    """(Area, word, bits): the items with a harvested area in each area, from an index of availability and numbered items."""
    number = F.col("number")
    own = index.where("harvested").join(numbers, "Item")
    return own.groupBy("Area", _word(number).alias("word")).agg(F.bit_or(_one(_place(number))).alias("bits"))


def items_of(words: DataFrame, numbers: DataFrame) -> DataFrame:
    """The items of a merged set of item numbers."""
    number = F.col("number")
    placed = numbers.select("Item", _word(number).alias("word"), _place(number).cast("int").alias("place"))
    return placed.join(words, "word").where(F.getbit("bits", F.col("place")) == 1).select("Item")
