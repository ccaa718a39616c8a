"""Text column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters a spreadsheet takes as the start of a formula.
FORMULA_STARTS = "=+-@"

_FORMULA = r"(?U)^[\s\x1c-\x1f]*[" + FORMULA_STARTS.replace("-", r"\-") + "]"


def formula_safe(text: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(text.rlike(_FORMULA), F.concat(F.lit("'"), text)).otherwise(text)


def as_text(df: DataFrame, name: str) -> Column:
    """A column as a reader sees it: all digits of doubles, plainly.

    Doubles that Spark would print with an exponent go through a decimal that
    holds all their digits; only below 1e-20 and from 1e26 on, where no decimal
    does, the exponent stays.
    """
    col = F.col(f"`{name}`")
    if not isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.cast("string")
    shortest = col.cast("double").cast("string")
    small = col.cast("double").try_cast("decimal(38,37)")
    large = col.cast("double").try_cast("decimal(38,12)")
    wide = F.when(F.abs(col) < 1e-20, F.lit(None)).when(F.abs(col) < 1e-3, small.cast("string"))
    plain = F.regexp_replace(wide.otherwise(large.cast("string")), r"(\.\d+?)0+$", "$1")
    return F.when(F.contains(shortest, F.lit("E")), F.coalesce(plain, shortest)).otherwise(shortest)


def any_column_contains(df: DataFrame, text: str) -> Column:
    """True where one single column holds the text, whatever its case."""
    wanted = F.upper(F.lit(text))
    found = [
        F.coalesce(F.contains(F.upper(as_text(df, c)), wanted), F.lit(False)) for c in df.columns
    ]
    return reduce(or_, found)


def series_name() -> Column:
    return F.concat(F.col("Area"), F.lit(" · "), F.col("Item"))
