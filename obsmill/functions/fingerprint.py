"""Order-free fingerprints of rows that any engine can work out.

A row's text has every column, in the order of their names: `n` for a missing
value, else the bytes of its text, a colon and the text.  The two halves of the
text's MD5 are numbers, and a set of rows is told by their count and sums, which
depend on neither order nor files and add up over parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = float(1 << 31)
#: Sizes of doubles whose bits all lie within the five numbers that spell them.
LEAST, MOST = 2.0**-40, 2.0**93
#: Sums of 64-bit halves, of any number of rows there is.
HALF = "decimal(38,0)"
#: Columns of a row's halves, beside its own columns.
DIGEST, HALVES = "_row_digest", ("_first_half", "_second_half")


def _spelled(value: Column) -> Column:
    """A double as sign and whole numbers of 31 bits each; scaling by powers of two loses nothing.

    Engines print doubles in different ways, so their texts can't be compared;
    only sizes beyond LEAST and MOST are spelled as this engine prints them.
    """
    size = F.abs(value)
    parts, rest = [], size / STEP
    for _ in range(5):
        whole = F.floor(rest)
        parts.append(whole.cast("string"))
        rest = (rest - whole.cast("double")) * STEP
    spelled = F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("+")), F.concat_ws(":", *parts))
    return F.when((size < MOST) & ((size >= LEAST) | (size == 0)), spelled).otherwise(value.cast("string"))


def row_text(df: DataFrame) -> Column:
    """The text of a row; columns of one name in any order have one text."""
    cells = []
    for name in sorted(df.columns):
        value = F.col("`" + name.replace("`", "``") + "`")
        kind = df.schema[name].dataType
        text = _spelled(value.cast("double")) if isinstance(kind, (T.DoubleType, T.FloatType)) else value.cast("string")
        cells.append(F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.concat(*cells)


def with_halves(df: DataFrame) -> DataFrame:
    """Adds the two halves of the MD5 of a row's text, as numbers."""
    digested = df.withColumn(DIGEST, F.md5(row_text(df).cast("binary")))
    halves = {name: F.conv(F.substring(DIGEST, at, 16), 16, 10).cast(HALF) for name, at in zip(HALVES, (1, 17), strict=True)}
    return digested.withColumns(halves).drop(DIGEST)


def summed(first: Column | str = "first", second: Column | str = "second") -> tuple[Column, ...]:
    """Sums of the halves, which add up over parts."""
    return F.sum(first).cast(HALF).alias("first"), F.sum(second).cast(HALF).alias("second")


def fingerprint(first: str = "first", second: str = "second") -> Column:
    """The two sums as one text."""
    return F.concat_ws("-", F.col(first).cast("string"), F.col(second).cast("string"))
