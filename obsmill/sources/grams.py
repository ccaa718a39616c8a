"""An index of three-letter strings for literal search.

A row that holds a text holds all three-letter strings of it, so only rows that
do are looked at.  The index has a row for each such string of a table's row,
sorted by string, so that a search reads few of its files and pages; it is as
large as the text has different strings.  Strings are found by numpy for some
rows at a time, whatever the row groups of the table, and one exchange sorts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsmill.functions.text import as_text
from obsmill.operators.selection import literal_search
from obsmill.session import importable, union_all

SIZE = 3
#: A search asks for so many strings of its text at most; rows are compared with the whole text in any case.
MOST_ASKED = 64
#: A worker handles so many rows, and about so many bytes of them, at a time.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20
OPTIONS = {"compression": "zstd", "parquet.page.row.count.limit": "20000"}


def _letters(text: Column) -> Column:
    return F.split(F.upper(text), "")


def _grams(letters: str) -> Column:
    """The three-letter strings of a column of letters; the column is worked out before, once for a row."""
    own = F.col(letters)
    places = F.when(F.size(own) >= SIZE, F.sequence(F.lit(0), F.size(own) - SIZE))
    strings = F.transform(places, lambda i: F.concat(*(F.get(F.col(letters), i + j) for j in range(SIZE))))
    return F.filter(F.coalesce(strings, F.array().cast("array<string>")), lambda s: F.char_length(s) == SIZE)


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, strung together, and how many each text has."""
    spelled = [t.as_buffer().to_pybytes().decode("utf-8", "replace") for t in texts]
    points = np.frombuffer("".join(spelled).encode("utf-32-le"), dtype="<u4")
    return points, np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled))


def _found(columns: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """(row, string) for the different three-letter strings of each row's columns."""
    spelled = [_points(c) for c in columns]
    numbers = np.zeros(0x110000, dtype=np.int64)  # of the letters that occur, by code point
    for points, _ in spelled:
        numbers[points] = 1
    letters = np.flatnonzero(numbers)
    numbers[letters] = np.arange(len(letters))
    size, rows = len(letters), len(columns[0])
    if rows > 1 and rows * size**SIZE >= 1 << 63:  # a row and its string are one number
        half = rows // 2
        (r, a), (q, b) = _found([c[:half] for c in columns]), _found([c[half:] for c in columns])
        return np.concatenate([r, q + half]), pa.concat_arrays([a, b])
    keys = []
    for points, counts in spelled:
        row, own = np.repeat(np.arange(rows), counts), numbers[points]
        key = row[: 1 - SIZE] * size**SIZE + (own[:-2] * size + own[1:-1]) * size + own[2:]
        keys.append(key[row[:-2] == row[2:]])
    found = np.sort(np.concatenate(keys))  # by far faster here than np.unique, which hashes
    row, string = np.divmod(found[np.diff(found, prepend=-1) > 0], max(size, 1) ** SIZE)
    strings, place = np.unique(string, return_inverse=True)
    wide = np.stack([letters[strings // size**i % size] for i in reversed(range(SIZE))], axis=1) if size else np.zeros((0, SIZE))
    text = wide.astype("<u4").tobytes().decode("utf-32-le")
    names = pa.array([text[i : i + SIZE] for i in range(0, len(text), SIZE)], pa.string())
    return row, names.take(pa.array(place))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with few rows and few bytes of text; a row is never cut."""
    sizes = sum(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        most = SLICE_BYTES + (ends[at - 1] if at else 0)
        take = min(max(int(np.searchsorted(ends, most, side="right")) - at, 1), SLICE_ROWS)
        yield batch.slice(at, take)
        at += take


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            row, strings = _found(part.columns[1:])
            yield pa.RecordBatch.from_arrays([strings, part.column(0).take(pa.array(row))], names=["gram", "id"])


def write_grams(df: DataFrame, id_col: str, path: str) -> None:
    """Writes the index of all columns of a table to a folder; rows without an id are left out, as searches scan them.

    Rows that share an id have their own strings each.
    """
    importable(df.sparkSession)
    spelled = [F.upper(F.coalesce(as_text(df, c), F.lit(""))).alias(f"text_{i}") for i, c in enumerate(df.columns)]
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *spelled)
    # A few large row groups of a file would be as few tasks.
    spread = texts.hint("rebalance")
    listed = spread.mapInArrow(_listed, T.StructType([T.StructField("gram", T.StringType()), texts.schema["id"]]))
    ordered = listed.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")
    ordered.write.options(**OPTIONS).parquet(path)


def asked_grams(spark: SparkSession, text: str) -> list[str]:
    """The strings a search for a text asks for; none for texts of fewer letters."""
    letters = spark.createDataFrame([(text,)], "text string").select(_letters(F.col("text")).alias("letters"))
    return letters.select(F.slice(F.array_distinct(_grams("letters")), 1, MOST_ASKED)).first()[0]


def indexed_search(df: DataFrame, index: DataFrame, id_col: str, text: str) -> DataFrame:
    """The rows `literal_search` finds, by an index that `write_grams` made of the same table.

    Texts too short for the index, and rows without an id, are searched by a scan.
    """
    wanted = asked_grams(df.sparkSession, text)
    if not wanted:
        return literal_search(df, text)
    holding = index.where(F.col("gram").isin(wanted)).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
    likely = df.join(holding.select(F.col("id").alias(id_col)), id_col, "left_semi").select(*df.columns)
    return literal_search(union_all(likely, df.where(F.col(id_col).isNull())), text)
