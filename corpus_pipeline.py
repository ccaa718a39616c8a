"""The corpus pipeline: known languages, one of near copies, no repeated passages, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept.  All but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsmill.llm import langid, packing, simhash, suffix_dedup
from obsmill.llm.frames import free, named, quoted, stored
from obsmill.session import small_batches

SHINGLE, DISTANCE, PASSAGE_BYTES, PASSAGE_WORDS = 4, 4, 400, 51
TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.json", 0, 1024

#: Not every stage can be told in SQL; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected are those without a letter or below the threshold."""
    small_batches(spark)
    answer = free(docs, "language_id")
    found = langid.identify(docs, langid.fit(docs), into=answer)
    return found.where(F.col(answer).accepted).select(*quoted(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    small_batches(spark)
    row = free(docs, "row")
    kept = simhash.groups(docs, SHINGLE, DISTANCE).where("keep").select(F.col("row").alias(row))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(kept, row, "left_semi").select(*quoted(docs))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of over 50 words or of 400 bytes that occur again; characters are never cut."""
    small_batches(spark)
    left = free(docs, "left")
    cut = suffix_dedup.without_repeats(docs, PASSAGE_BYTES, into=left, words=PASSAGE_WORDS)
    rest = F.col(left).rest
    changed = {"text": rest, "n_chars": F.char_length(rest).cast("long")}
    return cut.select(*(changed[c].alias(c) if c in changed else F.col(named(c)) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of one length, with their ids."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID, CAPACITY)


STAGES = [
    ("language_id", known_languages),
    ("simhash_near_dedup", one_of_near_copies),
    ("suffix_dedup", without_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
