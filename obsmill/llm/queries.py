"""The registered queries of the corpus operators, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsmill.llm import (
    conversations, langid, lexical, minhash, packing, shards, simhash, sketch_dedup, suffix_dedup, token_files, topk, warc, word_bpe,
)
from obsmill.llm.frames import stored
from obsmill.sources.workspace import new_folder

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
TOKEN_FILE_END, PACKING_END, CAPACITY, SHARDS, PASSAGE_WORDS = 2, 0, 1024, 8, 51


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without strings of 400 bytes that occur again.

    Further columns: the bytes of these and of passages of 51 words that occur
    again, and the text that is left without either.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    left = suffix_dedup.without_repeats(docs, length=400, words=PASSAGE_WORDS)
    counts = [F.col(f"left.{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "n_passage_bytes")]
    return left.select("doc_id", *counts, F.sha2(F.col("left.kept"), 256).alias("kept_sha256"), F.col("left.rest").alias("text"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back with their starts and checksums."""
    folder = new_folder(spark, "tokens")
    path = public_tokenizers.path(BYTE_BPE)
    token_files.write_tokens(_table(spark, sf_dir, "documents"), folder, path, TOKEN_FILE_END)
    rows = token_files.read_tokens(spark, folder)
    summed = token_files.with_start(token_files.with_checksum(rows), rows)
    return summed.select("doc_id", "start", "n_tokens", "ids_crc32", F.col("part").alias("file_part"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each document in eight shards of nearly equal bytes."""
    placed = shards.shard_table(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op4_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents and of what the ids decode to."""
    return word_bpe.digests(word_bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    path = public_tokenizers.path(BYTE_BPE)
    pieces = packing.pack(_table(spark, sf_dir, "documents"), path, PACKING_END, CAPACITY, keep_ids=False)
    return pieces.drop("ids")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the smallest id that links of four bits reach."""
    found = simhash.groups(_table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back and assembled."""
    folder = new_folder(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    records = stored(warc.read_records(spark, folder, keep_payload=False), "warc-records")
    return warc.page_ids(warc.assemble(records))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from labelled ones that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select(
        "doc_id",
        langid.held_out(F.col("doc_id")).alias("held_out"),
        F.col("language_id.language").alias("lang_pred"),
        F.col("language_id.score").alias("score"),
        F.col("language_id.accepted").alias("accepted"),
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products for every hundredth vector, against all others."""
    found = topk.search(_table(spark, sf_dir, "embeddings"), k=10, every=100)
    return found.drop("query_row")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, against an edited copy and the next document."""
    return minhash.compare_with_next(_table(spark, sf_dir, "documents"))


def op11_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shingles of all documents and the smallest id that links of near copies reach."""
    found = sketch_dedup.groups(_table(spark, sf_dir, "documents"), size=3, share=85, whole=100)
    return found.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "kept")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of all conversations after damage, and their cheapest repair."""
    rows = conversations.messages(_table(spark, sf_dir, "conversations"))
    return conversations.repaired(conversations.damaged(rows))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest score for each benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_dedup, op2_token_files, op3_shards, op4_word_bpe, op5_packing, op6_simhash, op7_warc, op8_language_id,
        op9_topk, op10_minhash, op11_sketch_dedup, op12_conversation_repair, op13_lexical_search,
    )
    return {query.__name__: query for query in found}
