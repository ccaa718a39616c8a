"""The registered corpus queries and the pipeline on the smallest tables."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from obsmill.llm import langid, oracle, queries
from obsmill.llm.frames import stored
from tests.llm.test_copies import linked_by, plain_fingerprint, plain_removal, plain_rest
from tests.llm.test_tokens import check_pieces, library_ids

FOLDER = "/root/testdata/sf0.001"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_the_operators_and_the_pipeline_are_registered():
    names = set(contract.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


@pytest.mark.parametrize("name", sorted(oracle.oracle()))
def test_queries_equal_their_sql(spark, name):
    connection = duckdb.connect()
    for table in ("pages", "embeddings", "documents", "benchmark", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = connection.execute(oracle.oracle()[name])
    columns = [c[0] for c in result.description]
    frame = queries.registry()[name](spark, FOLDER)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in frame.collect()) == sorted(result.fetchall())


@pytest.mark.parametrize("name", [n for n in sorted(queries.registry()) if n not in oracle.oracle()])
def test_queries_return_every_document(spark, name):
    documents = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in queries.registry()[name](spark, FOLDER).select("doc_id").collect()} == documents


def test_repeats_of_the_query_equal_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    expected = plain_removal([(r.text or "").encode() for r in rows], 400)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op1_suffix_dedup(spark, FOLDER).collect()}
    assert found == {r.doc_id: e for r, e in zip(rows, expected, strict=True)}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    (_, language), (_, near), (_, passages), (_, pack) = corpus_pipeline.STAGES

    kept = stored(language(spark, docs, FOLDER), "stage")
    assert kept.schema == docs.schema
    answers = langid.identify(docs, langid.fit(docs)).select("doc_id", "language_id.accepted").collect()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in answers if r.accepted}

    one = stored(near(spark, kept, FOLDER), "stage")
    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    prints = [plain_fingerprint(r.text) for r in rows]
    roots = linked_by(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert sorted(one.collect()) == sorted(r for i, r in enumerate(rows) if roots[i] == i)

    cut = stored(passages(spark, one, FOLDER), "stage")
    assert cut.schema == docs.schema and cut.count() == one.count()
    texts = {r.doc_id: r.text for r in one.collect()}
    rest = plain_rest(list(texts.values()), corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)
    assert {r.doc_id: r.text for r in cut.collect()} == dict(zip(texts, rest, strict=True))
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    pieces = pack(spark, cut, FOLDER).collect()
    ids = {r.doc_id: [*library_ids(r.text), 0] for r in cut.collect()}
    check_pieces(pieces, list(ids.values()), 1024)
    for doc_id in ids:
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert [i for p in own for i in p.ids] == ids[doc_id]


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like those that the stages make for themselves come through as they are."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    names = ["left", "_left", "row", "_row", "_kept", "language_id", "a.b", "a`b", "spans", "word_spans", "row_number", "fp", "Node"]
    docs = stored(docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}), "names")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER), "stage")
        rows = docs.collect()
        assert rows and docs.columns == [*COLUMNS, *names], name
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= len(rows)


def test_stages_of_nothing_and_of_nulls(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for own in (docs.limit(0), nulls):
        for name, stage in corpus_pipeline.STAGES[1:]:
            assert stage(spark, own, FOLDER).count() >= 0, name
        assert corpus_pipeline.STAGES[0][1](spark, own, FOLDER).count() == 0


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_stages_send_small_batches_to_workers(spark):
    docs = spark.range(0, 24, 1, 1).selectExpr("id doc_id", "repeat(concat('word', id, ' '), 80000) text", "'en' lang", "'s' source", "0L n_chars")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(BATCH_BYTES)
        stage(spark, docs.limit(0), FOLDER)
        found = [r.size for r in docs.mapInArrow(sizes, "size long").collect()]
        assert max(found) < 8 << 20 < sum(found), name
