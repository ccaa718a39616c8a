"""Sharding, archives, language and search on small tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsmill.llm import langid, shards, topk, warc
from obsmill.sources.workspace import new_folder


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows have one text, a third no id."""
    rng = random.Random(1)
    rows = []
    for i in range(2000):
        text = "same text" if i % 2 else None if i % 14 == 0 else "é" * rng.randrange(200) + str(i)
        rows.append((None if i % 3 == 0 else i, text, 1, 2, 3))
    return spark.createDataFrame(rows, "doc_id long, text string, shard int, Part int, size int").coalesce(3)


def test_shards_are_of_equal_bytes(spark, skewed):
    found = shards.shard_table(skewed, 8).collect()
    size, slots = Counter(), defaultdict(list)
    for r in found:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 8
    assert all(abs(s / mean - 1) < 0.02 for s in size.values()) and len(size) == 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = Counter()
    for r in skewed.collect():
        data = (r.text or "").encode()
        expected[r.doc_id, len(data) + 1, zlib.crc32(data)] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == expected


def test_equal_texts_share_a_shard_where_they_can(spark):
    rng = random.Random(2)
    texts = ["t" * rng.randrange(300) + str(i % 400) for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = defaultdict(set)
    size = Counter()
    for r in shards.shard_table(docs, 4).collect():
        places[texts[r.doc_id]].add(r.shard)
        size[r.shard] += r.size
    assert all(len(s) == 1 for s in places.values())
    assert max(size.values()) < 1.03 * min(size.values())


def test_shards_hold_the_documents(spark, skewed):
    folder = new_folder(spark, "shards")
    shards.write_shards(skewed, folder, 3)
    back = spark.read.parquet(folder).select("document.*")
    assert back.columns == skewed.columns
    assert back.exceptAll(skewed).isEmpty() and skewed.exceptAll(back).isEmpty()


def test_shards_of_little(spark, skewed):
    assert shards.shard_table(skewed.limit(0), 8).count() == 0
    assert shards.shard_table(skewed.limit(1), 8).first().slot == 0


BIG = "x" * 300
PAGES = [
    (1, "u", BIG), (2, "u2", BIG), (1, "u", BIG), (None, "u", BIG), (None, None, BIG), (5, "a\r\nb", None),
    (6, "q", "\r\n\r\nWARC/1.1\r\nß" * 20), (6, "q", "\r\n\r\nWARC/1.1\r\nß" * 20), (7, "s", "short"), (8, "s", "short"),
    (None, None, None), (9, "ü", "é" * 50), (10, "w", "é" * 49),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [(*p, 1, "x") for p in PAGES], "page_id long, url string, html string, digest int, keeper string"
    )


def test_archives_round_trip(spark, pages):
    folder = new_folder(spark, "warc")
    warc.write_archives(pages, folder)
    captures = warc.assemble(warc.read_records(spark, folder))
    assert captures.count() == len(PAGES)
    for r in captures.collect():
        assert len(r.requests) == len(r.metadata) == 1
        assert (r.payload is not None) == (r.record_type == "response")
    found = Counter(tuple(r) for r in warc.page_ids(captures).drop("payload_digest").collect())
    expected = Counter()
    first = {}
    for page_id, url, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        keeps = len(data) < 100 or data not in first
        first.setdefault(data, page_id)
        url = url.replace("\r\n", "") if url else url
        expected[page_id, len(data), "response" if keeps else "revisit", None if keeps else first[data], url] += 1
    # Of rows without an id or with the same id, which one stores is up to the address.
    drop_url = [Counter() for _ in range(2)]
    for own, rows in zip(drop_url, (found, expected), strict=True):
        for row, n in rows.items():
            own[row[:4]] += n
    assert drop_url[0] == drop_url[1]


def test_archives_of_nothing(spark, pages):
    folder = new_folder(spark, "warc")
    warc.write_archives(pages.limit(0), folder)
    assert warc.assemble(warc.read_records(spark, folder)).count() == 0


def test_many_repeated_captures(spark, monkeypatch):
    monkeypatch.setattr(warc, "STEP", 7)
    folder = new_folder(spark, "warc")
    pages = spark.range(40).select(F.lit(3).alias("page_id"), F.lit("u").alias("url"), F.lit(BIG).alias("html"))
    warc.write_archives(pages, folder)
    rows = warc.page_ids(warc.assemble(warc.read_records(spark, folder))).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in rows) == {(3, "response", None): 1, (3, "revisit", 3): 39}


def test_plain_and_cut_archives():
    record = "WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nb: c\r\n\r\n".encode()
    assert [r["fields"] for r in warc.parse(record * 2, True)] == [[("b", "c")]] * 2
    with pytest.raises(ValueError, match="ends within a record"):
        list(warc.parse(record[:-6], True))


SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "öt", "er"], "cc": ["ción", "el", "ña", "os"]}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        lang = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(rng.randrange(5, 40)))
        rows.append((i if i % 50 else None, text, lang if i % 7 else None, lang, 0.5))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, Score double")


def test_languages_of_texts_not_learned_from(spark, spoken):
    model = langid.fit(spoken)
    assert model.languages == sorted(SYLLABLES)
    found = langid.identify(spoken, model).withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    held = [r for r in found if r.held]
    assert len(held) > 100 and sum(r.language_id.language == r.truth for r in held) > 0.98 * len(held)
    assert all(0 <= r.language_id.score <= 1 for r in found)
    assert all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_rejected_texts(spark, spoken):
    model = langid.fit(spoken)
    rows = [(None, None), (1, ""), (2, "123 !!"), (3, "ka"), (4, "kato" * 40_000), (4, "² ½")]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [r.language_id.language == "und" for r in found] == [True, True, True, False, False, True]
    assert not any(r.language_id.accepted for r in found if r.language_id.language == "und")
    with pytest.raises(ValueError, match="language_id"):
        langid.identify(spoken.withColumn("language_id", F.lit(1)), model)


def test_wrong_labels_do_not_reject_documents(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        truth = rng.choice(sorted(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[truth]) for _ in range(3)) for _ in range(rng.randrange(20, 60)))
        wrong = rng.choice([other for other in SYLLABLES if other != truth])
        rows.append((i, text, wrong if rng.random() < 0.03 else truth, truth))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert sum(r.language_id.accepted and r.language_id.language == r.truth for r in found) >= 0.95 * len(found)


def test_the_threshold_rejects_low_scores_only():
    rng = np.random.default_rng(3)
    settings = langid.Settings()
    for noise in (0, 0.005, 0.012, 0.02, 0.03, 0.1):
        for _ in range(50):
            scores = np.sort(rng.uniform(0.6, 1, 2400))
            right = rng.random(2400) >= noise
            assert (scores < langid.threshold(scores, right, settings)).sum() <= 0.01 * 2400
            right[:60] = rng.random(60) < 0.3
            assert 40 <= (scores < langid.threshold(scores, right, settings)).sum() <= 0.05 * 2400
            right[:1200] = False
            assert (scores < langid.threshold(scores, right, settings)).sum() <= 0.05 * 2400
    assert langid.threshold(np.array([]), np.array([], dtype=bool), settings) == settings.least_score


def test_nothing_to_learn_from(spark, spoken):
    model = langid.fit(spoken.limit(0))
    assert {r.language_id.language for r in langid.identify(spoken, model).collect()} == {"und"}


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(1500, 12)) * np.exp(rng.normal(size=(1500, 1)))
    vectors[100:140] = vectors[7]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string")
    found = topk.search(table, k=5, every=50, block_rows=100, query_rows=7).drop("query_row").collect()
    whole = np.floor(1024 * vectors).astype(np.int64)
    expected = []
    for i in range(0, 1500, 50):
        scores = whole @ whole[i]
        best = [j for j in np.lexsort((np.arange(1500), -scores)).tolist() if j != i][:5]
        expected += [(i, rank + 1, j, int(scores[j])) for rank, j in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_search_leaves_unusable_vectors_out(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [-1.0]), (3, [0.5, nan]), (4, None), (5, [0.1, None])]
    rows += [(None, [3.0, 1.0]), (7, [1.0, 2.0]), (8, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [tuple(r) for r in topk.search(table, k=3).orderBy("query_row", "rank").drop("query_row").collect()]
    top = 1024 * 1024 * 5
    same = [(0, 1, 0, top), (0, 2, 7, top), (0, 3, None, top)]
    assert found == same + same + [(100, 1, 8, 0), (100, 2, 0, -1024 * 1024), (100, 3, 0, -1024 * 1024)]
    assert topk.search(table.limit(0)).count() == 0


def test_vectors_without_components_score_zero(spark):
    table = spark.createDataFrame([(i, []) for i in (100, 3, 2, 7)], "vec_id long, embedding array<double>")
    found = topk.search(table, k=2).drop("query_row").collect()
    assert sorted(map(tuple, found)) == [(100, 1, 2, 0), (100, 2, 3, 0)]


@pytest.mark.parametrize("size", [3e5, 1e9, 1e13, 1e302])
def test_scores_of_large_components_are_exact(spark, size):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 8)) * np.exp(rng.normal(size=(60, 1))) * size
    vectors[20:30] = vectors[3]
    vectors[40:44] *= 1 / size
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = topk.search(table, k=20, every=10, block_rows=16, query_rows=4).drop("query_row").collect()
    whole = [[int(x) for x in np.floor(1024 * v).tolist()] for v in vectors]
    end, expected = 2**63 - 1, []
    for i in range(0, 60, 10):
        scores = [max(-end, min(end, sum(a * b for a, b in zip(whole[i], w, strict=True)))) for w in whole]
        best = sorted((j for j in range(60) if j != i), key=lambda j: (-scores[j], j))[:20]
        expected += [(i, rank + 1, j, scores[j]) for rank, j in enumerate(best)]
    assert sorted(map(tuple, found)) == expected


def test_short_vectors_meet_no_query(spark):
    """Blocks too short for what the longest block gives are left out before any task reads their vectors."""
    queries = np.array([[3.0, 4.0], [1.0, 0.0]])
    best = topk._Best(queries, np.array([0, 1]), 2, np.eye(2))
    assert best.need() == 0
    best.take(np.array([[6.0, 8.0], [3.0, 4.0], [9.0, 0.0]]), np.array([5, 6, 7]), np.array([5, 6, 7]))
    assert best.scores.tolist() == [[50, 27], [9, 6]]
    assert best.need() == pytest.approx(27 / 5)
    known = topk._Best(queries, np.array([0, 1]), 2, np.eye(2), best.scores[:, -1])
    assert known.need() == best.need() and not len(known._may_enter(np.array([[0.5, 0.5]])))
