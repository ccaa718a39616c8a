"""Lexical search against scores worked out text by text."""

import math
import random
import re
from collections import Counter

import pytest

from obsmill.llm import lexical

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return LETTERS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    counted = [(row, doc_id, Counter(terms(text))) for row, (doc_id, text) in enumerate(docs)]
    documents, total = sum(bool(c) for _, _, c in counted), sum(sum(c.values()) for _, _, c in counted)
    holding = Counter(t for _, _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for row, doc_id, own in counted:
            score = 0
            for term in terms(text):
                if own[term]:
                    measure = 25 + 75 * sum(own.values()) * documents // total
                    weight = math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[term] + 1)))
                    score += weight * (10**9 * own[term] // (1000 * own[term] + 8 * measure))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, row, doc_id))
        out += [(item, i + 1, s[4], -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    words = ["a", "ab", "abc", "b", "bc", "The", "the", "é", "É", "日本", "x1", "2", "naïve", "w v", "q\u0085r", " "]
    words += [f"t{i}" for i in range(60)]
    gaps = [" ", "  ", "-", "\n", "_", ".\t", "\x00", "\x7f", "'"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n))
    docs = [(i // 2 if i % 9 else None, text(rng.randrange(1, 80))) for i in range(300)]
    docs += [docs[5]] * 15 + [(7, None), (8, ""), (9, " -- "), (10, "the " * 30_000), (None, "t1")]
    items = [(i, text(rng.randrange(1, 30))) for i in range(25)] + [(3, "the the THE"), (None, "t1 t2"), (40, None), (41, "--"), (42, "unseen")]
    return docs, items


@pytest.mark.parametrize("blocks", [{}, {"most_items": 4}, {"most_terms": 20}])
def test_ranks_equal_brute_force(spark, blocks):
    docs, items = corpus()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, term string").coalesce(3)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, rank int").coalesce(1)
    found = lexical.search(table, asked, k=10, **blocks)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_search(docs, items, 10)


def test_very_large_scores_stay_exact(monkeypatch, spark):
    monkeypatch.setattr(lexical, "EXACT", 1)
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    found = lexical.search(table, spark.createDataFrame(items, "item_id long, text string"), k=3)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_search(docs, items, 3)


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items.select("item_id", items.text.substr(1, 0).alias("text"))).count() == 0
