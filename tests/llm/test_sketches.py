"""Fast similarity sketches and the near copies found by them, against brute force."""

import random
import re

import numpy as np
import pytest

from obsmill.llm import sketch_dedup
from tests.llm.test_copies import linked_by


def plain_set(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(sketch_dedup.LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def near(a, b, share=85):
    return bool(a) and bool(b) and 100 * len(a & b) >= share * len(a | b)


def edited(rng, words, base, count):
    own = list(base)
    for _ in range(count):
        own[rng.randrange(len(own))] = rng.choice(words)
    return " ".join(own)


def corpus(seed=1):
    """Chains and stars of near copies around the threshold, equal sets, texts of few words and of none."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 300))]
        texts += [edited(rng, words, base, rng.randrange(1 + len(base) // 30)) for _ in range(10)]
        chain = list(base)
        for _ in range(8):  # neighbours are near, the ends are not
            chain[rng.randrange(len(chain))] = rng.choice(words)
            texts.append(" ".join(chain))
    texts += [texts[0], texts[0].upper(), texts[0].replace(" ", "\t\n"), None, "", " \x0b ", None, "one", "One", "one two", "ONE  two"]
    texts += ["one two", "one two", "a b c " * 3000, "a b c " * 20_000, "x" * 100_000, "É b c", "é b c"]
    return texts


def test_sets_are_those_of_words():
    for text in corpus():
        assert len(sketch_dedup.shingles(text, 3)) == len(plain_set(text))


def test_every_coordinate_is_filled_and_estimates_the_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for size in (1, 2, 5, 40, 500, 5000):
        pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        for common in {0, size // 2, size * 9 // 10, size}:
            a, b = np.unique(pool[:size]), np.unique(pool[size - common : 2 * size - common])
            found = sketch_dedup.sketches([a, b])
            assert found.all()
            exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((found[0] == found[1]).mean() - exact)
            assert abs(errors[-1]) < 0.2
    assert abs(np.mean(errors)) < 0.03
    together = sketch_dedup.sketches([np.array([7], dtype=np.uint64), pool, np.array([3, 9], dtype=np.uint64)])
    assert np.array_equal(together[1], sketch_dedup.sketches([pool])[0])


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_groups_equal_brute_force(spark, chunk):
    texts = corpus()
    rows = [(None if i % 17 == 3 else i // 2, t, "x", i, True) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, band string, node int, kept boolean").coalesce(3)
    found = sketch_dedup.groups(docs, chunk=chunk)
    assert found.columns == ["doc_id", "row", "n_shingles", "component_id", "kept"]
    sets = [plain_set(t) for t in texts]
    roots = linked_by(len(texts), lambda i, j: near(sets[i], sets[j]))
    least = {}
    for i, root in enumerate(roots):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == root and rows[j][0] is not None]
        least[i] = min(ids, default=None)
    expected = sorted(
        (str(r[0]), len(s), str(least[i]), r[0] == least[i]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))
    )
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found.collect()) == expected
    assert len(set(roots)) > 30 and len(set(roots)) < len(texts) - 100


def test_a_bucket_of_several_components_is_searched_through(spark):
    """Copies of one base that are too far from each other, so that the base alone joins them."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = words[:400]
    texts = []
    for i in range(120):
        own = list(base)
        for j in rng.sample(range(400), 9):
            own[j] = f"x{i}-{j}"
        texts.append(" ".join(own))
    texts.insert(77, " ".join(base))
    sets = [plain_set(t) for t in texts]
    roots = linked_by(len(texts), lambda i, j: near(sets[i], sets[j]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (1 << 20, 8_000):
        found = sketch_dedup.groups(docs, chunk=chunk).orderBy("doc_id").collect()
        assert [r.component_id for r in found] == roots


def test_nothing_and_one(spark):
    docs = spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")
    assert [tuple(r)[0::2] for r in sketch_dedup.groups(docs).collect()] == [(4, 2, True)]
    assert sketch_dedup.groups(docs.limit(0)).count() == 0
