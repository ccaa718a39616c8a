"""Near copies and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from obsmill.llm import anchors, induced, minhash, simhash, suffix_dedup
from obsmill.llm.components import components
from obsmill.llm.frames import stored


def signed(values):
    return [int(np.uint64(v).view(np.int64)) for v in values]


def grouped(pairs):
    sets = defaultdict(set)
    for node, root in pairs:
        sets[root].add(node)
    return sorted(map(sorted, sets.values()))


def linked_by(size, near):
    root = list(range(size))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(size):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(size)]


def plain_fingerprint(text, size=4):
    lowered = (text or "").encode().translate(simhash.LOWER)
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    runs = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    votes = [0] * 64
    for run in runs:
        h = xxhash.xxh64_intdigest(run, 42)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(runs))


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    for base in texts[:8]:
        for _ in range(4):
            own = base.split()
            own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    return texts + [texts[0]] * 5 + [None, "", " \t ", "One", "one", "x" * 50_000]


def test_fingerprints():
    for text in corpus():
        assert simhash.fingerprint(text, 4) == plain_fingerprint(text)


def test_simhash_groups(spark):
    texts = corpus()
    rows = [(None if i % 11 == 5 else i // 2, t, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, ROW int").coalesce(1).drop("ROW")
    found = simhash.groups(docs, 4, 4).orderBy("row").collect()
    prints = [plain_fingerprint(t) for t in texts]
    roots = linked_by(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = defaultdict(list)
    for i, root in enumerate(roots):
        least[root].append((rows[i][0] is None, rows[i][0] or 0, i))
    for i, row in enumerate(found):
        nameless, doc_id, first = min(least[roots[i]])
        assert row.component_id == (None if nameless else doc_id)
        assert row.keep == (first == i)
    assert simhash.groups(docs.limit(0)).count() == 0


def clustered(seed, centres=4, each=250, flips=6):
    rng = np.random.default_rng(seed)
    out = set(rng.integers(0, 1 << 63, 200, dtype=np.uint64).tolist())
    for centre in rng.integers(0, 1 << 63, centres, dtype=np.uint64):
        own = np.full(each, centre)
        for _ in range(flips):
            own = own ^ (np.uint64(1) << rng.integers(0, 64, each, dtype=np.uint64))
        out |= set(own.tolist())
    return sorted(out)


@pytest.mark.parametrize("bucket_rows", [100_000, 20])
def test_links_join_all_within_the_distance(spark, bucket_rows):
    prints = clustered(5)
    table = spark.createDataFrame([(p,) for p in signed(prints)], "fp long")
    stars = {r.node: r.to for r in components(simhash.links(table, 4, bucket_rows)).collect()}
    found = grouped((p, stars.get(p, p)) for p in signed(prints))
    roots = linked_by(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert found == grouped(zip(signed(prints), signed(prints[r] for r in roots), strict=True))


def test_the_index_within_one_bucket():
    prints = np.array(clustered(6, each=500), dtype=np.uint64)
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    prints = prints[np.argsort(rank)]
    roots = linked_by(len(prints), lambda i, j: (int(prints[i]) ^ int(prints[j])).bit_count() <= 4)
    assert simhash.linked(np.array([0]), prints, 4).tolist() == roots


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    stars = {r.node: r.to for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({n for p in pairs for n in p})
    at = {n: i for i, n in enumerate(nodes)}
    near = {(at[a], at[b]) for a, b in pairs} | {(at[b], at[a]) for a, b in pairs}
    roots = linked_by(len(nodes), lambda i, j: (i, j) in near)
    assert [stars.get(n, n) for n in nodes] == [nodes[r] for r in roots]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most_letters", [0, 2, 4096])
def test_suffix_order_and_common_prefixes(monkeypatch, most_letters):
    monkeypatch.setattr(induced, "MOST_LETTERS", most_letters)
    rng = random.Random(most_letters)
    for _ in range(250):
        letters = [rng.randrange(1, 1 + rng.choice([1, 2, 3, 10])) for _ in range(rng.randrange(1, 60))]
        letters += letters[: rng.randrange(len(letters))] * rng.randrange(3) + [0]
        depth = rng.choice([3, 8, 400])
        order = induced.suffixes(np.array(letters, dtype=np.uint16), depth, memory=rng.choice([10, 1 << 20]))
        places = order.places.tolist()
        assert sorted(places) == list(range(len(letters)))
        for a, b, common in zip(places, places[1:], order.common.tolist()[1:], strict=False):
            assert letters[a : a + depth] <= letters[b : b + depth]
            same = 0
            while same < depth and max(a, b) + same < len(letters) and letters[a + same] == letters[b + same]:
                same += 1
            assert same == common


def test_a_queue_spills_and_reads_back():
    queue = induced.SuffixQueue(memory=100)
    runs = [(i % 3, np.arange(i, i + 20, dtype=np.int32)) for i in range(30)]
    for letter, places in runs:
        queue.push(letter, induced.Run(places, places.astype(np.uint16)))
    assert queue.file is not None
    for letter in range(3):
        expected = np.concatenate([p for own, p in runs if own == letter])
        found = queue.pop(letter)
        assert np.array_equal(found.places, expected) and np.array_equal(found.common, expected)
    queue.close()


def test_equal_windows_have_equal_keys(monkeypatch):
    monkeypatch.setattr(anchors, "CHUNK", 700)
    rng = random.Random(4)
    passage = bytes(rng.randrange(97, 101) for _ in range(900))
    keys = defaultdict(set)
    for _ in range(6):
        text = bytes(rng.randrange(97, 101) for _ in range(rng.randrange(500))) + passage[rng.randrange(300) :]
        own = anchors.pieces(np.frombuffer(text + b"a" * rng.randrange(800), dtype=np.uint8), 400, 128)
        text += b"a" * 800
        for key, start, end in zip(own.keys.tolist(), own.starts.tolist(), own.ends.tolist(), strict=True):
            for at in range(start, end):
                keys[text[at : at + 400]].add(key)
    assert all(len(k) == 1 for k in keys.values())


def plain_removal(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for text in texts:
        gone = np.zeros(len(text), dtype=bool)
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 40))) for _ in range(60)]

    def prose(count):
        return "".join(rng.choice(words) for _ in range(count))

    shared = [prose(40) for _ in range(8)]
    texts = [None, "", "a" * 3000, "a" * 450, "ab" * 700, "xyz" * 500, "q" * 400, "q" * 399]
    for _ in range(25):
        parts = [prose(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            passage = rng.choice(shared)
            cut = rng.randrange(len(passage))
            parts += [passage[cut : cut + rng.randrange(2000)], prose(rng.randrange(30))]
        texts.append("".join(parts))
    return texts + [prose(6000)] + [texts[-1], texts[-1]]


def test_repeated_passages_go(spark):
    texts = passages()
    rows = [(i // 2 if i % 5 else None, t, i, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, row_number int").coalesce(1)
    left = suffix_dedup.without_repeats(docs, 400)
    assert left.columns == [*docs.columns, "left"]
    counts = ("n_bytes", "n_removed", "n_spans")
    assert all(r.left.n_passage_bytes == r.left.n_removed and (r.left.rest is None) == (r.text is None) for r in left.collect())
    found = left.select("spans", *(f"left.{c}" for c in counts), F.sha2("left.kept", 256)).collect()
    expected = plain_removal([(t or "").encode() for t in texts], 400)
    assert [tuple(r[1:]) for r in sorted(found)] == expected
    assert suffix_dedup.without_repeats(docs.limit(0), 400).count() == 0


def test_whole_characters_stay(spark):
    passage = "é" * 350
    docs = spark.createDataFrame([(1, "x" + passage), (2, "ü" + passage + "b")], "doc_id long, text string")
    rows = suffix_dedup.without_repeats(docs, 401).collect()
    for row in rows:
        assert row.left.rest == row.text.replace("é", "")


def plain_rest(texts, length, words):
    """What is left without strings of so many bytes, or words, that start again; a character goes if all its bytes do."""
    split = [[m.span() for m in re.finditer(r"\S+", t)] for t in texts]
    runs = [[tuple(t[a:b] for a, b in s[i : i + words]) for i in range(len(s) - words + 1)] for t, s in zip(texts, split, strict=True)]
    by_words = Counter(r for own in runs for r in own)
    data = [t.encode() for t in texts]
    by_bytes = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for text, raw, places, own in zip(texts, data, split, runs, strict=True):
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            if by_bytes[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).astype(int)
        goes = np.zeros(len(places) + 1, dtype=bool)
        for i, run in enumerate(own):
            goes[i : i + words] |= by_words[run] > 1
        for i, (a, b) in enumerate(places):
            if goes[i]:  # and the white space up to a next word that goes
                gone[at[a] : at[places[i + 1][0] if goes[i + 1] else b]] = True
        out.append("".join(c for c, a, b in zip(text, at, at[1:], strict=False) if not gone[a:b].all()))
    return out


@pytest.mark.parametrize("shard_bytes", [2 << 20, 3_000, 1])
def test_crowded_keys_are_parted(spark, shard_bytes):
    """One passage of exactly a window, and one that is longer, in very many surroundings."""
    rng = random.Random(11)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, longer = prose(120), prose(170)
    texts = [prose(rng.randrange(60)) + (short if i % 2 else longer[i % 7 :]) + prose(rng.randrange(60)) for i in range(300)]
    texts += [prose(300), "é" * 400, "ab" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").coalesce(2)
    alphabet = suffix_dedup.BYTES._replace(gram=40)
    found = {r.row: r.spans for r in suffix_dedup.repeated(docs, 120, shard_bytes=shard_bytes, memory=1000, alphabet=alphabet).collect()}
    expected = plain_removal([t.encode() for t in texts], 120)
    for i, (_, removed, spans, _) in enumerate(expected):
        runs = suffix_dedup.covered(found.get(i, []), 120)
        assert (sum(b - a for a, b in runs), len(runs)) == (removed, spans)


def test_a_shard_beyond_the_queues_memory(monkeypatch):
    """The queues of one shard of production size go to disk, and the answer is that of brute force."""
    spills = []
    plain = induced.SuffixQueue._spill
    monkeypatch.setattr(induced.SuffixQueue, "_spill", lambda self: (spills.append(self.held), plain(self))[1])
    rng = np.random.default_rng(3)
    own = [rng.integers(97, 123, 3000).astype(np.uint8).tobytes() for _ in range(600)]
    own += [own[i][500:1500] + own[-i][:300] for i in range(1, 100)]
    owner, firsts, lasts = suffix_dedup.repeated_windows(own, np.ones(len(own), dtype=int), 400, 1 << 18)
    gone = [np.zeros(len(t), dtype=bool) for t in own]
    for i, a, b in zip(owner.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
        gone[i][a : b + 399] = True
    assert len(spills) > 3 and max(spills) > 1 << 18
    assert [int(g.sum()) for g in gone] == [removed for _, removed, _, _ in plain_removal(own, 400)]


def test_passages_of_over_50_words_go(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 6)))
    own = lambda: " ".join(word() + str(rng.randrange(10**9)) for _ in range(rng.randrange(20, 90)))
    rows, expected = [], {}
    for count in (50, *range(51, 66)):
        passage = [word() for _ in range(count)]
        for gap in (" ", "\u2003\n"):
            before, after = own(), own()
            rows.append((len(rows), f"{before} {gap.join(passage)} {after}"))
            expected[len(rows) - 1] = f"{before}  {after}" if count > 50 else rows[-1][1]
    rows.append((len(rows), "日" * 500 + own()))
    rows.append((len(rows), own() + " " + "日" * 500))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.left.rest for r in suffix_dedup.without_repeats(docs, 400, words=51).collect()}
    assert {i: found[i] for i in expected} == expected
    assert not any("日" in t for t in found.values())
    stage = {r.doc_id: r.text for r in corpus_pipeline.without_passages(spark, docs, "").collect()}
    assert stage == found


def test_likeness_and_edited_texts(spark):
    texts = corpus(9)
    rows = [(3 * i, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range string, guest int")
    found = minhash.compare_with_next(docs).orderBy("doc_id").collect()
    assert len(found) == len(texts)
    for i, row in enumerate(found):
        text, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, other, beside = (minhash.signature(minhash.shingles(t)) for t in (text, edited, after))
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == own.tobytes().hex() and row.edited_fingerprint == other.tobytes().hex()
        assert row.near_edited == minhash.likeness(own, other) and row.near_next == minhash.likeness(own, beside)
    assert minhash.compare_with_next(docs.limit(0)).count() == 0
    alone = minhash.compare_with_next(docs.limit(1)).first()
    assert alone.near_next == 1.0


def test_ties_and_null_ids_keep_every_row(spark):
    rows = [(None, "a b c"), (None, None), (5, "x"), (5, "x"), (5, "y z")]
    found = minhash.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in found) == [(-1, 0), (-1, 5), (5, 1), (5, 1), (5, 3)]


def test_likeness_estimates_jaccard():
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1200)]
    a, b = " ".join(words[:1000]), " ".join(words[200:])
    sets = [set(minhash.shingles(t).tolist()) for t in (a, b)]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(minhash.likeness(*(minhash.signature(minhash.shingles(t)) for t in (a, b))) - exact) < 0.2


@pytest.mark.parametrize("bucket_rows", [2000, 2])
def test_near_copies_by_bands(spark, bucket_rows):
    texts = corpus(7)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, node int")
    found = minhash.similar(docs, bucket_rows=bucket_rows).orderBy("doc_id").collect()
    sets = [set(minhash.shingles(t or "").tolist()) for t in texts]

    def near(i, j):
        either = len(sets[i] | sets[j])
        return not either or len(sets[i] & sets[j]) / either >= 0.8

    assert [r.class_id for r in found] == linked_by(len(texts), near)
    assert minhash.similar(docs.limit(0)).count() == 0


def test_windows_of_words_equal_brute_force():
    """Segments of words, some of which occur once, against all windows of them."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        common = rng.integers(0, 1 << 63, rng.integers(1, 6), dtype=np.uint64)
        own = []
        for _ in range(rng.integers(1, 8)):
            words = rng.choice(common, rng.integers(3, 25))
            words[rng.random(len(words)) < 0.15] = rng.integers(0, 1 << 63, dtype=np.uint64)
            own.append(words.tobytes())
        times = rng.integers(1, 3, len(own))
        owner, firsts, lasts = suffix_dedup.repeated_windows(own, times, 3, 1 << 20, 8)
        found = [set() for _ in own]
        for i, a, b in zip(owner.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
            found[i] |= set(range(a, b))
        windows = [[s[8 * i : 8 * i + 24] for i in range(len(s) // 8 - 2)] for s in own]
        counts = Counter(w for ws, n in zip(windows, times.tolist(), strict=True) for w in ws for _ in range(n))
        assert found == [{i for i, w in enumerate(ws) if counts[w] > 1} for ws in windows]


@pytest.mark.parametrize("words", [False, True])
def test_pieces_of_many_texts_in_one_pass(words):
    """Texts that share a pass have the pieces that they have alone, with those of a long one among them."""
    rng, base = random.Random(8), np.uint64(0x9E3779B9)
    texts = [bytes(rng.randrange(97, 99) for _ in range(n)) for n in (0, 399, 400, 3000, 150_000, 401, 900, 5, 1200)]
    texts += [texts[3], texts[6] * 2, b""]
    rows = [np.frombuffer(t, dtype=np.uint8).astype(np.uint64) * base if words else np.frombuffer(t, dtype=np.uint8) for t in texts]
    ends = np.cumsum([len(t) for t in texts])
    found = anchors.together(np.concatenate(rows), ends, 400, 128)
    alone = [anchors.pieces(r, 400, 128) for r in rows]
    begins = [0, *ends.tolist()]
    assert found.keys.tolist() == [k for own in alone for k in own.keys.tolist()]
    assert found.starts.tolist() == [b + x for b, own in zip(begins, alone, strict=False) for x in own.starts.tolist()]
    assert found.ends.tolist() == [b + x for b, own in zip(begins, alone, strict=False) for x in own.ends.tolist()]
    assert found.repeats.tolist() == [x for own in alone for x in own.repeats.tolist()]


def test_pieces_that_all_occur_again_are_not_sorted(spark, monkeypatch):
    def refuse(*_):
        def run(batches):
            for batch in batches:
                assert not batch.num_rows, "letters were dealt whose windows are known to occur again"
                yield from ()

        return run

    texts = passages(5) * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = stored(docs, "copies")
    monkeypatch.setattr(suffix_dedup, "_sorted_shards", refuse)
    rows = suffix_dedup.without_repeats(docs, 400, words=51).orderBy("doc_id").collect()
    expected = plain_removal([(t or "").encode() for t in texts], 400)
    assert [(r.left.n_bytes, r.left.n_removed, r.left.n_spans, hashlib.sha256(r.left.kept).hexdigest()) for r in rows] == expected
