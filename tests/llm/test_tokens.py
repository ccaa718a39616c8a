"""Token files, packing and word BPE against the tokenizers library."""

import hashlib
import random
import subprocess
import sys
import weakref
import zlib
from collections import defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from obsmill.llm import byte_tokens, cutting, packing, token_files, word_bpe
from obsmill.llm.byte_tokens import PieceEncoder
from obsmill.sources.workspace import new_folder, stored

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = [" ", "  ", "\n", "\t", "a", "é", "don't", "'s", "'T", "x'll", "1", "23", "²", "Ⅷ", ".", ",", "日", "́"]
ALPHABET += ["\xa0", "\x1c", "\x85", "<|endoftext|>", "<|", "👍", "_", "-", "ª", "The", "\r\n", "ſ", "İ", "Σ"]


def fuzzed(seed, count=120):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 30))) for _ in range(count)] + [None, "", "a" * 400]


@pytest.fixture(scope="module")
def docs(spark):
    texts = fuzzed(1, 40) + ["same text here"] * 30 + ["word " * 3000]
    rows = [(i if i % 9 else None, t, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, part int, n_tokens string").coalesce(2)


def library_ids(text, path=BYTES):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_the_library():
    encoder, library = PieceEncoder(BYTES, most_pieces=50), Tokenizer.from_file(BYTES)
    for seed in range(5):
        texts = fuzzed(seed)
        found = [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(texts)]
        assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_give_the_ids_of_the_library():
    encoder, library = word_bpe.WordEncoder(WORDS, most=50), Tokenizer.from_file(WORDS)
    for seed in range(5):
        texts = fuzzed(seed)
        for text, raw, decoded in zip(texts, *encoder.encode(texts), strict=True):
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(raw, dtype="<i4").tolist() == ids
            assert decoded.decode() == library.decode(ids, skip_special_tokens=False)


def test_long_words_are_not_remembered():
    encoder, library = word_bpe.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(7)
    letters = "".join(rng.choice("acgt") for _ in range(200_000))
    texts = ["a" * 200_000, "short words " + letters, letters[:500] + "!" + letters[500:900]]
    for _ in range(2):
        for text, raw, decoded in zip(texts, *encoder.encode(texts), strict=True):
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(raw, dtype="<i4").tolist() == ids
            assert decoded.decode() == library.decode(ids, skip_special_tokens=False)
        for known in (encoder.merges._links, encoder.merges._ending, encoder.pieces.young, encoder.words.young):
            assert max(map(len, known)) <= max(word_bpe.LONG, encoder.merges.longest + 1)


def test_known_words_are_held_in_arrow_and_bounded():
    """What is remembered costs a few dozen bytes a piece or word, not the objects of two generations."""
    encoder, library, rng = word_bpe.WordEncoder(WORDS, most=20_000), Tokenizer.from_file(WORDS), random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 12))) for _ in range(30_000)]
    texts = [" ".join(words[i : i + 100]) + ",\n" + "z" * 5000 * (i % 3) + "<|endoftext|>" for i in range(0, len(words), 100)]
    for part in (texts, texts[:150], texts[150:]):
        for text, raw, decoded in zip(part, *encoder.encode(part), strict=True):
            ids = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(raw, dtype="<i4").tolist() == ids
            assert decoded.decode() == library.decode(ids, skip_special_tokens=False)
        for known in (encoder.pieces.rows, encoder.words.rows):
            assert len(known.pieces) == len(known.ids) == len(known.used) <= 20_000
            assert known.pieces.nbytes + known.ids.nbytes + known.used.nbytes < 80 * 20_000
    # What was used last is what stays.
    assert set(words[15_001:15_010]) <= set(encoder.pieces.young)


def test_sorted_words_share_their_beginnings():
    merges, library = word_bpe.WordEncoder(WORDS).merges, Tokenizer.from_file(WORDS)
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("aehr") for _ in range(rng.randrange(1, 9))) for _ in range(3000)} | {"a", "aa", "aaa", "there", "thereby"})
    found = list(word_bpe.encodings(words, merges))
    assert found == [library.encode(w, add_special_tokens=False).tokens for w in words]
    assert list(word_bpe.encodings(["", "a"], merges)) == [[], ["a</w>"]] and list(word_bpe.encodings([], merges)) == []


def test_words_of_empty_texts_and_of_slices():
    encoder = word_bpe.WordEncoder(WORDS)
    assert encoder.encode([]) == ([], [])
    assert encoder.encode([None, "", " ", "\n"]) == ([b""] * 4, [b""] * 4)
    texts = pa.array(["no", "a text", None, "", "a text", " x"])
    whole = encoder.encode(texts)
    assert encoder.encode(texts.slice(1, 4)) == tuple(part[1:5] for part in whole)
    assert whole[1] == [b"no</w>", b"a</w> text</w>", b"", b"", b"a</w> text</w>", b"x</w>"]


def test_words_take_little_memory():
    """What a worker still holds after many distinct words is some dozen bytes for each, not an object."""
    code = """
import os, random
import public_tokenizers
from obsmill.llm import word_bpe
from obsmill.llm.frames import give_back

def held():
    give_back()
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

rng = random.Random(5)
letters = str.maketrans("0123456789", "etaoinshrd")
texts = [" ".join(f"{rng.randrange(40_000)}".translate(letters) + rng.choice(("", "!", ".", ",", ";", ":")) for _ in range(100)) for _ in range(8_000)]
encoder = word_bpe.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
encoder.encode(texts[:10])
before = held()
for i in range(0, len(texts), 2_000):
    encoder.encode(texts[i : i + 2_000])
print(held() - before)
"""
    answer = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True, timeout=120)
    assert int(answer.stdout) < 50


def test_words_give_memory_back_after_each_slice(monkeypatch):
    given = []
    monkeypatch.setattr(word_bpe, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["a text"] * 3000)], names=["doc_id", "text"])
    parts = list(word_bpe._encode(WORDS)(iter([batch])))
    assert len(given) == len(parts) == 2 and sum(p.num_rows for p in parts) == 3000


def test_tokens_side_by_side():
    """What the edges of two tokens tell is what merging their letters gives."""
    merges, rng = word_bpe.WordEncoder(WORDS).merges, random.Random(12)
    usable = sorted(merges.usable)
    within = [t for t in usable if not t.endswith(merges.end)]
    short = [t for t in within if len(t) < 4]
    pairs = [(rng.choice(within), rng.choice(usable)) for _ in range(30_000)] + [(rng.choice(short), rng.choice(usable)) for _ in range(30_000)]
    pairs += [(t[:i], t[i:]) for t in rng.sample(usable, 6_000) for i in range(1, len(t)) if t[:i] in merges.usable and t[i:] in merges.usable]
    pairs += [(a, b) for a in ("a", "aa", "aaa", "aaaa", "ha", "haha") for b in ("a", "aa", "aaa</w>", "aaaa", "ha</w>", "haha") if a in merges.usable and b in merges.usable]
    found = [merges.beside(*p) for p in pairs]
    assert found == [merges._merged([*merges._symbols(a), *merges._symbols(b)]) == [a, b] for a, b in pairs]
    assert 1000 < sum(found) < len(found) - 1000


def test_word_digests(spark, docs):
    library = Tokenizer.from_file(WORDS)
    expected = []
    for row in docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        digests = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        expected.append((row.doc_id, len(ids), *(hashlib.sha256(d.encode()).hexdigest() for d in digests)))
    found = [tuple(r) for r in word_bpe.digests(word_bpe.encode(docs, WORDS)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert word_bpe.encode(docs.limit(0), WORDS).count() == 0


def test_token_files_round_trip(spark, docs):
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(docs, folder, BYTES, 2)
    rows = token_files.read_tokens(spark, folder)
    expected = sorted((r.doc_id is not None, r.doc_id or 0, [*library_ids(r.text), 2]) for r in docs.collect())
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in rows.collect())
    assert found == expected
    starts = {(r.start, r.n_tokens) for r in token_files.with_start(rows, rows).collect()}
    ends = sorted(a + n for a, n in starts)
    assert sorted(a for a, _ in starts) == [0, *ends[:-1]] and ends[-1] == sum(len(e[2]) for e in expected)
    sums = {r.doc_id: r.ids_crc32 for r in token_files.with_checksum(rows.where("doc_id is not null")).collect()}
    for _, doc_id, ids in (e for e in expected if e[0]):
        assert sums[doc_id] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    few = token_files.read_tokens(spark, folder, first=5, last=8).select("n_tokens")
    assert few.count() == 4 and "ids" not in few._jdf.queryExecution().executedPlan().toString()


def test_token_files_of_an_empty_table(spark, docs):
    folder = new_folder(spark, "tokens")
    token_files.write_tokens(docs.limit(0), folder, BYTES, 2)
    rows = token_files.read_tokens(spark, folder)
    assert token_files.with_start(rows, rows).count() == 0


def test_ids_are_dictionary_encoded_with_page_indexes(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    token_files.write_tokens(docs, str(tmp_path / "files"), BYTES, 2)
    meta = pq.ParquetFile(next((tmp_path / "files").glob("part-*.parquet"))).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    ids = next(c for name, c in columns.items() if name.startswith("ids"))
    assert "RLE_DICTIONARY" in ids.encodings and ids.has_offset_index


def check_pieces(rows, documents, capacity, multiset=True):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        by_sequence[r.sequence_id].append((r.offset, r.length))
    used = padded = 0
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
        used += end
        padded += 0 if end & (end - 1) == 0 else capacity - end
    assert used == sum(map(len, documents))
    return padded / max(1, used)


def test_packing_keeps_every_id_once(spark, docs):
    named = docs.withColumn("doc_id", F.col("part").cast("long"))
    documents = {r.doc_id: [*library_ids(r.text), 0] for r in named.collect()}
    rows = packing.pack(named, BYTES, 0, capacity=64).collect()
    assert check_pieces(rows, list(documents.values()), 64) < 0.05
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == documents.keys()
    for doc_id, own in pieces.items():
        own.sort(key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == documents[doc_id]
        assert all(r.doc_tokens == len(documents[doc_id]) for r in own)


def test_packing_with_null_and_repeated_ids(spark, docs):
    rows = packing.pack(docs, BYTES, 0, capacity=64).collect()
    check_pieces(rows, [[*library_ids(r.text), 0] for r in docs.collect()], 64)
    assert packing.pack(docs.limit(0), BYTES, 0).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "one length", "third", "empty"])
def test_patterns_never_use_more_pieces_than_there_are(kind):
    rng = np.random.default_rng(0)
    counts = rng.integers(20, 60, 128)
    if kind == "one length":
        counts = np.where(np.arange(128) == 77, 1000, 0)
    if kind == "third":
        counts[70] = counts.sum() // 2
    if kind == "empty":
        counts = np.zeros(128, dtype=np.int64)
    counts[0] = 0
    plan = cutting.plan(counts, 128)
    used, totals = np.zeros(128, dtype=np.int64), defaultdict(int)
    for pattern, length, copies, offset in plan.rows.tolist():
        assert offset == totals[pattern]
        totals[pattern] += length * copies
        used[length] += copies * plan.uses[pattern]
    assert (used <= counts).all() and all(t <= 128 for t in totals.values())
    if kind == "uniform":
        assert used @ np.arange(128) > 0.5 * (counts @ np.arange(128))


def test_the_program_improves_on_its_first_patterns():
    counts = np.zeros(101, dtype=np.int64)
    counts[[22, 42, 53]] = (95, 61, 47)
    program = cutting._Program(counts, 100)
    first = program.cost()
    for _ in range(30):
        value, last = cutting._fillings(program.prices(), program.lengths, 100)
        for total in range(1, 101):
            if value[total] - cutting.cost_of(total, 100) > 1e-6:
                program.enter(cutting._pieces(last, total))
                break
    assert program.cost() <= first
    made = sum(np.array([p.get(int(a), 0) for a in program.lengths]) * u for p, u in zip(program.basis, program.uses, strict=True))
    assert np.allclose(made, counts[program.lengths])


def test_ids_of_a_slice_are_let_go_before_the_next(monkeypatch):
    held, alive = [], []

    class Own(bytearray):
        pass

    class Ids(bytes):
        def __add__(self, end):
            own = Own(bytes(self) + end)
            held.append(weakref.ref(own))
            return own

    class Encoder:
        tokenizer = SimpleNamespace(get_vocab_size=lambda: 50_000)

        def encode(self, texts):
            alive.append(sum(r() is not None for r in held))
            return [Ids(4 * len(t.as_py())) for t in texts]

    monkeypatch.setattr(packing, "encoder", lambda path: Encoder())
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(packing, "LONG_SLICE", (2, 1 << 20))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * n for n in range(6)])], names=["doc_id", "text"])
    counts = []
    for out in packing._encode("", 0, 4)(iter([batch])):
        counts += out.column("doc_tokens").to_pylist()
        del out
    assert counts == [1, 2, 3, 4, 5, 6] and alive == [0, 0, 0]


def test_known_pieces_are_held_in_arrow_and_bounded():
    """A piece costs a few dozen bytes, not the objects of two generations; long ones go."""
    encoder, library, rng = PieceEncoder(BYTES, most_pieces=20_000), Tokenizer.from_file(BYTES), random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(4, 12))) for _ in range(30_000)]
    texts = [" ".join(words[i : i + 100]) + ",\n" + "z" * 5000 * (i % 3) for i in range(0, len(words), 100)]
    for part in (texts, texts[:150], texts[150:]):
        found = [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(part)]
        assert found == [library.encode(t, add_special_tokens=False).ids for t in part]
        known = encoder.known
        assert len(known.pieces) == len(known.ids) == len(known.used) <= 20_000
        assert max(len(p) for p in known.pieces.to_pylist()) <= byte_tokens.LONG
        assert known.pieces.nbytes + known.ids.nbytes + known.used.nbytes < 80 * 20_000
    # What was used last is what stays.
    assert {" " + w for w in words[15_001:15_010]} <= set(encoder.known.pieces.to_pylist())


def test_words_and_signs_are_pieces_of_their_own():
    texts = ["Ünder the-rose, don't (stop)\nThe end\n\nNow  x3 ", " “so” 　wide", ""]
    raw = "".join(texts).encode()
    ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts = byte_tokens.begins(np.frombuffer(raw, dtype=np.uint8), ends, True).tolist()
    pieces = [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
    assert pieces == [
        "Ünder", " the", "-", "rose", ",", " don", "'t", " (", "stop", ")\n", "The", " end", "\n\nNow", " ", " x", "3 ", " “so” 　wide",
    ]


def test_workers_give_back_what_they_have_freed():
    """After a task a worker holds what it still needs, not what its texts took."""
    code = """
import os, re
import pyarrow as pa
from obsmill.llm.frames import lean

def held():
    return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

def run(batches):
    for batch in batches:
        words = [os.urandom(1000) for _ in range(100_000)]
        kept.extend(words[::5000])  # the heap's end stays in use
        yield len(pa.array(words).cast(pa.large_binary()))
        del words

kept, before = [], held()
for wrapped in (run, lean(run)):
    for _ in wrapped(iter([1])):
        pass
    print(held() - before)
"""
    answer = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True, timeout=60)
    plain, own = map(int, answer.stdout.split())
    assert plain > 60 and 3 * own < plain


def test_packing_gives_memory_back_after_each_slice(monkeypatch):
    given = []
    monkeypatch.setattr(packing, "give_back", lambda: given.append(1))
    monkeypatch.setattr(packing.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["a text"] * 5000)], names=["doc_id", "text"])
    parts = list(packing._encode(BYTES, 0, 1024)(iter([batch])))
    assert len(given) == len(parts) == 2


def test_counts_of_packing_are_few_files(spark, docs, monkeypatch):
    """Their files are far fewer than the partitions, also where Spark doesn't join small ones."""
    files = {}

    def counted(df, name, **options):
        out = stored(df, name, **options)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(packing, "stored", counted)
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        packing.pack(docs, BYTES, 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files["pack-cells"] <= 4
