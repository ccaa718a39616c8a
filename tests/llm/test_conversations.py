"""Faults and repairs of conversations against a search through all edits."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obsmill.llm import conversations
from obsmill.llm.conversations import BLANK, DUPLICATE, SOUND, TRUNCATED, repair

WELL_FORMED = re.compile(r"(s?(ua)+)?")
ILL_BEGUN = re.compile("uu|aa|.s|sa|^a|[^sua]")


def plain_repair(initials, faults):
    """The least (cost, audit) of all edits that end well; deleting everything bounds the cost."""
    best = (3 * len(faults), "D" * len(faults))
    waiting = [(0, "", 0, "")]
    while waiting:
        cost, audit, i, roles = waiting.pop()
        if cost > best[0]:
            continue
        if i == len(faults) and WELL_FORMED.fullmatch(roles):
            best = min(best, (cost, audit))
        after = [(cost + 2, audit + "I", i, roles + x) for x in "ua"]
        if i < len(faults):
            after.append((cost + 3, audit + "D", i + 1, roles))
            if faults[i] in (SOUND, TRUNCATED):
                cut = faults[i] == TRUNCATED
                after.append((cost + cut, audit + "K", i + 1, roles + initials[i]))
                after += [(cost + cut + 2, audit + "R", i + 1, roles + x) for x in "ua"]
        waiting += [a for a in after if not ILL_BEGUN.search(a[3])]
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax "), st.sampled_from([SOUND, SOUND, SOUND, BLANK, DUPLICATE, TRUNCATED])), max_size=6))
def test_repairs_are_the_cheapest(messages):
    initials, faults = "".join(m[0] for m in messages), bytes(m[1] for m in messages)
    assert repair(initials, faults) == plain_repair(initials, faults)


def test_long_conversations():
    assert repair("ua" * 20_000, bytes(40_000)) == (0, "K" * 40_000)
    assert repair("u" * 3001, bytes(3001))[0] == 3001 // 2 * 2 + 2


def plain_rows(rows):
    """The rows of the query, by the rules alone."""
    spoken = lambda v: " " if v is None else str(v)
    groups = {}
    for conv_id, turn, role, text in rows:
        own = groups.setdefault(conv_id, [])
        role, text = spoken(role), spoken(text)
        kind = zlib.crc32(f"{spoken(conv_id)}:{spoken(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv_id, own in groups.items():
        own.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), m[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append(BLANK if not bare else DUPLICATE if (role, text) in seen else SOUND if bare[-1] in ".!?" else TRUNCATED)
            seen.add((role, text))
        turns = [m[0] for m in own if m[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = "".join(m[1][:1] or " " for m in own)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = plain_repair(initials, bytes(faults))
        left, at, last = [], 0, ""
        for mark in audit:
            _, role, text = ("", "", "") if mark == "I" else own[at]
            at += mark != "I"
            if mark in "IR":
                role = "assistant" if last == "u" else "user"
            if mark != "D":
                left.append(f"{role}:{text}")
                last = role[0]
        digest = hashlib.sha256("\n".join(left).encode()).hexdigest()
        out.append((conv_id, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit, digest))
    return Counter(out)


@pytest.mark.parametrize("memory", [8 << 20, 10])
def test_conversations_equal_brute_force(spark, monkeypatch, memory):
    monkeypatch.setattr(conversations, "MEMORY", memory)
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Assistant", "söt", "ä"]
    texts = ["Yes.", "No!", "Why?", "cut", "cut ", " \t", "", None, "é. \n", "a:b\nc.", " ", "Yes.", "." * 3, "?!\x0b"]
    rows = []
    for conv_id in [None, *range(60)]:
        for turn in range(rng.randrange(7)):
            turn = rng.choice([turn, turn, turn, turn + 3, None, 1])
            row = (conv_id, turn, rng.choice(roles), rng.choice(texts), "x", 1, 2)
            rows += [row] * rng.choice([1, 1, 1, 2])
    rows.append((None, None, "user", "t" * 200_000, "x", 1, 2))
    columns = "conv_id long, turn long, role string, text string, digest string, copies int, seen int"
    table = spark.createDataFrame(rows, columns).repartition(4)
    found = conversations.repaired(conversations.damaged(conversations.messages(table)))
    assert Counter(map(tuple, found.collect())) == plain_rows([r[:4] for r in rows])


def test_a_conversation_of_one_message_repeated(spark):
    rows = [(1, i, "user", "Same.") for i in range(3000)] + [(2, 0, "user", "Hi.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in conversations.repaired(conversations.messages(table)).collect()}
    assert found[1].duplicate == 2999 and found[1].cost == 3 * 2999 + 2 and found[1].audit == "K" + "D" * 2999 + "I"
    assert (found[2].cost, found[2].audit) == (2, "KI")


def test_no_conversations(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repaired(conversations.damaged(conversations.messages(table))).count() == 0
