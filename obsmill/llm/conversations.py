"""Finds and repairs faults in the structure of conversations.

A conversation is well formed if it is empty, or an optional system message
followed by pairs of a user and an assistant message.  Its repair is a lightest
derivation: an item (i, state) says that the messages from i on can be repaired
so that they continue a conversation in that state, and a rule leads from an
edit of one message, or an inserted one, and an item to another item.  Knuth's
generalisation of Dijkstra's algorithm takes items from an agenda in the order
of their weights until the goal, all messages in the first state, is final.

A weight is (cost, audit); a rule adds to the cost and puts its mark before the
audit, which keeps the order of weights (monotone).  As an edit of no cost may
give a lesser audit, the agenda compares costs, then messages covered, then
audits; so a rule's result always comes after what it follows from (superior).
Two rules that lead to one item never have the same mark, so the mark alone
decides between audits and no audit is ever written out before the end.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from array import array
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmill.llm.frames import importable, named

# White space, signs that end a message, costs of edits, roles.
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

#: States by the last role so far: none, system, user, assistant.  For each the role that may
#: follow it, besides a system message at the beginning, and the state that this leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
#: The states from which a state is reached by the role that may follow.
BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,), START: (), SYSTEM: ()}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

REPAIRED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
#: Messages of a conversation beyond so many bytes wait in a temporary file of the task.
MEMORY = 8 << 20


def repair(initials: str, faults: bytes) -> tuple[int, str]:
    """The least cost and the least audit of that cost, for messages with these role initials and faults.

    Marks: D deletes a message, I inserts an empty one of the role that may
    follow, K keeps one, R gives one that role.
    """
    count = len(faults)
    marks = bytearray(4 * (count + 1))  # of items that are final, 0 for others
    agenda = [(0, 0, 0, 4 * count + state, 0) for state in (START, ASSISTANT)]
    while agenda:
        cost, covered, mark, item, _ = heapq.heappop(agenda)
        if marks[item]:
            continue
        marks[item] = mark or 1
        at, state = divmod(item, 4)
        if item == START:
            return cost, _audit(initials, marks)
        for before in BEFORE[state]:
            if not marks[4 * at + before]:
                heapq.heappush(agenda, (cost + INSERT, covered, 73, 4 * at + before, item))
        if not at:
            continue
        own, row = 4 * (at - 1), at - 1
        if not marks[own + state]:
            heapq.heappush(agenda, (cost + DELETE, covered + 1, 68, own + state, item))
        fault = faults[row]
        if fault in (BLANK, DUPLICATE):
            continue
        cut = CUT if fault == TRUNCATED else 0
        for before in BEFORE[state]:
            if not marks[own + before]:
                keeps = initials[row] == FOLLOWS[before][0]
                heapq.heappush(agenda, (cost + cut + (KEEP if keeps else REROLE), covered + 1, 75 if keeps else 82, own + before, item))
        if state == SYSTEM and initials[row] == "s" and not marks[own + START]:
            heapq.heappush(agenda, (cost + cut + KEEP, covered + 1, 75, own + START, item))
    raise AssertionError("deleting all messages is always a repair")


def _audit(initials: str, marks: bytearray) -> str:
    """The marks on the way from the goal to the end."""
    found, at, state, last = bytearray(), 0, START, len(marks) // 4 - 1
    while (mark := marks[4 * at + state]) != 1:
        found.append(mark)
        if mark == 75 and state == START and initials[at] == "s":
            state = SYSTEM
        elif mark != 68:
            state = FOLLOWS[state][1]
        at += mark != 73
    if at != last:
        raise AssertionError("a derivation covers all messages")
    return found.decode()


class _Conversation:
    """What is known of one conversation whose messages come in order: little for each, texts on disk if they are many."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.initials: list[str] = []
        self.faults, self.sizes = bytearray(), array("q")
        self.texts = tempfile.SpooledTemporaryFile(max_size=MEMORY)
        self.least, self.most, self.turns, self.last = None, None, 0, None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        bare = text.rstrip(SPACE)
        # Equal messages of one turn follow each other; `seen` tells of earlier turns.
        same = (turn, role, text) == self.last
        fault = BLANK if not bare else DUPLICATE if seen or same else SOUND if bare.endswith(ENDS) else TRUNCATED
        if turn is not None and (self.last is None or self.last[0] != turn):
            self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        self.last = (turn, role, text)
        self.initials.append(role[:1] or " ")
        self.faults.append(fault)
        for part in (role, text):
            data = part.encode()
            self.sizes.append(len(data))
            self.texts.write(data)

    def _messages(self) -> Iterator[tuple[bytes, bytes]]:
        self.texts.seek(0)
        for i in range(0, len(self.sizes), 2):
            yield self.texts.read(self.sizes[i]), self.texts.read(self.sizes[i + 1])

    def _digest(self, audit: str) -> str:
        """The digest of the repaired messages, one by one."""
        found, state, first, messages, at = hashlib.sha256(), START, True, self._messages(), 0
        for mark in audit:
            role, text = (b"", b"") if mark == "I" else next(messages)
            system = mark == "K" and state == START and self.initials[at] == "s"
            at += mark != "I"
            if mark == "D":
                continue
            if mark != "K":
                role = ROLES[FOLLOWS[state][0]].encode()
            state = SYSTEM if system else FOLLOWS[state][1]
            found.update(role + b":" + text if first else b"\n" + role + b":" + text)
            first = False
        return found.hexdigest()

    def row(self) -> tuple:
        initials = "".join(self.initials)
        cost, audit = repair(initials, bytes(self.faults))
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        counts = [self.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
        illegal = sum(a + b not in LEGAL for a, b in pairwise(initials))
        digest = self._digest(audit)
        self.texts.close()
        return (self.conv_id, gaps, *counts, illegal, cost, audit, digest)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes messages sorted by conversation and place, and gives a row for each conversation."""
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    current: _Conversation | None = None
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "seen"))
        for conv_id, turn, role, text, copies, seen in zip(*columns, strict=True):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    rows.append(current.row())
                current = _Conversation(conv_id)
            for _ in range(copies):
                current.add(turn, role, text, seen)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(current.row(), kinds, strict=True)], names=names)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): messages after a damage that their conversation and turn decide.

    Of twenty kinds, told by a checksum of `conv_id:turn`, the first loses the
    message, the next empties it, takes its full stops and marks, repeats it,
    or makes it the user's.  A lost message stays as a row of no copies.  Nulls
    count as one space in the checksum, and so do null roles and texts.
    """
    spoken = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat_ws(":", *spoken).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def messages(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, turn, role, text, copies) of every row, once; null roles and texts become one space."""
    importable(conversations.sparkSession)
    words: list[Column] = [
        F.coalesce(F.col(named(c)).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))
    ]
    numbers = [F.col(named(c)).cast("long").alias(n) for c, n in ((conv_col, "conv_id"), (turn_col, "turn"))]
    return conversations.select(*numbers, *words, F.lit(1).alias("copies"))


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of messages(): faults, and the cheapest repair.

    Messages are taken by turn, null turns first; messages of one turn by role
    and text.  A message's first fault counts: blank, duplicate (role and text
    were seen earlier in the conversation), truncated (its last letter ends no
    sentence).  Blank and duplicate messages can only be deleted.  Roles count
    by their first letter; an empty role has none.  The null conv_id is a
    conversation like others; one without messages, as all have no copies, has
    zeros and an empty audit.  An empty table gives no rows.

    Messages that occur again in a conversation are found by grouping, so a
    message of very many copies is one row of that join.  A repaired
    conversation is one row whose digest runs over all its messages, so a task
    reads them one by one: it holds some bytes for each and an agenda, while
    texts beyond MEMORY wait on its disk.
    """
    order = F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    size = F.octet_length("role").cast("string")
    marked = rows.withColumn("digest", F.sha2(F.concat_ws(":", size, F.concat("role", "text")).cast("binary"), 256))
    firsts = marked.where(F.col("copies") > 0).groupBy("conv_id", "digest")
    firsts = firsts.agg(F.min(order).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    firsts = firsts.select(F.col("conv_id").alias("own"), F.col("digest").alias("again"), "first")
    again = F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("again"))
    joined = marked.join(firsts, again, "left")
    told = joined.withColumn("seen", F.coalesce(order > F.col("first"), F.lit(False)))
    place = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    columns = ["conv_id", "turn", "role", "text", "copies", "seen"]
    return told.select(*columns).repartition("conv_id").sortWithinPartitions(*place).mapInArrow(_repaired, REPAIRED)
