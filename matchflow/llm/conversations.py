"""Repair of conversations whose turns no longer alternate, by a streamed cheapest-edit search.

Rows are sorted by conversation and turn and streamed; nothing but four path costs, their order and the backpointers
of one block of rows is held. A row is kept, given another role, or deleted, and empty rows may be inserted, so that
the roles read ``(s?(ua)+)?``: at most one system row, then user and assistant in turns.

1. Narrow rows (role, digest, faults) pass through the search. A conversation that ends within a block is traced
   back at once. One that doesn't spills its backpointers as rows of a stored table, four bytes a row.
2. Only for those, blocks are streamed again from the last to the first and traced back.
3. Texts meet the edits in one more sorted stream, each block's edits just before its first row, and leave repaired.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows whose backpointers a task holds.
BLOCK = 65_536
#: What edits cost. A truncated row that is not deleted costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: Where a path stands: nothing written yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted row or one with a new role leads to.
TURN = (USER, USER, ASSISTANT, USER)
#: What a kept row with the initial s, u or a leads to.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Inserts that complete a conversation.
CLOSING = (0, 2, 1, 0)
EDITS = "DKR"
INITIALS = "sua"
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Search:
    """Cheapest paths to the four states, as an automaton that is put together while it is used.

    A path ends with the edit of the last row, so no path is the beginning of another one and their order is enough
    to choose among equally cheap ones. ``vector`` holds (cost above the least, rank) per state, None where there's no path.
    """

    first = ((0, 0), None, None, None)

    def __init__(self) -> None:
        self.steps: dict = {}

    @staticmethod
    def code(initial: str, must_go: bool, truncated: bool) -> int:
        return 0 if must_go else 1 + 2 * (1 + (INITIALS.find(initial) if initial else -1)) + truncated

    def step(self, vector: tuple, code: int) -> tuple:
        """(vector after the row, cost to add, packed backpointers)."""
        known = self.steps.get((vector, code))
        if known is None:
            known = self.steps[vector, code] = self.made(vector, code)
        return known

    @staticmethod
    def made(vector: tuple, code: int) -> tuple:
        initial = " sua"[(code - 1) // 2] if code else ""
        extra = TRUNCATED if code and (code - 1) % 2 else 0
        best: list = [None] * 4
        for j, old in enumerate(vector):
            if old is None:
                continue
            at, cost = j, old[0]
            for inserts in range(3):
                options = [("D", at, DELETE)]
                if code:
                    options.append(("R", TURN[at], REROLE + extra))
                    if initial in KEEP[at]:
                        options.append(("K", KEEP[at][initial], extra))
                for edit, to, price in options:
                    found = (cost + price, old[1], "I" * inserts + edit, j, inserts)
                    if best[to] is None or found < best[to]:
                        best[to] = found
                at, cost = TURN[at], cost + INSERT
        least = min(b[0] for b in best if b)
        order = sorted((b[1:3], to) for to, b in enumerate(best) if b)
        rank = {to: r for r, (_, to) in enumerate(order)}
        back = 0
        for to, b in enumerate(best):
            if b:
                back |= (b[3] | b[4] << 2 | EDITS.index(b[2][-1]) << 4) << 8 * to
        return tuple((b[0] - least, rank[to]) if b else None for to, b in enumerate(best)), least, back

    @staticmethod
    def end(vector: tuple) -> tuple[int, int]:
        """(cost to add, state the best path ends in)."""
        cost, _, state = min((old[0] + INSERT * CLOSING[j], old[1], j) for j, old in enumerate(vector) if old)
        return cost, state


def traced(backs, state: int) -> tuple[str, int]:
    """(edits in order, state before them) of a block that ends in ``state``."""
    out = []
    for packed in reversed(backs):
        b = packed >> 8 * state & 255
        state = b & 3
        out.append("I" * (b >> 2 & 3) + EDITS[b >> 4])
    out.reverse()
    return "".join(out), state


def prepared(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> DataFrame:
    """(conv, turn, role, text, digest, present); null roles and texts are one space."""
    col = lambda c: F.col(f"`{c}`")
    rows = conversations.select(
        col(conv_col).alias("conv"), col(turn_col).cast("long").alias("turn"), F.coalesce(col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(col(text_col), F.lit(" ")).alias("text"),
        (F.coalesce(col(present_col), F.lit(False)) if present_col else F.lit(True)).alias("present"))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, present, blank, cut, repeated): ``repeated`` where an earlier turn has the same role and text.

    Rows of one turn that are the same follow each other in the stream and are told there. The first turns are found by
    a map-side combined minimum over (conversation, digest), so a conversation of any size spreads over all tasks.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select("conv", "turn", "role", "digest", "present", (bare == "").alias("blank"),
                         (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    place = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    firsts = narrow.where("present").groupBy("conv", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first")
    joined = narrow.join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    return joined.select("conv", "turn", "role", "digest", "present", "blank", "cut", F.coalesce(place > F.col("first"), F.lit(False)).alias("repeated"))


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """One row per block of a conversation's rows: edits where it is the only block, else backpointers.

    (conv, block, turn, role, digest of the block's first row, stats, last, state, edits, backs); ``stats`` and
    ``state`` belong to the last block only.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    schema = (f"conv {kind}, block BIGINT, turn BIGINT, role STRING, digest BINARY, stats ARRAY<BIGINT>, last BOOLEAN, state INT, "
              "edits STRING, backs BINARY")
    names = ["conv", "block", "turn", "role", "digest", "stats", "last", "state", "edits", "backs"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.bool_(), pa.int32(), pa.string(), pa.binary()]

    def run(batches):
        search = Search()
        out: list[tuple] = []
        conv, fresh, conv_type = None, True, None

        def spill(last: bool) -> None:
            nonlocal number, backs, head
            if not last:
                out.append((conv, number, *head, None, False, None, None, backs.tobytes()))
            else:
                end_cost, state = search.end(vector)
                if low is not None:
                    gaps = high - low + 1 - distinct
                else:
                    gaps = 0
                stats = [gaps, blank, duplicate, truncated, illegal, cost + end_cost]
                edits = None
                if number == 0:
                    edits = traced(backs, state)[0] + "I" * CLOSING[state]
                out.append((conv, number, *head, stats, True, state, edits, None if number == 0 else backs.tobytes()))
            number, backs, head = number + 1, array("I"), (None, "", b"")

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            arrays = [pa.array(columns[0], conv_type)] + [pa.array(c, t) for c, t in zip(columns[1:], types)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            conv_type = batch.column("conv").type
            for name, turn, role, digest, present, empty, cut, repeated in zip(*(batch.column(c).to_pylist() for c in (
                    "conv", "turn", "role", "digest", "present", "blank", "cut", "repeated"))):
                if fresh or name != conv:
                    if not fresh:
                        spill(True)
                    conv, fresh, number, backs, head = name, False, 0, array("I"), (None, "", b"")
                    vector, cost, before, previous, last_turn = Search.first, 0, None, None, None
                    blank = duplicate = truncated = illegal = distinct = 0
                    low = high = None
                if not present:
                    continue
                if len(backs) == block:
                    spill(False)
                if not backs:
                    head = (turn, role, digest)
                if turn is not None and turn != last_turn:
                    low, high, distinct, last_turn = turn if low is None else low, turn, distinct + 1, turn
                initial = role[:1]
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                same = repeated or previous == (turn, digest)
                if empty:
                    blank += 1
                elif same:
                    duplicate += 1
                elif cut:
                    truncated += 1
                vector, more, back = search.step(vector, search.code(initial, empty or same, cut))
                cost += more
                backs.append(back)
                before, previous = initial, (turn, digest)
            if out:
                yield flushed()
        if not fresh:
            spill(True)
            yield flushed()

    ordered = rows.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "digest")
    return ordered.mapInArrow(run, schema)


def edits_of(found: DataFrame) -> DataFrame:
    """(conv, block, turn, role, digest, stats, edits) for stored blocks; those of several blocks are traced from the last one."""
    columns = ["conv", "block", "turn", "role", "digest", "stats", "edits"]
    schema = found.select(*columns).schema

    def run(batches):
        state = START
        for batch in batches:
            edits = []
            for last, end, backs in zip(*(batch.column(c).to_pylist() for c in ("last", "state", "backs"))):
                tail = ""
                if last:
                    state, tail = end, "I" * CLOSING[end]
                text, state = traced(array("I", backs), state)
                edits.append(text + tail)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns[:-1]] + [pa.array(edits, pa.string())], columns)

    several = found.where("edits IS NULL").repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    return found.where("edits IS NOT NULL").select(*columns).unionByName(several.mapInArrow(run, schema))


def merged(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts and edits in one sorted stream: (conv, edits, stats, role, text), a block's edits just before its first row."""
    texts = rows.where("present").select("conv", "turn", "role", "digest", "text", F.lit(None).cast("array<bigint>").alias("stats"),
                                         F.lit(None).cast("string").alias("edits"), F.lit(-1).cast("long").alias("block"))
    both = edits.withColumn("text", F.lit(None).cast("string")).unionByName(texts).withColumn("kind", F.col("edits").isNull())
    return both.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "digest", "kind", "block").select(
        "conv", "edits", "stats", "role", "text")


class Writer:
    """Applies edits, a block's at a time, to a conversation's rows in order."""

    def __init__(self) -> None:
        self.state, self.waiting, self.at, self.block = START, [], 0, ""

    def add(self, edits: str) -> None:
        self.waiting.append(edits)

    def _next(self) -> str:
        while self.at >= len(self.block):
            if not self.waiting:
                return ""
            self.block, self.at = self.waiting.pop(0), 0
        self.at += 1
        return self.block[self.at - 1]

    def _turn(self) -> str:
        self.state = TURN[self.state]
        return "user" if self.state == USER else "assistant"

    def row(self, role: str, text: str) -> list[tuple[str, str]]:
        """What is written for the next row: rows inserted before it, and itself unless it is deleted."""
        out = []
        while (edit := self._next()) == "I":
            out.append((self._turn(), ""))
        if edit == "K":
            self.state = KEEP[self.state][role[:1]]
            out.append((role, text))
        elif edit == "R":
            out.append((self._turn(), text))
        return out

    def close(self) -> list[tuple[str, str]]:
        out = []
        while self._next():
            out.append((self._turn(), ""))
        return out


def planned(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
            present_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """The sorted stream of ``merged`` for these conversations."""
    rows = prepared(conversations, conv_col, turn_col, role_col, text_col, present_col)
    return merged(rows, edits_of(stored(blocks(faults(rows), block), "blocks")))


def repaired_rows(conversations: DataFrame, conv_col: str = "conv_id", **options) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, rows numbered from 0.

    See ``repaired`` for nulls, ties and other edge cases.
    """
    stream = planned(conversations, conv_col, **options)
    kind = stream.schema["conv"].dataType.simpleString()

    def run(batches):
        conv, writer, place = None, None, 0
        for batch in batches:
            out: list[tuple] = []

            def put(rows):
                nonlocal place
                for role, text in rows:
                    out.append((conv, place, role, text))
                    place += 1

            for name, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "edits", "role", "text"))):
                if writer is None or name != conv:
                    if writer is not None:
                        put(writer.close())
                    conv, writer, place = name, Writer(), 0
                if edits is not None:
                    writer.add(edits)
                else:
                    put(writer.row(role, text))
            yield made(out, batch.column("conv").type)
            kept_type = batch.column("conv").type
        if writer is not None:
            out = []
            put(writer.close())
            yield made(out, kept_type)

    def made(out, conv_type):
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (conv_type, pa.int64(), pa.string(), pa.string()))],
                                          ["conv", "place", "role", "text"])

    return stream.mapInArrow(run, f"conv {kind}, place BIGINT, role STRING, text STRING").withColumnRenamed("conv", conv_col)


def repaired(conversations: DataFrame, conv_col: str = "conv_id", **options) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation.

    * a row's first fault counts: blank, then repeating a role and text seen earlier, then cut off in a sentence
    * null role or text: one space, so the row is blank or has no role it could keep; null turn: sorted first, no gap;
      null conversation: one conversation
    * ties: rows of one turn are ordered by role, then by a digest of role and text; among equally cheap repairs the audit
      that is least in ASCII order is taken; repeated rows are duplicates
    * rows whose ``present_col`` is not true only announce their conversation; one without rows: zeros, empty audit and text
    * empty table: no rows; other columns are not looked at; conversations and texts of any length are streamed
    """
    stream = planned(conversations, conv_col, **options)
    kind = stream.schema["conv"].dataType.simpleString()

    def run(batches):
        conv, writer, conv_type = None, None, None
        done: list[tuple] = []

        def feed(rows):
            nonlocal started
            for role, text in rows:
                sha.update((("\n" if started else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                started = True

        def finish():
            feed(writer.close())
            done.append((conv, *numbers, "".join(audit), sha.hexdigest()))

        def flushed():
            columns = list(zip(*done)) or [()] * 9
            kinds = [conv_type] + [pa.int64()] * 6 + [pa.string()] * 2
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["conv", *STATS, "audit", "repaired_sha256"])

        for batch in batches:
            conv_type = batch.column("conv").type
            for name, edits, stats, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "edits", "stats", "role", "text"))):
                if writer is None or name != conv:
                    if writer is not None:
                        finish()
                    conv, writer, sha, audit, numbers, started = name, Writer(), hashlib.sha256(), [], None, False
                if edits is not None:
                    writer.add(edits)
                    audit.append(edits)
                    numbers = stats if stats is not None else numbers
                else:
                    feed(writer.row(role, text))
            if done:
                yield flushed()
        if writer is not None:
            finish()
            yield flushed()

    longs = ", ".join(f"{s} BIGINT" for s in STATS)
    return stream.mapInArrow(run, f"conv {kind}, {longs}, audit STRING, repaired_sha256 STRING").withColumnRenamed("conv", conv_col)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): conversations with every twentieth row each dropped, emptied, without sentence
    ends, repeated, or given to the user, by the checksum of ``conv_id:turn``. Dropped rows stay as rows that aren't present.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"))
    rows = rows.withColumn("fate", (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).cast("int"))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") != 0).alias("present"), times.alias("time")).drop("time")
