import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from matchflow.llm import conversations as conv
from matchflow.llm import queries

SCHEMA = ("conv_id BIGINT, turn BIGINT, role STRING, text STRING, conv STRING, digest INT, present STRING, block STRING, stats INT, "
          "edits INT, kind INT, fate STRING, state STRING")
CLASH = ("clash", 1, "clash", "clash", 1, 1, 1, "clash", "clash")


def make(spark, rows):
    return spark.createDataFrame([tuple(r) + CLASH for r in rows], SCHEMA)


def brute(rows):
    """The answer for one conversation's rows (turn, role, text) in order, from whole strings and from the end."""
    kinds, seen = [], set()
    counts = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(fault)
        if fault:
            counts[fault] += 1

    def after(done, c):
        return done + c if re.fullmatch(r"s|s?(ua)*u?", done + c) else None

    short = lambda done: re.sub("uaua(ua)*", "ua", done)  # noqa: E731  what matters of the roles written

    @cache
    def best(i, done, inserts):
        found = [(0, "", ())] if i == len(rows) and re.fullmatch("(s?(ua)+)?", done) else []
        if inserts < 3:
            for c, role in (("u", "user"), ("a", "assistant")):
                if (new := after(done, c)) is not None and (b := best(i, short(new), inserts + 1)):
                    found.append((b[0] + 5, "I" + b[1], ((role, ""),) + b[2]))
        if i < len(rows):
            _, role, text = rows[i]
            if b := best(i + 1, done, 0):
                found.append((b[0] + 2, "D" + b[1], b[2]))
            if kinds[i] in ("", "truncated"):
                extra = 5 if kinds[i] else 0
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (new := after(done, c)) is not None and (b := best(i + 1, short(new), 0)):
                        found.append((b[0] + 1 + extra, "R" + b[1], ((name, text),) + b[2]))
                if role[:1] in ("s", "u", "a") and (new := after(done, role[:1])) is not None and (b := best(i + 1, short(new), 0)):
                    found.append((b[0] + extra, "K" + b[1], ((role, text),) + b[2]))
        return min(found) if found else None

    cost, audit, written = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts,
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in written).encode()).hexdigest(), "written": list(written)}


def by_turn(rows):
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))


def some_conversations(seed, n, longest):
    rng, out = random.Random(seed), {}
    for c in range(n):
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["tool", "", "user"], [None, "assistant", "unknown"]])
        out[c] = [(rng.choice([k, k, k, rng.randrange(6), None]), rng.choice(roles),
                   rng.choice(["Yes.", "Why? \n", "cut", "and so", "", " \t", "No!", None, f"Text {k}.", f"Text {k}."]))
                  for k in range(rng.randint(1, longest))]
    return out


@pytest.mark.parametrize("block", [1, 3, conv.BLOCK])
def test_repair_matches_brute_force(spark, block):
    made = some_conversations(block, 250, 9)
    rows = [(c, *r) for c, rs in made.items() for r in rs]
    random.Random(1).shuffle(rows)
    docs = make(spark, rows).repartition(3)
    got = {r["conv_id"]: r.asDict() for r in conv.repaired(docs, block=block).collect()}
    texts: dict = {}
    for r in sorted(conv.repaired_rows(docs, block=block).collect()):
        texts.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got.keys() == made.keys()
    for c, rs in made.items():
        want = brute(by_turn(rs))
        assert texts.get(c, []) == want.pop("written")
        assert {k: got[c][k] for k in want} == want, (c, by_turn(rs))


def test_paths_that_never_meet_span_blocks(spark):
    """No row has a role that may stay, so two paths live on to the end, over many blocks."""
    rows = [(1, k, "tool", f"Text {k}.") for k in range(999)] + [(2, 0, "user", "Yes."), (2, 1, "assistant", "No.")]
    got = {r["conv_id"]: r for r in conv.repaired(make(spark, rows), block=10).collect()}
    assert got[1]["audit"] == "D" + "R" * 998 and got[1]["cost"] == 1000
    assert (got[2]["audit"], got[2]["cost"]) == ("KK", 0)


def test_rows_like_each_other_across_blocks(spark):
    rows = [(1, 5, "user", "Same.")] * 40 + [(1, None, "user", "Same.")] + [(1, 6, "assistant", "Other.")] * 3
    got = conv.repaired(make(spark, rows), block=7).first()
    want = brute(by_turn([r[1:] for r in rows]))
    assert all(got[k] == v for k, v in want.items() if k != "written")
    assert (got["duplicate"], got["gaps"]) == (42, 0)


def test_damage_and_edges(spark):
    rows = [(c, t, r, x) for c in range(60) for t, r, x in ((0, "system", "Be kind."), (1, "user", "How? x! y."), (2, "assistant", "So."), (None, None, None))]
    rows += [(None, 1, "user", "No conversation."), (None, 2, "assistant", "None."), (99, 0, "user", "many words. " * 100_000)]
    want, announced = {}, set()
    for c, t, r, x in rows:
        announced.add(c)
        blank = lambda v: " " if v is None else v
        fate = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        r, x = "user" if fate == 4 else blank(r), "" if fate == 1 else re.sub("[.!?]", "", blank(x)) if fate == 2 else blank(x)
        want.setdefault(c, []).extend([(t, r, x)] * {0: 0, 3: 2}.get(fate, 1))
    got = {r["conv_id"]: r for r in conv.repaired(conv.damaged(make(spark, rows)), present_col="present").collect()}
    assert got.keys() == announced
    for c, rs in want.items():
        expected = brute(by_turn(rs))
        assert all(got[c][k] == v for k, v in expected.items() if k != "written"), c
    empty = conv.repaired(make(spark, []))
    assert empty.count() == 0 and empty.columns[:3] == ["conv_id", "gaps", "blank"]
    gone = make(spark, [(7, 1, "user", "Hi.")]).withColumn("here", F.lit(False))
    row = conv.repaired(gone, present_col="here").first()
    assert (row["cost"], row["audit"], row["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


def test_registered_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    made: dict = {}
    for c, t, r, x in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        fate = zlib.crc32(f"{c}:{t}".encode()) % 20
        r, x = "user" if fate == 4 else r, "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        made.setdefault(c, []).extend([(t, r, x)] * {0: 0, 3: 2}.get(fate, 1))
    got = {r["conv_id"]: r for r in queries.op13_conversations(spark, folder).collect()}
    assert got.keys() == made.keys()
    for c, rs in made.items():
        expected = brute(by_turn(rs))
        assert all(got[c][k] == v for k, v in expected.items() if k != "written"), c
