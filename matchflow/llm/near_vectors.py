"""Near copies of vectors by collision-counting projections.

Vectors are projected on many random directions in two levels: where a vector lies in the tail of a first direction, it
is projected on that direction's own second directions. The tail of a second direction is one sorted list. Each
vector looks at its window of that list, the values within ``window`` of its own; two vectors in each other's window
collide. A pair is verified where it collides at least ``COUNT`` times. The number of directions is set so that a pair
exactly at the threshold reaches that count with probability ``recall``: its projections are a pair of normal
variables with that correlation, whatever the data.

A list is worked off in blocks of bounded size. A pair is looked at where its last needed collision lies and nowhere
else, so links are counted per vector in place and no pairs leave a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .forest import usable

COUNT = 2
#: Vectors a list should have, about, and vectors a block of a list may have.
LIST_ROWS, BLOCK = 128, 1024
#: Steps of a stored value above the start of the tail.
STEP = 0.02


def tail_of(share: float) -> float:
    """The value above which a standard normal variable lies with probability ``share``."""
    low, high = -10.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(mid / math.sqrt(2)) / 2 > share else (low, mid)
    return (low + high) / 2


def together(tail: float, window: float, cosine: float) -> float:
    """P(two standard normal variables of this correlation are both above ``tail`` and within ``window``)."""
    x = np.linspace(tail, tail + 8, 8001)
    spread = math.sqrt(1 - cosine * cosine)
    below = np.array([math.erfc(-(min(v + window, 1e9) - cosine * v) / spread / math.sqrt(2)) for v in x]) / 2
    floor = np.array([math.erfc(-(max(v - window, tail) - cosine * v) / spread / math.sqrt(2)) for v in x]) / 2
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return float(np.trapezoid(density * (below - floor), x))


def plan(n: int, cosine: float, recall: float) -> dict:
    """Tails, window and numbers of directions for n vectors."""
    share = min(0.3, math.sqrt(LIST_ROWS / max(n, 1)))
    tail = tail_of(share)
    window = 3.5 * math.sqrt(2 - 2 * cosine)
    both_first, both_second = 2 * together(tail, 1e6, cosine), 2 * together(tail, window, cosine)
    second = max(4, round(1.1 / both_second))
    first = 1

    def missed(first):
        # The pair shares A of the first directions, and collides in a binomial number of their A * second lists.
        total, p = 0.0, (1 - both_first) ** first
        for a in range(first + 1):
            m = a * second
            few = sum(math.comb(m, c) * both_second ** c * (1 - both_second) ** (m - c) for c in range(min(COUNT, m + 1)))
            total += p * few
            p *= (first - a) / (a + 1) * both_first / (1 - both_first)
            if p < 1e-15 and a > first * both_first:
                break
        return total

    while missed(first) > 1 - recall:
        first = first + max(1, first // 20)
    return {"tail": tail, "window": window, "first": first, "second": second}


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, without running over or under on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def projected(x: np.ndarray, how: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, step) of all lists unit vectors fall into; a list is numbered by directions and signs."""
    dims, first, second, tail = x.shape[1], how["first"], how["second"], how["tail"]
    out = []
    top = x @ np.random.default_rng([dims, 1]).standard_normal((dims, first))
    for g in range(first):
        across = np.random.default_rng([dims, 2, g]).standard_normal((dims, second))
        for sign in (0, 1):
            rows = np.flatnonzero(top[:, g] > tail if sign == 0 else top[:, g] < -tail)
            if not len(rows):
                continue
            v = x[rows] @ across
            r, j = np.nonzero(np.abs(v) > tail)
            low = v[r, j]
            number = (((g * 2 + sign) * second + j) * 2 + (low < 0)).astype(np.int64)
            step = np.minimum((np.abs(low) - tail) / STEP, 255).astype(np.uint8)
            out.append((rows[r], number, step))
    if not out:
        return np.empty(0, int), np.empty(0, np.int64), np.empty(0, np.uint8)
    row, number, step = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((number, row))
    return row[order], number[order], step[order]


def block_links(lists: list[np.ndarray], steps: list[np.ndarray], x: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool,
                here: int, window: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of a block whose COUNT-th collision lies in list ``here``."""
    within = window / STEP
    own = np.array([int(s[np.searchsorted(n, here)]) for n, s in zip(lists, steps)])
    # Windows of the sorted list.
    by_value = right[np.argsort(own[right], kind="stable")]
    values = own[by_value]
    out_i, out_j = [], []
    rows_left = left[np.argsort(own[left], kind="stable")]
    for at in range(0, len(rows_left), 256):
        i = rows_left[at:at + 256]
        a, b = np.searchsorted(values, own[i].min() - within), np.searchsorted(values, own[i].max() + within, "right")
        j = by_value[a:b]
        close = (x[i] @ x[j].T >= cosine) & (np.abs(own[i][:, None] - own[j][None, :]) <= within)
        if same:
            close &= i[:, None] < j[None, :]
        p, q = np.nonzero(close)
        out_i.append(i[p])
        out_j.append(j[q])
    i, j = (np.concatenate(c) if c else np.empty(0, int) for c in (out_i, out_j))
    if not len(i):
        return i, j
    # The cosine is the cheaper test and comes first; a link still needs its count, and counts in one list only.
    every = np.unique(np.concatenate([n[n <= here] for n in lists]))
    table = np.full((len(lists), len(every)), np.nan, np.float32)
    for r, (n, s) in enumerate(zip(lists, steps)):
        upto = n <= here
        table[r, np.searchsorted(every, n[upto])] = s[upto]
    hit = np.zeros(len(i), bool)
    width = max(1, 4_000_000 // max(1, len(every)))
    for at in range(0, len(i), width):
        with np.errstate(invalid="ignore"):
            hit[at:at + width] = (np.abs(table[i[at:at + width]] - table[j[at:at + width]]) <= within).sum(axis=1) == COUNT
    return i[hit], j[hit]


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.999, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    * null, empty, zero or non-finite vectors and those with null components: no links, their own component
    * equal vectors are one class with a count, so copies never meet each other; a link of two classes counts for all of them
    * vectors are compared with those of the same number of components
    * null id: takes part, and is null in the result; its component is the smallest id reached, and it is kept if there is none
    * repeated rows: linked with each other like any equal vectors; empty table: no rows; other columns are not looked at
    """
    everything = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    classes = stored(usable(everything, "id", "v", need_id=False).groupBy("v").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("members")).withColumn("class", F.monotonically_increasing_id()), "classes")
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    n = classes.count()
    how = plan(n, cosine, recall)
    lists = list_rows(classes, how, "<f4" if single else "<f8")
    found = stored(links_of(lists, how, cosine, "<f4" if single else "<f8"), "links")
    counts = found.where("is_count").groupBy("class").agg(F.sum("value").alias("others"))
    edges = found.where("NOT is_count").select(F.col("class").alias("a"), F.col("value").alias("b"))
    reached = components(edges)
    named = reached.join(classes.select(F.col("class").alias("node"), "first_id"), "node")
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    placed = named.join(first, "component").select(F.col("node").alias("class"), "component_id")
    answers = (classes.join(counts, "class", "left").join(placed, "class", "left").select(
        F.col("v").alias("class_v"), (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"),
        F.coalesce("component_id", "first_id").alias("class_component")))
    joined = everything.join(answers, F.col("v") == F.col("class_v"), "left")
    component = F.when(F.col("class_v").isNull(), F.col("id")).otherwise(F.col("class_component"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def list_rows(classes: DataFrame, how: dict, kind: str) -> DataFrame:
    """(size, list, class, members, x, lists, steps): a row for every list a class falls into."""

    def run(batches):
        for batch in batches:
            sizes = np.array(batch.column("size"))
            for size in np.unique(sizes):
                some = batch.filter(pa.array(sizes == size))
                for at in range(0, some.num_rows, 4096):
                    part = some.slice(at, 4096)
                    x = np.array(part.column("v").flatten()).reshape(part.num_rows, -1)
                    row, number, step = projected(unit(x), how)
                    cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                    raw_lists = [number[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                    raw_steps = [step[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
                    raw_x = [v.tobytes() for v in x.astype(kind)]
                    rows = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        part.column("size").take(rows), pa.array(number), part.column("class").take(rows), part.column("members").take(rows),
                        *[pa.array(raw, pa.binary()).take(rows) for raw in (raw_x, raw_lists, raw_steps)]],
                        ["size", "list", "class", "members", "x", "lists", "steps"])

    return classes.withColumn("size", F.size("v")).select("size", "class", "members", "v").mapInArrow(
        run, "size INT, list BIGINT, class BIGINT, members BIGINT, x BINARY, lists BINARY, steps BINARY")


def links_of(rows: DataFrame, how: dict, cosine: float, kind: str) -> DataFrame:
    """Per block (class, value, is_count): how many vectors a class is linked with there, and edges that join what is linked."""
    rows = stored(rows, "lists")
    sizes = rows.groupBy("size", "list").agg(F.expr(f"CAST(ceil(count(1) / {BLOCK}) AS INT)").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = rows.join(sizes, ["size", "list"]).withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    dealt = parts.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "size", "list", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "class", "members", "x", "lists", "steps")

    def group(key, table):
        here, low, high = key[1].as_py(), key[2].as_py(), key[3].as_py()
        part = table.column("part").to_numpy()
        names, members = table.column("class").to_numpy(), table.column("members").to_numpy()
        x = unit(np.frombuffer(b"".join(table.column("x").to_pylist()), kind).astype(float).reshape(table.num_rows, -1))
        lists = [np.frombuffer(r, np.int64) for r in table.column("lists").to_pylist()]
        steps = [np.frombuffer(r, np.uint8) for r in table.column("steps").to_pylist()]
        i, j = block_links(lists, steps, x, np.flatnonzero(part == low), np.flatnonzero(part == high), low == high, here, how["window"], cosine)
        n = np.zeros(table.num_rows, np.int64)
        np.add.at(n, i, members[j])
        np.add.at(n, j, members[i])
        has = np.flatnonzero(n)
        # Joined to the smallest class each is linked with here, over and over: few edges, the same components.
        root = names.copy()
        while len(i):
            before = root.copy()
            np.minimum.at(root, i, before[j])
            np.minimum.at(root, j, before[i])
            if (root == before).all():
                break
        return pa.table({"class": np.r_[names[has], names[has]], "value": np.r_[n[has], root[has]],
                         "is_count": np.r_[np.ones(len(has), bool), np.zeros(len(has), bool)]})

    return dealt.groupBy("size", "list", "low", "high").applyInArrow(group, "class BIGINT, value BIGINT, is_count BOOLEAN")
