"""Approximate nearest neighbours with a forest of hash prefixes.

Rows are dealt evenly into parts of bounded size. Every part has, per tree, an array of long hash strings (signs of
random projections) in sorted order. A query goes down each tree to its longest matching prefix and then up all trees
together, one character at a time, taking in the rows that share the shorter prefix; it stops once a row as near as
its k-th best so far would have been met with the wanted probability. The best of all parts are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows in a part, queries in a block.
PART_ROWS, QUERY_ROWS = 16_384, 4_096
TREES, LENGTH = 48, 24


def usable(vectors: DataFrame, id_col: str, vector_col: str, need_id: bool = True) -> DataFrame:
    """(vec_id, v, size): rows whose vector is present, finite, without null components and not zero, as doubles."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v")).where("v IS NOT NULL AND size(v) > 0")
    if need_id:
        rows = rows.where("vec_id IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & (x == x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine & F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))


def planes(dims: int, trees: int, length: int) -> np.ndarray:
    return np.random.default_rng([2005, dims]).standard_normal((dims, trees * length))


def hash_strings(x: np.ndarray, trees: int, length: int) -> np.ndarray:
    """(rows, trees) hash strings of ``length`` signs, as integers whose high bits are the first characters."""
    across, places = planes(x.shape[1], trees, length), 1 << np.arange(length - 1, -1, -1, dtype=np.int64)
    out = np.empty((len(x), trees), np.int64)
    for at in range(0, len(x), 1024):
        signs = (x[at:at + 1024] @ across > 0).reshape(-1, trees, length)
        out[at:at + 1024] = signs @ places
    return out


def in_order(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with ``q``, added up component by component."""
    total = np.zeros(len(x))
    for k in range(len(q)):
        total += x[:, k] * q[k]
    return total


class Forest:
    """The sorted hash strings of one part, per tree."""

    def __init__(self, x: np.ndarray, longest: float, trees: int, length: int) -> None:
        # One more component gives all rows the same length, so that the largest inner product is the smallest angle.
        rest = np.sqrt(np.maximum(longest ** 2 - (x * x).sum(axis=1), 0))
        self.x, self.longest, self.trees, self.length = x, longest, trees, length
        codes = hash_strings(np.c_[x, rest], trees, length)
        self.order = np.argsort(codes, axis=0, kind="stable").T.ravel()
        # All trees' arrays one after the other: the tree's number stands before its hash strings.
        self.tree = np.arange(trees, dtype=np.int64) << length
        self.codes = (np.sort(codes, axis=0) + self.tree).T.ravel()

    def search(self, q: np.ndarray, own: list[int], k: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best found and those level with the last of them, without the rows ``own``.

        Scores on the way come from matrix products, whose last bits depend on the rows taken together, so rows within
        ``margin`` of the last place stay; the scores returned are sums in one fixed order, equal for equal vectors.
        """
        norm = np.sqrt(q @ q)
        margin = 8 * len(q) * np.finfo(float).eps * norm * self.longest
        code = hash_strings(np.r_[q, 0.0][None, :], self.trees, self.length)[0] + self.tree
        seen = np.zeros(len(self.x), bool)
        seen[own] = True
        # Down: the longest prefix any row of a tree shares is next to where the query would stand in its array.
        at = np.searchsorted(self.codes, code)
        beside = np.minimum(self.codes[np.maximum(at - 1, 0)] ^ code, self.codes[np.minimum(at, len(self.codes) - 1)] ^ code)
        depth = max(0, self.length - int(beside.min()).bit_length())
        rows, scores = np.empty(0, int), np.empty(0)
        # Up, all trees together.
        while True:
            shift = self.length - depth
            low = (code >> shift) << shift
            bounds = np.searchsorted(self.codes, np.r_[low, low + (1 << shift)]).tolist()
            mark = np.zeros(len(seen), bool)
            for a, b in zip(bounds[:self.trees], bounds[self.trees:]):
                if a < b:
                    mark[self.order[a:b]] = True
            new = np.flatnonzero(mark & ~seen)
            if len(new):
                seen[new] = True
                near = self.x.take(new, axis=0) @ q
                if len(rows) >= k:  # only what can still be among the best
                    better = near >= scores.min() - margin
                    new, near = new[better], near[better]
                scores, rows = np.r_[scores, near], np.r_[rows, new]
                if len(rows) > k:
                    keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - margin  # ties at the edge stay
                    rows, scores = rows[keep], scores[keep]
            if depth == 0:
                break
            if len(rows) >= k:
                cosine = min(1.0, max(-1.0, float(scores.min()) / (norm * self.longest)))
                if 1 - (1 - (1 - np.arccos(cosine) / np.pi) ** depth) ** self.trees >= sure:
                    break
            depth -= 1
        return rows, in_order(self.x.take(rows, axis=0), q)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sure: float = 0.97, trees: int = TREES, length: int = LENGTH,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for every query, never a query's own id.

    * null, empty, zero, or non-finite vectors and rows without id take no part, neither as query nor as candidate
    * vectors are compared with those of the same number of components
    * ties go to the smaller vec_id; repeated rows are candidates each, and one query, that of the smallest vector; fewer than k candidates: all of them
    * empty tables: no rows; other columns are not looked at

    A group is one part of rows and one block of queries, both of bounded size and evenly dealt; k rows per query and part
    leave it. ``sure`` is the probability with which a row as near as the k-th best is met in its part.
    """
    rows = stored(usable(vectors, id_col, vector_col).withColumn("nr", F.monotonically_increasing_id()), "vectors")
    once = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    asked = stored(once.withColumn("nr", F.monotonically_increasing_id()), "queries")
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    m = asked.count()
    parts, blocks = max(1, -(-n // PART_ROWS)), max(1, -(-m // QUERY_ROWS))
    left = rows.select("vec_id", "v", "size", F.pmod(F.xxhash64("nr"), F.lit(parts)).alias("part"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("vec_id", "v", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"),
                         F.pmod(F.xxhash64("nr"), F.lit(blocks)).cast("int").alias("block"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    longest = (longest or 1.0) * (1 + 1e-12)

    def matrix(table: pa.Table) -> np.ndarray:
        return np.array(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1)

    def group(key, candidates, wanted):
        ids, out_q, out_v, out_s = candidates.column("vec_id"), [], [], []
        if candidates.num_rows and wanted.num_rows:
            forest = Forest(matrix(candidates), longest, trees, length)
            names = np.array(ids.to_pylist(), dtype=object)
            at = {}
            for i, name in enumerate(names):
                at.setdefault(name, []).append(i)
            for name, q in zip(wanted.column("vec_id").to_pylist(), matrix(wanted)):
                found, scores = forest.search(q, at.get(name, []), k, sure)
                best = sorted(zip(-scores, names[found], found))[:k]
                out_q += [name] * len(best)
                out_v += [i for _, _, i in best]
                out_s += [-s for s, _, _ in best]
        where = pa.array(out_v, pa.int64())
        return pa.table({"query_id": pa.array(out_q, ids.type), "vec_id": ids.take(where), "score": pa.array(out_s, pa.float64())})

    found = left.groupBy("part", "block", "size").cogroup(right.groupBy("part", "block", "size")).applyInArrow(
        group, f"query_id {kind}, vec_id {kind}, score DOUBLE")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
