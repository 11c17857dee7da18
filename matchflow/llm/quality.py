"""Quality scores: random-indexing word vectors pooled per document, then a small two-layer network.

Every token has a sparse random index vector; a word vector is the sum of the index vectors of its neighbours over
all documents. A document's features are mean and spread of its tokens' vectors. The network is trained with numpy
on a bounded sample of labelled rows, and a temperature makes its outputs probabilities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from .common import process_memo, stored
from .language import fold, spread_hash

#: Tokens are hashed into so many rows, vectors have so many dimensions, an index vector so many entries of +1 or -1.
TOKENS, DIMS, ENTRIES = 1 << 14, 32, 4
WINDOW = 2
REMEMBERED = 400_000
#: Tokens looked at together.
PIECE = 100_000
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
FEATURES = 2 * DIMS + 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs), each (TOKENS, ENTRIES)."""
    rng = np.random.default_rng(1999)
    return rng.integers(0, DIMS, (TOKENS, ENTRIES)), rng.choice([-1.0, 1.0], (TOKENS, ENTRIES))


def token_rows(text: str) -> np.ndarray:
    """Rows of the tokens of a whole text: words, numbers and runs of signs, in their case."""
    import xxhash

    known = process_memo("token_rows")
    tokens = TOKEN.findall(text)
    new = set(tokens).difference(known)
    if new:
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(tokens)
        for t in new:
            known[t] = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % TOKENS
    return np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit word vectors (TOKENS, DIMS) from the neighbours of all tokens of all rows of (text).

    Every task adds up its own sums; one row per token row and task moves, and the sums are added map-side again.
    """
    names = [f"v{i}" for i in range(DIMS)]

    def run(batches):
        positions, signs = index_vectors()
        sums = np.zeros(TOKENS * DIMS)

        def add(rows: np.ndarray, times: float = 1.0) -> None:
            for shift in range(1, WINDOW + 1):
                for here, there in ((rows[shift:], rows[:-shift]), (rows[:-shift], rows[shift:])):
                    real = (here >= 0) & (there >= 0)
                    here, there = here[real], there[real]
                    for e in range(ENTRIES):
                        np.add(sums, np.bincount(here * DIMS + positions[there, e], times * signs[there, e], TOKENS * DIMS), out=sums)

        gap = np.full(WINDOW, -1, np.int32)  # keeps documents apart
        waiting, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                rows = token_rows(text.as_py())
                # A very long text goes in pieces. The next one starts with the last rows of the one before, less their
                # mutual pairs, so that neighbours across the seam count once.
                for end in range(PIECE, len(rows) + PIECE, PIECE):
                    waiting.append(rows[end - PIECE:end])
                    size += len(waiting[-1])
                    if end >= len(rows):
                        waiting.append(gap)
                        size += WINDOW
                    if size >= PIECE:
                        add(np.concatenate(waiting))
                        waiting, size = [], 0
                        if end < len(rows):
                            waiting = [rows[max(0, end - WINDOW):end]]
                            add(waiting[0], -1.0)
        if waiting:
            add(np.concatenate(waiting))
        sums = sums.reshape(TOKENS, DIMS)
        where = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), *[pa.array(sums[where, i]) for i in range(DIMS)]], ["row", *names])

    added = (texts.mapInArrow(run, "row INT, " + ", ".join(f"{n} DOUBLE" for n in names))
             .groupBy("row").agg(*[F.sum(n).alias(n) for n in names]))
    out = np.zeros((TOKENS, DIMS))
    for row in added.collect():  # at most TOKENS rows
        out[row[0]] = row[1:]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the token vectors, the share of distinct tokens, and the logarithm of their number."""
    rows = token_rows(text)
    out = np.zeros(FEATURES, np.float32)
    if len(rows):
        total, squares = np.zeros(DIMS), np.zeros(DIMS)
        for at in range(0, len(rows), PIECE):
            v = vectors[rows[at:at + PIECE]].astype(float)
            total += v.sum(axis=0)
            squares += (v * v).sum(axis=0)
        mean = total / len(rows)
        out[:DIMS] = mean
        out[DIMS:2 * DIMS] = np.sqrt(np.maximum(squares / len(rows) - mean * mean, 0))
        out[-2] = len(np.unique(rows)) / len(rows)
        out[-1] = np.log1p(len(rows))
    return out


def featured(docs: DataFrame, vectors: np.ndarray, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``features`` (a column of that name is replaced); a null text is empty."""
    kept = docs.drop("features")

    def run(batches):
        for batch in batches:
            found = [pooled(t.as_py() or "", vectors).tobytes() for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "features"])

    return kept.mapInArrow(run, StructType(kept.schema.fields + [StructField("features", BinaryType())]))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.003, decay: float = 1e-4, seed: int = 5) -> Network:
    """A two-layer network by Adam on log loss; a fifth of the rows fits the temperature only."""
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0) + 1e-6
    net = Network(x.mean(axis=0), scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), 0.0)
    if len(set(y.tolist())) < 2:  # nothing to tell apart: the share of the only label, smoothed
        share = (y.sum() + 1) / (len(y) + 2)
        net.w2[:], net.b2 = 0, float(np.log(share / (1 - share)))
        return net
    order = rng.permutation(len(x))
    aside, learn = order[: len(x) // 5], order[len(x) // 5:]
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - net.mean) / net.scale
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
            a = np.tanh(z[rows] @ params[0] + params[1])
            g = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(g, params[2]) * (1 - a * a)
            t += 1
            for i, grad in enumerate((z[rows].T @ back + decay * params[0], back.sum(axis=0), a.T @ g + decay * params[2], np.array([g.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                params[i] -= rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    net.b2 = float(params[3][0])
    if len(aside):
        logits = net.logits(x[aside])
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, logits / s) - y[aside] * logits / s) for s in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = 20_000,
        parts: int = 5, held: int = 0) -> Network | None:
    """A network from labelled rows whose crc32 of the id, modulo ``parts``, is not ``held``; None without such rows.

    At most ``sample`` rows are taken, those whose ids hash below the share that gives about so many. Labels other than 0 and 1 teach nothing.
    """
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("y IN (0, 1)")
    joined = features.select(F.col(f"`{id_col}`").alias("id"), "features").where(fold("id", parts) != held).join(marks, "id")
    joined = stored(joined.select("y", "features", spread_hash("id").alias("h")).distinct(), "labelled")
    rows = joined.where(F.col("h") < F.lit(sample / max(1, joined.count()))).collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["y"], r["features"]))[:sample]
    if not rows:
        return None
    x = np.stack([np.frombuffer(r["features"], np.float32) for r in rows]).astype(float)
    return train(x, np.array([r["y"] for r in rows], float))


def fit_documents(docs: DataFrame, vectors: np.ndarray, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample: int = 20_000, **held) -> Network | None:
    """``fit`` for documents without features: they are made for the sampled ids only, by the same share of their hashes."""
    marks = labels.where(F.col(f"`{label_col}`").cast("int").isin(0, 1)).select(F.col(f"`{id_col}`").alias("id"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = rows.select("id").join(marks, "id").count()
    some = featured(rows.where(spread_hash("id") < F.lit(sample / max(1, n))), vectors)
    return fit(some, labels.withColumnRenamed(id_col, "id"), "id", label_col, sample, **held)


def scored(features: DataFrame, net: Network | None, threshold: float = 0.3) -> DataFrame:
    """All columns but ``features`` plus (score, predicted); without a network every score is 0.5.

    * null or empty text: scored by its features, which are zero
    * repeated rows: the same answer; empty table: no rows; columns of these two names are replaced
    """
    kept = features.drop("score", "predicted")

    def run(batches):
        for batch in batches:
            raw = batch.column("features").to_pylist()
            x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(float)
            score = net.scores(x) if net is not None and len(raw) else np.full(len(raw), 0.5)
            keep = [n for n in batch.schema.names if n != "features"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in keep], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    fields = [f for f in kept.schema.fields if f.name != "features"]
    return kept.mapInArrow(run, StructType(fields + [StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def scored_documents(docs: DataFrame, vectors: np.ndarray, net: Network | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``scored`` of ``featured`` documents in one step: features don't leave the task. Edge cases as there."""
    kept = docs.drop("score", "predicted")

    def run(batches):
        for batch in batches:
            x = np.array([pooled(t.as_py() or "", vectors) for t in batch.column(text_col)], float).reshape(batch.num_rows, FEATURES)
            score = net.scores(x) if net is not None and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             [*batch.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, StructType(kept.schema.fields + [StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
