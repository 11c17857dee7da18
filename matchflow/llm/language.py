"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into a fixed number of features. Document frequencies are counted over
all rows of the learning fold; the weights are trained on a bounded sample of it with
follow-the-regularised-leader and elastic-net penalties, which leaves most of them zero; a temperature fitted on a
part of the sample that training hasn't seen calibrates the probabilities.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import process_memo, trim_memory

FEATURES = 1 << 15
UNKNOWN = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")
#: Characters looked at in one piece; a longer text is counted piece by piece, whole.
PIECE = 1 << 20


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of a whole text, lower case, with every run of other than letters as one blank."""
    text = " " + NO_LETTERS.sub(" ", text.lower()).strip() + " "
    total = None
    for at in range(0, len(text), PIECE):
        # Two characters of the piece before belong to the n-grams that end in this one.
        back = min(at, 2)
        c = np.frombuffer(text[at - back:at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        parts = [one[back:], two[max(0, back - 1):], three]
        codes = np.concatenate([(x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17) for x in parts])
        some = np.bincount(codes, minlength=FEATURES)
        total = some if total is None else total + some
    where = np.flatnonzero(total)
    return where, total[where]


def has_letter(text: str | None) -> bool:
    """Whether a letter is anywhere in the text."""
    return text is not None and any(m[0].isalpha() for m in LETTER.finditer(text))


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray  # float32, by feature
    weights: np.ndarray  # float32, (feature, label)
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[where]
        norm = np.sqrt((x * x).sum())
        return x / norm if norm else x

    def logits(self, where: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(where, counts) @ self.weights[where] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*ngram_counts(text)) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], model: LanguageModel, epochs: int = 3, alpha: float = 0.5,
          beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> None:
    """Follow-the-regularised-leader with a learning rate per coordinate; the bias is not penalised by l1."""
    k = len(model.labels)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
    rng = np.random.default_rng(seed)

    def weights(zi, ni, penalty):
        return np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for s in rng.permutation(len(samples)):
            where, counts, y = samples[s]
            rows = np.append(where, FEATURES)
            x = np.append(model.vector(where, counts), 1.0)
            zi, ni = z[rows], n[rows]
            w = weights(zi, ni, l1)
            w[-1] = weights(zi[-1], ni[-1], 0.0)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[rows] = zi + g - sigma * w
            n[rows] = ni + g * g
    w = weights(z, n, l1)
    w[-1] = weights(z[-1], n[-1], 0.0)
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the smallest log loss, by golden section on its logarithm."""
    def loss(t):
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean()

    low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def fold(id_col: str, parts: int) -> F.Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % parts


def spread_hash(id_col: str) -> F.Column:
    """The id's hash as a number from 0 to 1."""
    return F.expr(f"CAST(shiftrightunsigned(xxhash64({id_col}), 11) AS DOUBLE) / {float(1 << 53)}D")


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents by feature, documents) over all rows of (text); one row per feature and task moves."""

    def run(batches):
        process_memo("language")  # what other operators have left in this worker goes
        df = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                df[ngram_counts(text.as_py())[0]] += 1
                df[FEATURES] += 1
        where = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(df[where])], ["feature", "n"])

    counted = texts.mapInArrow(run, "feature INT, n BIGINT").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(FEATURES + 1, np.int64)
    for feature, n in counted.collect():  # at most FEATURES + 1 rows
        out[feature] = n
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, per_label: int = 600, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        parts: int = 4, held: int = 2) -> LanguageModel:
    """A model from the rows whose crc32 of the id, modulo ``parts``, is not ``held``.

    The sample takes at most ``per_label`` documents of every label, whole: those whose ids hash below the share that gives
    about so many.
    Rows without id, text, letter or label teach nothing. Without any labelled row the model has no labels.
    """
    rows = docs.where(fold(id_col, parts) != held).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label"))
    rows = rows.where("text IS NOT NULL AND label IS NOT NULL AND id IS NOT NULL")
    df, n = document_frequencies(rows.select("text"))
    share = F.lit(0.0)
    for label, m in rows.groupBy("label").count().collect():  # as many rows as there are labels
        share = F.when(F.col("label") == label, F.lit(per_label / m)).otherwise(share)
    # A repeated id is one document of the sample, however often it is there.
    picked = rows.withColumn("h", spread_hash("id")).where(F.col("h") < share).dropDuplicates(["id", "label"])

    def run(batches):
        for batch in batches:
            keep = [i for i, t in enumerate(batch.column("text")) if has_letter(t.as_py())]
            found = [ngram_counts(batch.column("text")[i].as_py()) for i in keep]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(pa.array(keep, pa.int64())) for c in ("label", "h")],
                pa.array([w.astype("<i4").tobytes() for w, _ in found], pa.binary()),
                pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], ["label", "h", "where", "counts"])

    found = picked.select("label", "h", "text").mapInArrow(run, "label STRING, h DOUBLE, where BINARY, counts BINARY").collect()
    found = sorted(found, key=lambda r: (r["label"], r["h"], r["where"]))
    sample = [r for _, own in itertools.groupby(found, key=lambda r: r["label"]) for r in itertools.islice(own, per_label)]
    labels = sorted({r["label"] for r in sample})
    idf = np.log((1 + n) / (1 + df)) + 1
    model = LanguageModel(labels, idf.astype(np.float32), np.zeros((FEATURES, len(labels)), np.float32), np.zeros(len(labels)))
    if not labels:
        return model
    data = [(np.frombuffer(r["where"], "<i4"), np.frombuffer(r["counts"], "<i4"), labels.index(r["label"])) for r in sample]
    aside, learn = data[::5], [d for i, d in enumerate(data) if i % 5]
    train(learn or data, model)
    model.temperature = fit_temperature(np.array([model.logits(w, c) for w, c, _ in aside]), np.array([y for *_, y in aside]))
    return model


def predicted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus (lang_pred, score), nothing but the text being looked at.

    * null text or no letter: ``und`` with score 0; a model without labels: ``und``
    * repeated rows: the same answer; empty table: no rows; very long texts are taken whole
    * columns of these two names are replaced
    """
    kept = docs.drop("lang_pred", "score")

    def run(batches):
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])
        trim_memory()

    return kept.mapInArrow(run, StructType(kept.schema.fields + [StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
