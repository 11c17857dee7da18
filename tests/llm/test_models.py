import random
import zlib

import numpy as np
import pytest

from matchflow.llm import language, quality

from .conftest import ODD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def crc(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_language_on_held_out_rows(spark, docs):
    model = language.fit(docs, per_label=100)
    rows = language.predicted(docs, model).collect()
    held = [r for r in rows if crc(r["doc_id"], 4) == 2]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    # Sparse by its penalty, and calibrated: the mean score is near the share of right answers.
    assert 0 < np.count_nonzero(model.weights) < 0.5 * model.weights.size
    assert abs(np.mean([r["score"] for r in held]) - np.mean([r["lang_pred"] == r["lang"] for r in held])) < 0.05


def test_fold_is_the_given_one(spark, docs):
    got = docs.select("doc_id", language.fold("doc_id", 4).alias("f")).collect()
    assert all(r["f"] == crc(r["doc_id"], 4) for r in got)


def test_held_out_rows_teach_nothing(make_docs):
    ids = [i for i in range(60) if crc(i, 4) == 2][:5] + [i for i in range(60) if crc(i, 4) != 2][:20]
    rows = [(i, "la la le lu " * 5 if crc(i, 4) == 2 else "the and of it " * 5, "xx" if crc(i, 4) == 2 else "en") for i in ids]
    assert language.fit(make_docs(rows)).labels == ["en"]


def test_odd_texts(odd, none, make_docs):
    model = language.fit(make_docs([(i, t, l) for i in range(40) for t, l in [("the cat and the dog", "en") if i % 2 else ("der hund und die katze", "de")]]))
    got = language.predicted(odd, model).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in model.labels
    assert set(odd.columns) <= set(language.predicted(odd, model).columns)
    empty = language.fit(none)
    assert empty.labels == [] and language.predicted(none, empty).count() == 0
    assert {r["lang_pred"] for r in language.predicted(odd, empty).collect()} == {"und"}


def plain_counts(text):
    text = " " + language.NO_LETTERS.sub(" ", text.lower()).strip() + " "
    return sum(max(0, len(text) - k) for k in range(3))


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_pieces_of_long_texts_lose_nothing(monkeypatch, piece):
    text = "Über die Straße, 12 times and again; " * 30
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "PIECE", piece)
    where, counts = language.ngram_counts(text)
    assert (where == whole[0]).all() and (counts == whole[1]).all() and counts.sum() == plain_counts(text)


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 1.5, (4000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(language.fit_temperature(3 * z, y) - 3) < 0.3


def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    vectors = quality.word_vectors(docs.select("text"))
    rows = quality.featured(docs, vectors)
    net = quality.fit(rows, labels)
    got = {r["doc_id"]: r for r in quality.scored(rows, net).collect()}
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if crc(r["doc_id"], 5) == 0]
    good, poor = [g["score"] for g, q in held if q == 1], [g["score"] for g, q in held if q == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in poor])
    assert auc >= 0.9
    assert all(g["predicted"] == int(g["score"] >= 0.3) for g in got.values())


def test_word_vectors_are_sums_of_neighbours(spark):
    texts = ["a b c a", "b b", "", "c"]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text STRING"))
    positions, signs = quality.index_vectors()
    want = np.zeros((quality.TOKENS, quality.DIMS))
    for t in texts:
        rows = quality.token_rows(t)
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                if i != j and abs(i - j) <= quality.WINDOW:
                    np.add.at(want[a], positions[b], signs[b])
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, norm, out=np.zeros_like(want), where=norm > 0)
    assert np.abs(got - want).max() < 1e-6


def test_pooling_in_pieces(monkeypatch):
    vectors = np.random.default_rng(1).standard_normal((quality.TOKENS, quality.DIMS)).astype(np.float32)
    text = " ".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    whole = quality.pooled(text, vectors)
    monkeypatch.setattr(quality, "PIECE", 33)
    assert np.abs(quality.pooled(text, vectors) - whole).max() < 1e-4


def test_quality_of_odd_texts(spark, odd, none):
    kind = "doc_id BIGINT, quality INT, features STRING"
    vectors = quality.word_vectors(odd.selectExpr("coalesce(text, '') AS text"))
    rows = quality.featured(odd, vectors)
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (4, None, "x"), (6, 7, "x"), (None, 1, "x"), (8, 1, "x")], kind)
    got = quality.scored(rows, quality.fit(rows, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.scored(rows, quality.fit(rows, labels.limit(0))).collect()} == {0.5}
    assert quality.scored(quality.featured(none, vectors), None).count() == 0
    assert not quality.word_vectors(none.selectExpr("coalesce(text, '') AS text")).any()


def test_one_label_only():
    x = np.random.default_rng(1).standard_normal((30, quality.FEATURES))
    assert (quality.train(x, np.ones(30)).scores(x) > 0.9).all()


@pytest.mark.parametrize("piece", [1, 3, 7])
def test_word_vectors_in_pieces(spark, monkeypatch, piece):
    """Neighbours across the seams of a long text count as within it, and texts stay apart."""
    texts = spark.createDataFrame([("a b c d e f g h i j k l m n o p q r s t u v w",), ("x a y",), ("",), ("z",), ("b c d e f g h",)], "text STRING").coalesce(1)
    whole = quality.word_vectors(texts)
    monkeypatch.setattr(quality, "PIECE", piece)
    assert np.abs(whole).sum() > 0 and np.array_equal(quality.word_vectors(texts), whole)
