import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchflow.llm import language, language_model as lm, queries

from .conftest import ODD


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def counted(rows):
    """{id: what must come out} without the model's score, and N."""
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in rows if not out_of(i) for w in words_of(t))
    n, v = sum(c.values()), len(c)
    return [(i, out_of(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
            for i, t in rows for ws in [words_of(t)]]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *map(float, r[2:6]))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want))


def scores(docs, **options):
    return lm.corpus_scores(docs, held_out=language.fold("doc_id", 10) == 0, **options)


def test_counts_and_base_on_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_language_model(spark, folder).collect()
    same(got, counted(rows))
    left = [r for r in got if r["held_out"]]
    # The model must tell more of unseen texts than word counts do.
    assert sum(r["score"] for r in left) > sum(r["base_score"] for r in left)
    assert all(r["score"] < 0 for r in got)


@pytest.fixture
def small(monkeypatch):
    """Few words with ids and few with known counts, so that all kinds of words and the join are used."""
    monkeypatch.setattr(lm, "HEAD", 12)
    monkeypatch.setattr(lm, "KNOWN", 30)


def sentences(n, seed=4):
    rng = random.Random(seed)
    kinds = [[f"{p}{k}" for k in range(60)] for p in ("a", "B", "c")]
    return [(k, " ".join(rng.choice(kinds[k % 3][:rng.choice([5, 20, 60])]) for _ in range(rng.randint(0, 60)))) for k in range(n)]


def test_rare_words_by_join(spark, make_docs, small):
    rows = sentences(300) + [(1001, "never-seen words here"), (1002, "")]
    same(scores(make_docs(rows).repartition(5)).collect(), counted(rows))


def test_probabilities_sum_to_one():
    """Over all outcomes after one context."""
    counts = np.array([5.0, 9, 4, 4, 2, 1])
    model = lm.Model(counts, 3.3, np.array([1, 1, 2, 15, 2]))
    model.weights = [np.random.default_rng(k).normal(size=w.shape).astype(np.float32) for k, w in enumerate(model.weights)]
    total = 0.0
    for w in range(7):
        flat = np.array([3, 4, w], np.uint16)
        total += math.exp(model.log_probabilities(flat, np.array([0]))[-1])
    assert abs(total - 1) < 1e-5


def test_training_learns_what_follows(spark, make_docs):
    """Two sorts of texts that alternate in their own way: unseen ones of the same sorts become likelier than by counts."""
    rows = [(k, " ".join(("red blue " if k % 2 else "one two ") * 30)) for k in range(400)]
    got = scores(make_docs(rows).repartition(3)).collect()
    left = [r for r in got if r["held_out"]]
    assert left and all(r["score"] > 0.7 * r["base_score"] for r in left)


def test_text_starts_do_not_see_the_text_before(monkeypatch):
    model = lm.Model(np.ones(6), 1.0, np.array([1, 2, 3, 4, 5]))
    model.weights = [np.random.default_rng(k).normal(size=w.shape).astype(np.float32) for k, w in enumerate(model.weights)]
    texts = [[2, 3, 4, 1], [1], [5, 1], [1], [6, 2, 2, 2, 1]]
    alone = np.concatenate([model.log_probabilities(np.array(t, np.uint16), np.array([0])) for t in texts])
    starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
    assert np.allclose(alone, model.log_probabilities(np.array(sum(texts, []), np.uint16), starts))


def test_pieces_end_at_white_space(monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 7)
    text = b"a bb  ccc\tdddd eeeeeeeeeeeeeeeeeeeeee f\n"
    assert [w for p in lm.pieces(text) for w in p.split()] == text.split()
    assert list(lm.pieces(b"")) == []


def test_edges(make_docs, odd, none, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 1000)
    same(scores(odd).collect(), counted([r[:2] for r in ODD]))
    assert scores(none).count() == 0
    unlearned = lm.corpus_scores(make_docs([(1, "a b"), (2, None)]), held_out=F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in unlearned] == [(0, 0, 0, 0)] * 2
    every = lm.corpus_scores(make_docs([(1, "a b a"), (2, None)])).collect()
    assert {r["n_known"] for r in every} == {4, 1} and all(r["train_tokens"] == 5 for r in every)
