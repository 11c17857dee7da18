import random

import pytest
from pyspark.sql import functions as F

from matchflow.operators import text as ops


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def damaged(rng, word, n):
    for _ in range(n):
        i = rng.randrange(len(word) + 1)
        word = rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice("abc") + word[i:], word[:i] + rng.choice("abc") + word[i + 1:]])
    return word


@pytest.mark.parametrize("most", [1, 2])
def test_near_words_are_all_those_at_the_distance(spark, most):
    rng = random.Random(most)
    firsts = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([1, 2, 4, 7, 8, 9, 14]))) for _ in range(120)})
    words = sorted({damaged(rng, w, rng.randrange(4)) for w in firsts for _ in range(4)} - {""})
    allowed = {f: min(most, len(f) // 3) for f in firsts}
    got = ops.near_words(spark.createDataFrame([(w,) for w in words], "word string"),
                         spark.createDataFrame(list(allowed.items()), "first string, allowed int"), most)
    want = {(w, f) for w in words for f in firsts if distance(w, f) <= allowed[f]}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def brute(texts, names, most):
    out = {}
    for key, words in texts:
        hits = []
        for name in names:
            phrase = name.split()
            for pos in range(len(words) - len(phrase) + 1):
                edits = sum(distance(x, y) for x, y in zip(words[pos:], phrase))
                if edits <= min(most, len(name) // 4):
                    hits.append((pos, edits, -len(name), name))
        if hits:
            out[key] = min(hits)[3]
    return out


def test_mentions_against_brute_force(spark):
    rng = random.Random(5)
    names = ["acme", "acme tools", "north wind", "north winds", "old oak house", "abc", "extraordinary"]
    texts = []
    for key in range(150):
        words = [rng.choice(["the", "and", "acre", "abd", "nor"]) for _ in range(rng.randrange(4))]
        for part in rng.choice(names).split():
            words.append(damaged(rng, part, rng.randrange(3)) or "x")
        texts.append((key, words + ["by", "abc"][:rng.randrange(3)]))
    docs = spark.createDataFrame([(k, ", ".join(w), "x") for k, w in texts], "id long, body string, name string")
    known = spark.createDataFrame([(n, 1) for n in names], "name string, word int")
    for most in (0, 1, 2):
        got = {r.id: r.name for r in ops.misspelt_mentions(docs, known, "id", "body", distance=most).collect()}
        assert got == brute(texts, names, most)
    exact = {r.id: r.name for r in ops.first_mentions(docs, known, "id", "body").collect()}
    assert {r.id: r.name for r in ops.misspelt_mentions(docs, known, "id", "body", distance=0).collect()} == exact


def test_odd_texts(spark):
    long = "word " * 50_000 + "Acmee Tols " + "z" * 100_000
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, long), (None, "acme toools"), (5, "ACME Tols"), (5, "Acme Toolz"), (6, "acm tol")], "id long, body string")
    names = spark.createDataFrame([("Acme Tools",), ("ACME tools",), (None,), ("",), ("--",)], "name string")
    got = sorted(map(tuple, ops.misspelt_mentions(docs, names, "id", "body").collect()), key=str)
    assert got == [(4, "ACME tools"), (5, "ACME tools"), (6, "ACME tools")][:2] + [(None, "ACME tools")]
    assert ops.misspelt_mentions(docs, names.limit(0), "id", "body").count() == 0
    assert ops.misspelt_mentions(docs.limit(0), names, "id", "body").count() == 0
    with pytest.raises(ValueError):
        ops.misspelt_mentions(docs, names, "id", "body", distance=3)


def test_gaps_are_filled_in_spite_of_errors(spark):
    docs = spark.createDataFrame([(1, "made by Acme Tols in Slaem Town", None, None), (2, "Acme Tools", "Kept", None)], "id long, description string, company string, location string")
    orgs, places = spark.createDataFrame([("Acme Tools",)], "name string"), spark.createDataFrame([("Salem Town",)], "name string")
    filled = lambda **how: [tuple(r) for r in ops.fill_from_gazetteer(docs, orgs, places, **how).select("company", "location").orderBy("id").collect()]
    assert filled(distance=2) == [("Acme Tools", "Salem Town"), ("Kept", None)]
    assert filled() == [(None, None), ("Kept", None)]
    assert filled(distance=2, chars=12) == [(None, None), ("Kept", None)]
    assert docs.where(F.col("id") == 1).count() == 1
