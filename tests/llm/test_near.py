import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchflow.llm import common, forest, minhash, near_vectors
from matchflow.llm.components import components

from .conftest import ODD


def brute(rows, words, percent=80):
    """{id: (size, smallest id reached)} by plain sets; ids must be distinct."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_minhash_matches_brute_force(make_docs):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(25):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 7)):
            copy = [w if rng.random() > 0.02 else rng.choice(vocabulary) for w in text]
            rows.append((len(rows), " ".join(copy).title() if rng.random() < 0.3 else "\n".join(copy)))
    want = brute(rows, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_copies(make_docs(rows), words=4).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_minhash_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_copies(docs, words=4).collect()}
    assert got == want


def test_chain_and_large_bucket(make_docs, monkeypatch):
    # A chain of small steps is one component, also where a bucket is cut into blocks.
    monkeypatch.setattr(minhash, "BLOCK", 8)
    words = [f"a{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words[i] = f"b{i}"
        rows.append((100 - i, " ".join(words)))
    want = brute(rows, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_copies(make_docs(rows), words=4).collect()}
    assert got == want


def test_minhash_of_odd_documents(odd, none):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.near_copies(odd).collect())
    assert len(got) == len(ODD)
    assert [g for g in got if g[0] in "1 2 3"] == [(i, 0, i, True) for i in "123"]
    assert [g[2:] for g in got if g[0] in "4 5"] == [("4", True), ("4", False)]
    assert [g for g in got if g[0] == "6"] == [("6", 1, "6", True)] * 2
    assert all(g[2:] == ("None", True) for g in got if g[0] == "None")
    assert minhash.near_copies(none).count() == 0


def test_null_id_beside_a_copy_with_id(make_docs):
    rows = [(None, "the same five words here"), (3, "the same five words here")]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_copies(make_docs(rows)).collect()}
    assert got == {None: (3, False), 3: (3, True)}


def test_bitmap_of_keys_misses_none_and_few_others(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.col("id").alias("slot"))
    wanted = rows.where("id % 100 = 7 OR id IS NULL").select(F.col("id").alias("first_id"))
    got = common.with_hint(rows, "id", wanted, "first_id", "hint")
    assert got.columns == ["id", "slot", "hint"]
    assert got.count() == 40_000
    marked = {r["slot"] for r in got.where("hint").collect()}
    sure = {0} | {n for n in range(40_000) if n % 100 == 7}
    assert sure <= marked and len(marked) < len(sure) + 40
    assert common.perhaps_among(rows, "id", wanted.limit(0), "first_id").count() == 0


def test_only_members_of_surviving_pairs_get_their_sets_and_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    factors = minhash.multipliers(minhash.BANDS * minhash.ROWS)
    base = np.arange(1, 101, dtype=np.uint64)
    sets = {b"a": base, b"b": np.append(base[:90], np.arange(500, 505, dtype=np.uint64)), b"c": base}
    sets |= {b"x%d" % n: base * np.uint64(1000 * (n + 1)) for n in range(10)}
    sigs = {name: minhash.signature(s, factors) for name, s in sets.items()}
    shared = [n for n in range(minhash.BANDS) if (sigs[b"a"][n * 5:n * 5 + 5] == sigs[b"b"][n * 5:n * 5 + 5]).all()]
    assert len(shared) > 1
    rows = [(band, 5, name, b"a" if name == b"c" else name, bytearray(s.tobytes())) for name, s in sigs.items() for band in shared]
    members = spark.createDataFrame(rows, "band int, key long, class binary, component binary, signature binary")
    need = minhash.least_matches(0.8, 1e-4)
    near = minhash.likely_across(members, need)
    assert sorted((r["band"], bytes(r["class"])) for r in near.collect()) == [(shared[0], b"a"), (shared[0], b"b"), (shared[0], b"c")]
    texts = spark.createDataFrame([(bytearray(name), bytearray(np.sort(s).tobytes())) for name, s in sets.items()], "class binary, shingles binary")
    whole, some = ({frozenset((bytes(r["a"]), bytes(r["b"]))) for r in minhash.across(m.join(texts, "class"), need, 80).collect()} for m in (members, near))
    assert whole and some and all(b"b" in pair for pair in whole | some)


def test_pruning_table():
    need = minhash.least_matches(0.8, 1e-4)
    assert need[150] < 120 and need[30] < 24 and (np.diff(need) >= 0).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(90)]
    rng.shuffle(edges)
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a INT, b INT")).collect()}
    assert got == {i: find(i) for a, b in edges for i in (a, b) if a != b} | {i: find(i) for i in got}
    assert components(spark.createDataFrame([], "a INT, b INT")).count() == 0


def vectors_of(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dims))
    x = base[rng.integers(0, len(base), n)] + rng.standard_normal((n, dims)) * rng.uniform(0, 0.45, (n, 1))
    x[5] = x[6] = x[7]
    return x


@pytest.fixture(scope="module")
def bad_vectors():
    nan, inf = float("nan"), float("inf")
    return [(900, None), (901, [0.0] * 16), (902, [nan] * 16), (903, [inf] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, []), (906, [1.0, 2.0])]


def links_by_force(rows, cosine=0.9):
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    n, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (n[i], find(i), find(i) == i) for i in n}


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_match_brute_force(spark, bad_vectors, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors_of(3, 300))] + bad_vectors
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, class INT, list STRING")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df, recall=0.99999).collect()}
    assert got == links_by_force(rows)


def test_near_vectors_without_ids_repeated_and_empty(spark):
    kind = "vec_id BIGINT, embedding ARRAY<FLOAT>"
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, None), (None, [0.0, 1.0])], kind)
    got = sorted(map(str, (tuple(r) for r in near_vectors.near_vectors(df).collect())))
    assert got == sorted(map(str, [(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, True), (None, 0, None, True)]))
    assert near_vectors.near_vectors(spark.createDataFrame([], kind)).count() == 0


def test_plan_reaches_the_recall():
    # Pairs exactly at the threshold, by simulation.
    how = near_vectors.plan(2000, 0.9, 0.99)
    rng = np.random.default_rng(8)
    hits, trials = 0, 400
    for _ in range(trials):
        a = rng.standard_normal(32)
        b = rng.standard_normal(32)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        turn = np.linalg.qr(rng.standard_normal((32, 32)))[0]
        row, number, step = near_vectors.projected(np.stack([a, 0.9 * a + np.sqrt(0.19) * b]) @ turn, how)
        one, two = dict(zip(number[row == 0].tolist(), step[row == 0].tolist())), dict(zip(number[row == 1].tolist(), step[row == 1].tolist()))
        hits += sum(abs(one[k] - two[k]) <= how["window"] / near_vectors.STEP for k in one.keys() & two.keys()) >= near_vectors.COUNT
    assert hits / trials >= 0.97


def test_forest_recall_and_scores(spark, bad_vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors_of(5, 1500))] + bad_vectors
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, part STRING")
    got = forest.nearest(df, df.where("vec_id % 20 = 0"), k=10).collect()
    x = vectors_of(5, 1500)
    hits = total = 0
    for q in range(0, 1500, 20):
        score = x @ x[q]
        score[q] = -np.inf
        best = sorted(range(1500), key=lambda i: (-score[i], i))[:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        assert all(abs(r["score"] - x[q] @ x[r["vec_id"]]) < 1e-9 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(best))
        total += 10
    assert hits / total >= 0.9
    assert {r["query_id"] for r in got} == set(range(0, 1500, 20))


def test_forest_over_several_parts_few_rows_and_none(spark, monkeypatch):
    monkeypatch.setattr(forest, "PART_ROWS", 100)
    monkeypatch.setattr(forest, "QUERY_ROWS", 7)
    x = vectors_of(6, 400)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = forest.nearest(df, df.where("vec_id % 20 = 0"), k=5, sure=0.999).collect()
    hits = 0
    for q in range(0, 400, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-score)[:5].tolist()))
    assert hits >= 90
    few = forest.nearest(df.limit(3), df.limit(3), k=20).collect()
    assert len(few) == 6
    assert forest.nearest(df.limit(0), df, k=5).count() == 0
    twice = df.limit(4).unionByName(df.limit(1))
    assert {r["vec_id"] for r in forest.nearest(twice, df.limit(1), k=9).collect()} == {1, 2, 3}


@pytest.mark.parametrize("part_rows", [100, 16_384])
def test_forest_ties_go_to_the_smaller_id(spark, monkeypatch, part_rows):
    """Fifty equal vectors, nearest to the query, lie in several parts: the twenty smallest ids of them come, in order."""
    monkeypatch.setattr(forest, "PART_ROWS", part_rows)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 64))
    hot = x[20] * 1.5
    copies = sorted(rng.choice(np.arange(30, 900), 50, replace=False).tolist())
    x[copies] = hot
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id BIGINT, embedding ARRAY<DOUBLE>").repartition(6)
    got = sorted(forest.nearest(rows, rows.where("vec_id = 20"), 20).collect(), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in got] == copies[:20]
    assert len({r["score"] for r in got}) == 1
