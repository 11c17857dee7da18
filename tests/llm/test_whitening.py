import math

import numpy as np
import pytest

from matchflow.llm import folding, queries, whitening

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>, id STRING, x INT, size STRING, n INT, w STRING, deviation STRING, component STRING, key INT"
CLASH = ("clash", 1, "clash", 1, "clash", "clash", "clash", 1)


def make(spark, rows):
    return spark.createDataFrame([(i, v) + CLASH for i, v in rows], SCHEMA)


def rotated(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return whitening.triangle_of(np.asarray(values, float)[:, None] * q)


RNG = np.random.default_rng(3)
MATRICES = {
    **{f"normal {d}": whitening.triangle_of(RNG.normal(size=(3 * d + 1, d))) for d in (1, 2, 3, 17, 96)},
    "identity": np.eye(9), "zero": np.zeros((5, 5)), "low rank": whitening.triangle_of(RNG.normal(size=(40, 3)) @ RNG.normal(size=(3, 16))),
    "equal values": rotated([9] * 6 + [5] * 6 + [1] * 8), "graded": rotated(np.logspace(0, -12, 30)), "close": rotated(1 + 1e-9 * np.arange(30)),
    "zero on the diagonal": np.diag(np.r_[np.ones(8), 0, np.ones(8)]) + np.diag(np.full(16, 0.5), 1),
    "nearly apart": np.diag(np.abs(np.arange(-10, 11)) + 1.0) + np.diag(np.full(20, 1e-3), 1),
    "columns twice": whitening.triangle_of(np.repeat(RNG.normal(size=(40, 9)), 2, axis=1)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_singular_values_and_vectors(name):
    r = MATRICES[name]
    values, v = whitening.right_vectors(r)
    want = np.linalg.svd(r, compute_uv=False)
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(len(v))).max() < 1e-10
    assert np.abs(r.T @ (r @ v) - v * values ** 2).max() <= 1e-12 * top ** 2


def test_small_values_are_relatively_accurate():
    """dqds keeps the relative accuracy of a graded bidiagonal; the product of all values is that of the diagonal."""
    diag, off = np.logspace(0, -40, 25), np.logspace(-1, -41, 24)
    found = whitening.dqds(diag ** 2, off ** 2)
    assert math.isclose(np.log(found).sum(), 2 * np.log(diag).sum(), rel_tol=1e-12)
    assert found[-1] > 0


def direct(rows, most=8):
    """{row number: values} in plain double precision, and the shares of the trace."""
    x = np.floor(np.array([v for _, v in rows]) * 1024) + 100_000
    c = x - x.mean(axis=0)
    values, v = np.linalg.eigh(c.T @ c / len(x))
    order = np.argsort(-values)[:most]
    return x.astype(int), c @ v[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def compared(rows, got):
    x, w, explained = direct(rows)
    n, s = len(rows), x.sum(axis=0)
    by_key = {(r["vec_id"], r["component"]): r for r in got}
    assert len(by_key) == len(got) == n * w.shape[1]
    for k in range(w.shape[1]):
        mine = np.array([by_key[i, k + 1]["whitened"] for i, _ in rows])
        sign = np.sign(mine @ w[:, k])
        assert np.abs(mine * sign - w[:, k]).max() < 1e-8
    for (i, _), row in zip(rows, x):
        r = by_key[i, 1]
        assert (r["n"], r["deviation"]) == (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)))
        assert r["identity_error"] < 1e-9
    assert all(math.isclose(by_key[rows[0][0], k + 1]["explained"], explained[k], rel_tol=1e-9) for k in range(w.shape[1]))


def test_whole_table_against_eigenvectors(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
            if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    compared(rows, queries.op12_whitening(spark, folder).collect())


def test_parts_and_sizes(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=12) * np.arange(1, 13)).tolist()) for k in range(300)]
    others = [(1000 + k, rng.normal(size=3).tolist()) for k in range(40)]
    got = whitening.whitened(make(spark, rows + others).repartition(37)).collect()
    compared(rows, [r for r in got if r["vec_id"] < 1000])
    compared(others, [r for r in got if r["vec_id"] >= 1000])


def test_edges(spark):
    good = [(k, [float(k), float(k * k % 7), 1.0]) for k in range(10)]
    odd = [(20, None), (21, []), (22, [1.0, None, 2.0]), (23, [1.0, float("nan"), 2.0]), (24, [1.0, float("inf"), 2.0])]
    got = whitening.whitened(make(spark, good + odd + [(None, [3.0, 3.0, 1.0]), (3, [3.0, 2.0, 1.0])])).collect()
    # The third component is the same for all rows, so there are two directions.
    assert sorted({r["component"] for r in got}) == [1, 2] and len(got) == 24
    assert sum(r["vec_id"] is None for r in got) == 2 and sum(r["vec_id"] == 3 for r in got) == 4
    assert whitening.whitened(make(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    assert whitening.whitened(make(spark, [])).count() == 0


def test_exact_deviations_beyond_63_bits():
    x = np.array([[10 ** 9, 5]], np.int64)
    assert whitening.deviations(x, 10 ** 6, np.array([7, 7])) == [(10 ** 15 - 7) ** 2 + (5 * 10 ** 6 - 7) ** 2]


def test_folding_in_rounds(spark):
    parts = spark.createDataFrame([(k % 3, k.to_bytes(4, "little")) for k in range(100)], "key BIGINT, payload BINARY").repartition(7)
    add = lambda ps: sum(int.from_bytes(p, "little") for p in ps).to_bytes(4, "little")
    got = {r["key"]: int.from_bytes(r["payload"], "little") for r in folding.folded(parts, add, fan_in=3).collect()}
    assert got == {k: sum(range(k, 100, 3)) for k in range(3)}
    assert folding.folded(parts.limit(0), add).count() == 0
