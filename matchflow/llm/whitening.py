"""Whitening of embeddings through singular values of the bidiagonal form.

Tasks reduce their centred rows block by block to triangular factors, which are combined a few at a time to one. On
that small triangle Householder reflections from both sides leave a bidiagonal matrix, the dqds iteration finds its
singular values to high relative accuracy, and twisted factorisations of the shifted tridiagonal product give the
vectors. The covariance matrix itself is never formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .folding import folded

SCALE, SHIFT = 1024, 100_000
EPS = np.finfo(float).eps
#: Rows that are reduced at a time.
ROWS = 4096
#: Below this share of the greatest singular value a direction has no extent and can't be whitened.
NOTHING = 1e-12


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper off-diagonal, v): r = u b v.T with b upper bidiagonal; u is not kept."""
    a, d = r.copy(), r.shape[1]
    v = np.eye(d)

    def reflector(x):
        norm = np.sqrt(x @ x)
        w = x.copy()
        w[0] += norm if x[0] >= 0 else -norm
        size = w @ w
        return (w, 2 / size) if size > 0 else (w, 0.0)

    for k in range(d):
        w, scale = reflector(a[k:, k])
        a[k:, k:] -= scale * np.outer(w, w @ a[k:, k:])
        if k < d - 2:
            w, scale = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= scale * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= scale * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, falling, of the product of a bidiagonal matrix with its transpose, from its squared entries.

    Differential quotient-difference steps with shifts below the smallest eigenvalue; a step that turns out negative is
    taken again with a smaller shift, in the end without any, which cannot fail. Splits where an e is negligible.
    """
    q, e = q.astype(float).copy(), e.astype(float).copy()
    if not len(q):
        return q
    out = []
    stack = [(q, e, 0.0)]
    while stack:
        q, e, shifted = stack.pop()
        for _ in range(100 * len(q) + 100):
            n = len(q)
            if n == 1:
                out.append(q[0] + shifted)
                break
            # Splits: an entry that no longer changes its neighbours to working accuracy.
            small = np.flatnonzero(e <= EPS * EPS * (q[:-1] + shifted))
            if len(small):
                cut = int(small[-1]) + 1
                stack.append((q[:cut], e[:cut - 1], shifted))
                q, e = q[cut:], e[cut:]
                continue
            if e[-1] <= EPS * EPS * (shifted + q[-1]) or q[-1] + e[-1] <= EPS * 0.1 * shifted:
                out.append(q[-1] + shifted)
                q, e = q[:-1], e[:-1]
                continue
            if n == 2:
                # Two by two in closed form: trace and determinant of the product.
                t = ((q[0] - q[1]) + e[0]) / 2
                top = q[1] + e[0] / 2 + (q[0] - q[1]) / 2 + np.hypot(t, np.sqrt(e[0] * q[1]))
                low = q[0] * (q[1] / top) if top > 0 else 0.0
                out += [top + shifted, low + shifted]
                break
            guess = shift_of(q, e)
            for s in (guess, guess / 4, guess / 64, 0.0):
                new = step(q, e, s)
                if new is not None:
                    q, e = new
                    shifted += s
                    break
        else:
            raise RuntimeError("singular values have not settled")
    return np.sort(np.array(out))[::-1]


def shift_of(q: np.ndarray, e: np.ndarray) -> float:
    """A shift close to the smallest eigenvalue: that of the last two by two, less what couples it, or Newton's bound."""
    a, b, c = q[-2], e[-1], q[-1]
    t = (a + b + c) / 2
    low = a * c / (t + np.sqrt(max(0.0, t * t - a * c))) if t > 0 else 0.0
    # One zero-shift pass gives 1 / trace of the inverse, which is a sure lower bound.
    d, total = q[0], 1 / q[0] if q[0] > 0 else np.inf
    for k in range(len(q) - 1):
        top = d + e[k]
        if top <= 0:
            return 0.0
        d = q[k + 1] * (d / top)
        if d <= 0:
            return 0.0
        total += 1 / d
    sure = 1 / total
    return max(sure, min(low * 0.98, sure * len(q)) - e[-2] if low > 0 else 0.0) * (1 - 4 * EPS)


def step(q: np.ndarray, e: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One dqds step with shift ``s``; None where it isn't positive."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - s
    for k in range(n - 1):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        if new_q[k] <= 0:
            return None
        ratio = q[k + 1] / new_q[k]
        new_e[k] = e[k] * ratio
        d = d * ratio - s
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e


def twisted(q: np.ndarray, off: np.ndarray, diag: np.ndarray, value: float) -> list[tuple[float, np.ndarray]]:
    """Vectors of the tridiagonal b.T b near ``value``, best first: (residual against length, vector) by twist index.

    The stationary transform runs down, the progressive one up; where they meet, the vector's own entry is one and
    the rest follows from both factors without any subtraction.
    """
    n = len(q)
    tiny = np.finfo(float).tiny / EPS
    # b.T b = L D L.T with D = q and L's entries off / diag.
    ell = off / np.where(np.abs(diag[:-1]) > 0, diag[:-1], tiny)
    down_l, s = np.empty(n - 1), np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        plus = s[k] + q[k]
        if abs(plus) < tiny:
            plus = -tiny
        down_l[k] = q[k] * ell[k] / plus
        s[k + 1] = down_l[k] * ell[k] * s[k] - value
    up_u, p = np.empty(n - 1), np.empty(n)
    p[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        minus = q[k] * ell[k] * ell[k] + p[k + 1]
        if abs(minus) < tiny:
            minus = -tiny
        up_u[k] = ell[k] * q[k] / minus
        p[k] = p[k + 1] * (q[k] / minus) - value
    gamma = s + p + value
    found = []
    for r in np.argsort(np.abs(gamma))[:6]:
        z = np.zeros(n)
        z[r] = 1.0
        for k in range(r - 1, -1, -1):
            z[k] = -down_l[k] * z[k + 1]
        for k in range(r, n - 1):
            z[k + 1] = -up_u[k] * z[k]
        norm = np.sqrt(z @ z)
        if np.isfinite(norm):
            found.append((abs(gamma[r]) / norm, z / norm))
    return sorted(found, key=lambda f: f[0])


def right_vectors(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, right singular vectors as columns) of a small square matrix."""
    scale = np.abs(r).max() if r.size else 0.0
    if not scale > 0:
        return np.zeros(r.shape[1]), np.eye(r.shape[1])
    diag, off, v = bidiagonal(r / scale)
    d = len(diag)
    # Where the bidiagonal form falls apart, its pieces are worked off alone and their vectors are orthogonal as they are.
    top = max(np.abs(diag).max(), np.abs(off).max() if d > 1 else 0.0)
    cuts = [0, *[k + 1 for k in range(d - 1) if abs(off[k]) <= EPS * EPS * top or abs(diag[k]) <= EPS * EPS * top], d]
    values, vectors = [], []
    for a, b in zip(cuts, cuts[1:]):
        dd, oo = diag[a:b], off[a:b - 1]
        # A diagonal entry of zero takes its row's off-diagonal entry along to the next piece.
        carry = off[a - 1] if a and abs(diag[a - 1]) <= EPS * EPS * top else 0.0
        if abs(carry) > EPS * EPS * top:
            piece = np.vstack([np.eye(1, b - a) * carry, np.diag(dd) + np.diag(oo, 1)])
            small = np.linalg.qr(piece, mode="r")
            sub_diag, sub_off, sub_v = bidiagonal(small)
            found, z = piece_vectors(sub_diag, sub_off)
            z = sub_v @ z
        else:
            found, z = piece_vectors(dd, oo)
        for k in range(b - a):
            full = np.zeros(d)
            full[a:b] = z[:, k]
            values.append(found[k])
            vectors.append(full)
    order = np.argsort(-np.array(values), kind="stable")
    z = np.array(vectors)[order].T
    return np.sqrt(np.maximum(np.array(values)[order], 0)) * scale, v @ z


def piece_vectors(diag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, vectors) of b.T b for an unreduced bidiagonal b."""
    n = len(diag)
    if n == 1:
        return diag ** 2, np.ones((1, 1))
    q = diag ** 2
    values = dqds(q, off ** 2)
    z = np.zeros((n, n))
    for k in range(n):
        # Members of a cluster are made orthogonal to those before; where little is left of one, the next twist is taken.
        near = [j for j in range(k) if values[j] - values[k] <= 1e-3 * values[j]]
        best, left = None, -1.0
        for _, candidate in twisted(q, off, diag, values[k]):
            for _ in range(2):
                for j in near:
                    candidate = candidate - (z[:, j] @ candidate) * z[:, j]
            size = np.sqrt(candidate @ candidate)
            if size > left:
                best, left = candidate, size
            if left > 0.5:
                break
        if best is None or left < 1e-6:
            # Any direction that is orthogonal to the cluster and to all others so far, of vanishing extent.
            pick = np.eye(n) - z[:, :k] @ z[:, :k].T
            best = pick[:, int(np.argmax((pick ** 2).sum(axis=0)))]
            left = np.sqrt(best @ best)
        z[:, k] = best / left
    return values, z


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, size, x): rows whose vector is there and has finite entries only, as whole numbers."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where("v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda c: c.isNotNull() & (c == c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.coalesce(fine, F.lit(False))).select(
        "id", F.size("v").alias("size"), F.transform("v", lambda c: (F.floor(c * SCALE) + SHIFT).cast("long")).alias("x"))


def matrix(batch, column: str = "x") -> np.ndarray:
    return np.array(batch.column(column).flatten()).reshape(batch.num_rows, -1)


def by_size(batch):
    """The rows of a batch, apart for each number of components, in bounded slices."""
    sizes = np.array(batch.column("size"))
    for size in np.unique(sizes):
        some = batch if (sizes == size).all() else batch.filter(pa.array(sizes == size))
        for at in range(0, some.num_rows, ROWS):
            yield int(size), some.slice(at, ROWS)


def sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """{components: (n, exact sums)}, from partial sums of tasks that Spark adds up."""

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for size, part in by_size(batch):
                have = total.setdefault(size, [0, np.zeros(size, np.int64)])
                have[0] += part.num_rows
                have[1] += matrix(part).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()),
                                          pa.array([t[1].tolist() for t in total.values()], pa.list_(pa.int64()))], ["size", "n", "s"])

    parts = rows.select("size", "x").mapInArrow(run, "size INT, n BIGINT, s ARRAY<BIGINT>")
    each = parts.select("size", "n", F.posexplode("s").alias("at", "s")).groupBy("size", "at").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = each.groupBy("size").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "s"))).alias("s")).collect()
    return {r["size"]: (r["n"], np.array([x["s"] for x in r["s"]], np.int64)) for r in found}


def triangle_of(rows: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(rows, mode="r")
    return r if r.shape[0] == rows.shape[1] else np.vstack([r, np.zeros((rows.shape[1] - r.shape[0], rows.shape[1]))])


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - s / n, with one rounding only while n * x stays a whole number of 63 bits."""
    whole, rest = np.divmod(s, n)
    return (x - whole) - rest / n


def triangles(rows: DataFrame, totals: dict) -> dict[int, np.ndarray]:
    """{components: R}: R.T R is n times the covariance of the rows with that many components."""

    def run(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, part in by_size(batch):
                block = centred(matrix(part), *totals[size])
                have[size] = triangle_of(np.vstack([have[size], block]) if size in have else block)
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int64()), pa.array([r.tobytes() for r in have.values()], pa.binary())],
                                         ["key", "payload"])

    def combine(payloads):
        width = int(np.sqrt(len(payloads[0]) // 8))
        return triangle_of(np.vstack([np.frombuffer(p).reshape(-1, width) for p in payloads])).tobytes()

    found = folded(rows.select("size", "x").mapInArrow(run, "key BIGINT, payload BINARY"), combine).collect()
    return {r["key"]: np.frombuffer(r["payload"]).reshape(r["key"], -1) for r in found}


def fit(rows: DataFrame, most: int) -> dict[int, dict]:
    """{components: model} for the stored rows: n, sums, directions (columns), eigenvalues and shares of the trace."""
    totals = sums(rows)
    models = {}
    for size, r in triangles(rows, totals).items():
        n, s = totals[size]
        singular, v = right_vectors(r)
        values = singular ** 2 / n
        use = min(most, int((singular > NOTHING * max(singular[0], 1.0)).sum()))
        models[size] = {"n": n, "sums": s, "directions": v[:, :use], "values": values[:use],
                        "explained": values[:use] / max((r * r).sum() / n, np.finfo(float).tiny)}
    return models


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int]:
    """Sum over dimensions of (n x - s)^2, exactly; a value beyond 63 bits makes the job fail, it is not rounded."""
    far = float(np.abs(x).max(initial=0)) * n + float(np.abs(s).max(initial=0))
    whole = None if far >= 2.0 ** 62 else x * n - s
    if whole is not None and float(np.abs(whole).max(initial=0)) ** 2 * x.shape[1] < 2.0 ** 62:
        return (whole * whole).sum(axis=1).tolist()
    exact = x.astype(object) * int(n) - s.astype(object)
    return (exact * exact).sum(axis=1).tolist()


def whitened(vectors: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component from 1 to ``most``.

    * vectors that are null, empty or hold null or non-finite entries are dropped
    * vectors are fitted and whitened among those with the same number of components
    * null id: kept as null; repeated rows count and come out each; equal eigenvalues: any orthogonal directions among them
    * directions in which the vectors don't differ have no components (all vectors equal, or only one: no rows)
    * empty table: no rows; other columns are not looked at

    Only sums and triangles of the number of components reach the driver. ``identity_error`` is taken from the whitened
    values of all rows, centred before they are multiplied; it is the same for all rows of one number of components.
    """
    rows = stored(quantised(vectors, id_col, vector_col), "quantised")
    models = fit(rows, most)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for size, part in by_size(batch):
                m = models[size]
                x = matrix(part)
                w = centred(x, m["n"], m["sums"]) @ m["directions"] / np.sqrt(m["values"])
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("size"), pa.array(deviations(x, m["n"], m["sums"]), pa.int64()),
                    pa.array(list(w), pa.list_(pa.float64()))], ["id", "size", "deviation", "w"])

    done = stored(rows.mapInArrow(run, f"id {kind}, size INT, deviation BIGINT, w ARRAY<DOUBLE>"), "whitened")
    errors = identity_errors(done, {size: (m["n"], len(m["values"])) for size, m in models.items()})
    told = [(size, m["n"], k + 1, float(m["explained"][k]), errors[size]) for size, m in models.items() for k in range(len(m["values"]))]
    facts = done.sparkSession.createDataFrame(told, "size INT, n BIGINT, component INT, explained DOUBLE, identity_error DOUBLE")
    each = done.select(F.col("id").alias(id_col), "size", "deviation", F.posexplode("w").alias("at", "whitened"))
    each = each.withColumn("component", F.col("at") + 1)
    return each.join(F.broadcast(facts), ["size", "component"]).select(
        id_col, "component", "n", "deviation", "whitened", "explained", "identity_error")


def identity_errors(done: DataFrame, known: dict[int, tuple[int, int]]) -> dict[int, float]:
    """{components: largest absolute entry of the whitened values' covariance minus the identity}."""
    errors = {}
    for size, (n, count) in known.items():
        if not count:
            errors[size] = 0.0
            continue
        rows = done.where(F.col("size") == size)
        means = rows.agg(*[F.sum(F.get("w", F.lit(k))) for k in range(count)]).first()
        part = [F.get("w", F.lit(k)) - F.lit(means[k] / n) for k in range(count)]
        pairs = [(i, j) for i in range(count) for j in range(i + 1)]
        found = rows.agg(*[F.sum(part[i] * part[j]) for i, j in pairs]).first()
        errors[size] = max(abs(found[k] / n - (i == j)) for k, (i, j) in enumerate(pairs))
    return errors
