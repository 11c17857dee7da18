"""Vectors: encoding texts, keeping section vectors fresh, exact nearest neighbours at scale."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_blank
from ..functions.vectors import dot
from ..sources.tables import settle

Encoder = Callable[[list[str]], np.ndarray]

# --- encoding --------------------------------------------------------------------------------------


def fit_encoder(df: DataFrame, text: str, dims: int = 384) -> PipelineModel:
    """Hashed term frequencies, weighted by document frequency, at unit length."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(df.filter(~is_blank(F.col(text))))


def vectorise(df: DataFrame, text: str, encoder: PipelineModel | Encoder, out: str = "embedding",
              dims: int = 384) -> DataFrame:
    """Adds a unit vector per non-blank text and the zero vector for a blank one.

    ``encoder`` is a fitted ``fit_encoder`` pipeline, or a function from a list of texts to a
    matrix, called once per Arrow batch (a model it holds is loaded once per Python worker).
    """
    zero = F.array_repeat(F.lit(0.0), dims).cast("array<float>")
    blank = is_blank(F.col(text))
    if isinstance(encoder, PipelineModel):
        filled = df.withColumn(text, F.coalesce(text, F.lit("")))
        made = encoder.transform(filled).withColumn(out, vector_to_array("_unit", "float32"))
        return made.withColumn(out, F.when(blank, zero).otherwise(F.col(out))).select(*df.columns, out)

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType(), False))])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            full = pdf[text].fillna("").str.strip() != ""
            rows = np.zeros((len(pdf), dims), dtype=np.float32)
            if full.any():
                raw = np.asarray(encoder(pdf.loc[full, text].tolist()), dtype=np.float64)
                length = np.linalg.norm(raw, axis=1, keepdims=True)
                rows[full.to_numpy()] = raw / np.where(length == 0, 1, length)
            pdf[out] = list(rows)
            yield pdf

    return df.mapInPandas(encode, schema)


def refresh_vectors(sections: DataFrame, store: DataFrame, encode: Callable[[DataFrame], DataFrame],
                    now: Column | None = None) -> DataFrame:
    """Section vectors after a change of the profiles.

    ``sections``: profile_id, section_type, section_index, content, content_hash. Only sections
    that are new or changed are encoded; unchanged vectors are kept, those of sections that are
    gone are dropped. ``encode`` adds ``embedding`` to its input from ``content``.
    """
    keys = ["profile_id", "section_type", "section_index", "content_hash"]
    same = store.join(sections.select(*keys), keys, "left_semi")
    todo = sections.join(store.select(*keys), keys, "left_anti")
    stamp = F.current_timestamp() if now is None else now
    made = encode(todo).select(*keys, "embedding", stamp.alias("created_at"))
    return same.select(*keys, "embedding", "created_at").unionByName(made)


# --- pairs -------------------------------------------------------------------------------------------


def cosine_pairs(pairs: DataFrame, a: str, b: str, out: str = "score") -> DataFrame:
    """Adds the cosine of two unit-vector columns; 0 when either is all zeros."""
    return pairs.withColumn(out, dot(F.col(a), F.col(b)))


# --- nearest neighbours ---------------------------------------------------------------------------------
#
# Vectors are split into cells around pivots. A query has to look only into cells that can hold a
# hit: no member of a cell is closer to the query than the angle to the pivot minus the cell's
# radius (triangle inequality on the sphere). The answer is exact; the cells only save work. Cells
# are dealt to tiles of bounded size, large ones to several, small ones together. Queries and
# vectors meet per (tile, query tile), so a row moves once per tile and not once per cell; a task
# works on a bounded number of similarities at a time, and what leaves it is reduced to k rows per
# query and tile.

BLOCK_ROWS = 4096
MAX_PIVOTS = 256
#: Rows of a tile at most, and numbers in its vectors.
TILE_ROWS = 16_384
TILE_CELLS = 1 << 22
#: Cells of one tile: a query says in one long which of them it looks into.
PLACES = 62
#: Similarities a task works on at a time.
SIMS = 1 << 20
#: Below any floor: the similarity in cells that a query doesn't look into.
_OUT = -3.0
_EPS = 2e-6


def _unit(rows) -> np.ndarray:
    m = np.stack(rows).astype(np.float64) if len(rows) else np.zeros((0, 1))
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def _pivots(vectors: DataFrame, key: str, column: str, n: int) -> np.ndarray:
    """``n`` vectors chosen by a hash of their key: a bounded number of rows on the driver."""
    usable = vectors.filter(F.exists(column, lambda x: x != 0)).select(key, column)
    rows = usable.orderBy(F.xxhash64(key), key).limit(n).collect()
    return _unit([r[column] for r in rows])


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _with_cells(vectors: DataFrame, key: str, column: str, pivots: np.ndarray) -> DataFrame:
    """(key, column, cell, angle): nearest pivot; zero vectors go to cell -1."""
    kind = vectors.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units = _unit(pdf[column].to_list())
            usable = len(pdf) and units.shape[1] == pivots.shape[1]
            angles = _angles(units, pivots) if usable else np.zeros((len(pdf), 1))
            cell = angles.argmin(axis=1)
            yield pd.DataFrame({
                key: pdf[key],
                column: pdf[column],
                "cell": np.where(units.any(axis=1), cell, -1).astype(np.int32),
                "angle": angles.min(axis=1),
            })

    return vectors.select(key, column).mapInPandas(
        assign, f"{key} {kind}, {column} array<float>, cell int, angle double")


class _Cells:
    """Vectors in cells of bounded blocks, with what is needed to rule cells out."""

    def __init__(self, vectors: DataFrame, key: str, column: str, block_rows: int):
        total = vectors.count()
        wanted = int(min(MAX_PIVOTS, max(1, np.ceil(total / block_rows))))
        self.key, self.column, self.block_rows = key, column, block_rows
        self.pivots = _pivots(vectors, key, column, wanted)
        if not len(self.pivots):
            self.pivots = np.zeros((1, 1))
            self.rows, self.sizes, self.radius = None, {}, {}
            return
        placed = _with_cells(vectors, key, column, self.pivots)
        self.rows = settle(placed) if wanted > 1 else placed
        stats = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect()
        self.sizes = {r["cell"]: r["n"] for r in stats}
        self.radius = {r["cell"]: r["r"] for r in stats}

    def tiles(self) -> dict[int, tuple[int, int, int]]:
        return _dealt(self.sizes, _tile_rows(sum(self.sizes.values()), self.block_rows, self.pivots.shape[1]))

    def tiled(self) -> DataFrame:
        """(v_id, v_vec, v_tile, v_place)"""
        tiles = self.tiles()
        place = F.create_map(*[F.lit(x) for c, (_, _, p) in tiles.items() for x in (c, p)])
        return self.rows.select(
            F.col(self.key).alias("v_id"), F.col(self.column).alias("v_vec"), _tile_of(tiles, self.key).alias("v_tile"),
            place[F.col("cell")].alias("v_place"))


def _tile_rows(total: int, block_rows: int, dims: int) -> int:
    """Rows of a tile: a few tiles for small tables, a bounded size for large ones."""
    return int(min(TILE_ROWS, max(1, TILE_CELLS // dims), max(block_rows, -(-total // 8))))


def _dealt(sizes: dict[int, int], rows: int) -> dict[int, tuple[int, int, int]]:
    """cell -> (first tile, number of tiles, place within the tile)."""
    out, tile, held, place = {}, 0, 0, 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if place and (held + n > rows or place == PLACES):
            tile, held, place = tile + 1, 0, 0
        count = max(1, -(-n // rows))
        out[cell] = (tile, count, place)
        if count > 1:
            tile, held, place = tile + count, 0, 0
        else:
            held, place = held + n, place + 1
    return out


def _tile_of(tiles: dict[int, tuple[int, int, int]], key: str) -> Column:
    first = F.create_map(*[F.lit(x) for c, (t, _, _) in tiles.items() for x in (c, t)])
    count = F.create_map(*[F.lit(x) for c, (_, n, _) in tiles.items() for x in (c, n)])
    return (first[F.col("cell")] + F.pmod(F.xxhash64(key), count[F.col("cell")])).cast("int")


def _query_tiles(queries: DataFrame, pivots: np.ndarray, block_rows: int) -> tuple[DataFrame, int]:
    """(q_id, q_vec, q_tile) and the number of tiles.

    Queries near the same pivot share tiles of bounded size, so a tile needs few cells.
    """
    placed = _with_cells(queries, "q_id", "q_vec", pivots)
    if len(pivots) > 1:
        placed = settle(placed)
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    if not sizes:
        return placed.select("q_id", "q_vec", F.lit(0).alias("q_tile")), 0
    tiles = _dealt(sizes, _tile_rows(sum(sizes.values()), block_rows, pivots.shape[1]))
    return placed.select("q_id", "q_vec", _tile_of(tiles, "q_id").alias("q_tile")), max(t + n for t, n, _ in tiles.values())


def _upper(units: np.ndarray, pivots: np.ndarray, radius: dict[int, float]) -> tuple[list[int], np.ndarray]:
    """Upper bound of the similarity of each query to any member of each cell."""
    names = sorted(radius)
    angles = _angles(units, pivots) if max(names) >= 0 else None
    out = np.zeros((len(units), len(names)))
    for j, cell in enumerate(names):
        if cell >= 0:
            out[:, j] = np.cos(np.maximum(angles[:, cell] - radius[cell], 0.0))
    out[~units.any(axis=1)] = 0.0
    return names, out


def _probes(queries: DataFrame, cells: _Cells, choose) -> DataFrame:
    """(q_id, q_vec, floor, q_tile, tile, places): one row per tile a query has to look into, with its cells there.

    ``choose(names, bounds, pdf)`` is a mask of the cells wanted per query.
    """
    kind = queries.schema["q_id"].dataType.simpleString()
    tiles, pivots, radius = cells.tiles(), cells.pivots, cells.radius

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            names, upper = _upper(_unit(pdf["q_vec"].to_list()), pivots, radius)
            wanted = choose(names, upper, pdf)
            at = {(tiles[c][0], tiles[c][1]) for c in names}
            for first, count in sorted(at):
                places = np.zeros(len(pdf), np.int64)
                for j, c in enumerate(names):
                    if tiles[c][0] == first:
                        places |= wanted[:, j].astype(np.int64) << tiles[c][2]
                hit = pdf[places != 0]
                for n in range(count if len(hit) else 0):
                    yield hit.assign(tile=np.int32(first + n), places=places[places != 0])

    schema = f"q_id {kind}, q_vec array<float>, floor double, q_tile int, tile int, places bigint"
    return queries.select("q_id", "q_vec", "floor", "q_tile").mapInPandas(expand, schema)


def _meet(probes: DataFrame, cells: _Cells, q_tiles: int, reduce, out_kind: str) -> DataFrame:
    """Run ``reduce(queries, vector keys, similarities)`` on every (tile, query tile) in use, some queries at a time.

    A vector is copied only to the query tiles that look into its tile. Keys come in ascending order; the similarity is
    ``_OUT`` where a query does not look into the vector's cell.
    """
    rows = cells.tiled()
    if q_tiles * max(t + n for t, n, _ in cells.tiles().values()) <= 64:
        rows = rows.withColumn("v_q_tile", F.explode(F.sequence(F.lit(0), F.lit(max(q_tiles - 1, 0)))))
    else:
        rows = rows.join(probes.select(F.col("tile").alias("v_tile"), F.col("q_tile").alias("v_q_tile")).distinct(), "v_tile")

    def work(_key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return reduce(q.iloc[:0], v["v_id"].to_numpy()[:0], np.zeros((0, 0)))
        # Queries that look into the same cells lie together.
        q, v = q.sort_values("places", kind="stable"), v.sort_values("v_id", kind="stable")
        q_units, v_units = _unit(q["q_vec"].to_list()), _unit(v["v_vec"].to_list())
        ids, place = v["v_id"].to_numpy(), v["v_place"].to_numpy()
        wanted = (q["places"].to_numpy()[:, None] >> np.arange(place.max() + 1)) & 1 > 0
        step, parts = max(1, SIMS // len(v)), []
        for at in range(0, len(q), step):
            looks = wanted[at:at + step]
            near = np.flatnonzero(looks.any(axis=0)[place])
            if not len(near):
                continue
            some = v_units if len(near) == len(v) else v_units[near]
            sims = np.round(q_units[at:at + step] @ some.T, 6) + 0.0
            sims[~looks[:, place[near]]] = _OUT
            parts.append(reduce(q.iloc[at:at + step], ids[near], sims))
        return pd.concat(parts, ignore_index=True) if parts else reduce(q.iloc[:0], ids[:0], np.zeros((0, 0)))

    return probes.groupBy("tile", "q_tile").cogroup(rows.groupBy("v_tile", "v_q_tile")).applyInPandas(work, out_kind)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, q_key: str = "posting_id",
            v_key: str = "profile_id", q_vec: str = "embedding", v_vec: str = "embedding",
            exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(q_key, v_key, similarity, rank): the exact ``k`` nearest vectors of every query.

    Similarity is the cosine rounded to six decimals, ties go to the smaller vector key. Every
    query first looks into the cells it is closest to until they hold k vectors; the k-th best
    similarity found there rules out all cells that cannot beat it, and the rest are searched.
    """
    q_kind, v_kind = queries.schema[q_key].dataType.simpleString(), vectors.schema[v_key].dataType.simpleString()
    shape = f"q_id {q_kind}, v_id {v_kind}, similarity double"
    named = queries.filter(F.col(q_vec).isNotNull()).select(F.col(q_key).alias("q_id"), F.col(q_vec).alias("q_vec"))
    stored = vectors.filter(F.col(v_vec).isNotNull()).select(v_key, v_vec)
    cells = _Cells(stored, v_key, v_vec, block_rows)
    spark = queries.sparkSession
    if cells.rows is None and not stored.limit(1).collect():
        return spark.createDataFrame([], f"{q_key} {q_kind}, {v_key} {v_kind}, similarity double, rank int")
    if cells.rows is None:  # only zero vectors: one cell of them
        cells = _zero_cells(cells, stored, v_key, v_vec)
    tiled, q_tiles = _query_tiles(named, cells.pivots, block_rows)
    need = k + (1 if exclude_self else 0)

    def top(q: pd.DataFrame, ids: np.ndarray, sims: np.ndarray) -> pd.DataFrame:
        if not sims.size:
            return pd.DataFrame({"q_id": q["q_id"].iloc[:0], "v_id": ids[:0], "similarity": np.zeros(0)})
        n = len(ids)
        # Six decimals as whole numbers, then the place of the id: unique, so the k best are exact.
        code = np.rint(sims * 1e6).astype(np.int64) * n + (n - 1 - np.arange(n))
        best = np.argpartition(-code, need - 1, axis=1)[:, :need] if n > need else np.argsort(-code, axis=1)
        keep = np.take_along_axis(sims, best, axis=1)
        rows_q = np.repeat(q["q_id"].to_numpy(), best.shape[1])
        flat_v, flat_s = ids[best].ravel(), keep.ravel()
        hit = flat_s >= np.repeat(q["floor"].to_numpy(), best.shape[1]) - _EPS
        return pd.DataFrame({"q_id": rows_q[hit], "v_id": flat_v[hit], "similarity": flat_s[hit]})

    home = _home(cells.sizes, need)
    start = tiled.withColumn("floor", F.lit(-2.0))
    found = _meet(_probes(start, cells, home), cells, q_tiles, top, shape)
    if len(cells.sizes) > 1:
        found = settle(found)
        by_score = W.partitionBy("q_id").orderBy(F.desc("similarity"))
        floors = (
            found.withColumn("i", F.row_number().over(by_score)).filter(F.col("i") <= need)
            .groupBy("q_id").agg(F.when(F.count(F.lit(1)) >= need, F.min("similarity")).otherwise(F.lit(-2.0)).alias("floor"))
        )
        again = tiled.join(floors, "q_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))

        def others(names, upper, pdf):
            possible = upper >= pdf["floor"].to_numpy()[:, None] - _EPS
            return possible & ~home(names, upper, pdf)

        found = found.unionByName(_meet(_probes(again, cells, others), cells, q_tiles, top, shape))
    if exclude_self:
        found = found.filter(F.col("q_id") != F.col("v_id"))
    order = W.partitionBy("q_id").orderBy(F.desc("similarity"), "v_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("q_id").alias(q_key), F.col("v_id").alias(v_key), "similarity", "rank")


def _home(sizes: dict[int, int], need: int):
    """Mask of the closest cells that together hold ``need`` vectors."""

    def choose(names, upper, _pdf):
        order = np.argsort(-upper, axis=1, kind="stable")
        counts = np.array([sizes[c] for c in names])[order]
        before = np.cumsum(counts, axis=1) - counts
        mask = np.zeros_like(upper, dtype=bool)
        np.put_along_axis(mask, order, before < need, axis=1)
        return mask

    return choose


def _zero_cells(cells: _Cells, stored: DataFrame, key: str, column: str) -> _Cells:
    cells.rows = stored.select(key, column, F.lit(-1).alias("cell"), F.lit(0.0).alias("angle"))
    cells.sizes, cells.radius = {-1: stored.count()}, {-1: 0.0}
    return cells


def near_dups(vectors: DataFrame, threshold: float, key: str = "vec_id", column: str = "embedding",
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, keeper): the lowest key among all vectors at least ``threshold`` similar to a row,
    itself included. Rows whose keeper is another row are near copies; a row without a vector is
    its own keeper.

    Equal vectors are folded into one first, so a group of copies is compared once however large
    it is; a tile then returns one row per query and step (its lowest close key), never the pairs.
    """
    kind = vectors.schema[key].dataType.simpleString()
    folded = vectors.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(key).alias(key))
    reps = settle(folded.select(key, F.col(column).cast("array<float>").alias(column)))
    cells = _Cells(reps, key, column, block_rows)
    if cells.rows is None:
        cells = _zero_cells(cells, reps, key, column)
    if not sum(cells.sizes.values()):
        return vectors.select(key, F.col(key).alias("keeper"))
    named = reps.select(F.col(key).alias("q_id"), F.col(column).alias("q_vec"))
    tiled, q_tiles = _query_tiles(named, cells.pivots, block_rows)
    queries = tiled.withColumn("floor", F.lit(threshold))

    def possible(_names, upper, _pdf):
        return upper >= threshold - _EPS

    def lowest(q: pd.DataFrame, ids: np.ndarray, sims: np.ndarray) -> pd.DataFrame:
        if not sims.size:
            return pd.DataFrame({"q_id": q["q_id"].iloc[:0], "keeper": q["q_id"].iloc[:0]})
        close = sims >= threshold
        hit = close.any(axis=1)
        return pd.DataFrame({"q_id": q["q_id"].to_numpy()[hit], "keeper": ids[close.argmax(axis=1)][hit]})

    met = _meet(_probes(queries, cells, possible), cells, q_tiles, lowest, f"q_id {kind}, keeper {kind}")
    best = met.groupBy(F.col("q_id").alias(key)).agg(F.min("keeper").alias("_close"))
    per_vector = reps.join(best, key, "left").select(
        F.col(column).alias("_v"), F.least(F.col(key), F.col("_close")).alias("keeper"))
    same = F.col(column).cast("array<float>") == F.col("_v")
    return vectors.join(per_vector, same, "left").select(key, F.least(key, "keeper").alias("keeper"))
