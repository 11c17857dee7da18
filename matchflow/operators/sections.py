"""Section-to-section match: the sections of a posting against those of a profile.

A posting comes as sections too (duties, requirements, summary). Each of its sections looks for its best partner in the
profile, or all of them are dealt out one to one so that the scores add up to the most.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settle

PAIR = ["posting_id", "profile_id"]
#: Postings and profiles whose pairs meet in one group, about.
BLOCK_ROWS = 512
#: Scores have six decimals; whole numbers make the auction exact.
UNIT = 1_000_000
#: Cells of the matrices that one step of the auction works on.
CELLS = 1 << 21


def usable(embedding: Column) -> Column:
    """Vectors without null or non-finite entries."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, sound)


def auction(benefit: np.ndarray) -> np.ndarray:
    """For each matrix of whole benefits >= 0 (k, n, n) the object of each person, so that the benefits add up to the most.

    All unassigned persons of all matrices bid at once; the least raise shrinks from phase to phase down to 1. Benefits are
    multiplied by n + 1, so that a total that is short by less than n + 1 isn't short at all.
    """
    k, n, _ = benefit.shape
    gain = benefit.astype(np.int64) * (n + 1)
    price = np.zeros((k, n), np.int64)
    chosen = np.full((k, n), -1, np.int64)
    owner = np.full((k, n), -1, np.int64)
    # Each matrix has its own raises, so that its result doesn't depend on what it is worked on with.
    raise_by = np.maximum(1, gain.reshape(k, -1).max(axis=1, initial=0) // 4)
    while True:
        while True:
            at, person = np.nonzero(chosen < 0)
            if not len(at):
                break
            value = gain[at, person] - price[at]
            best = value.argmax(axis=1)
            rows = np.arange(len(at))
            top = value[rows, best]
            value[rows, best] = np.iinfo(np.int64).min
            second = value.max(axis=1) if n > 1 else top
            bid = price[at, best] + top - second + raise_by[at]
            # The highest bid for each object wins, the first person on a tie.
            order = np.lexsort((person, -bid, best, at))
            first = np.ones(len(order), bool)
            first[1:] = (at[order][1:] != at[order][:-1]) | (best[order][1:] != best[order][:-1])
            won = order[first]
            m, obj = at[won], best[won]
            before = owner[m, obj]
            chosen[m[before >= 0], before[before >= 0]] = -1
            owner[m, obj] = person[won]
            chosen[m, person[won]] = obj
            price[m, obj] = bid[won]
        again = np.flatnonzero(raise_by > 1)
        if not len(again):
            return chosen
        raise_by[again] = np.maximum(1, raise_by[again] // 5)
        chosen[again] = -1
        owner[again] = -1


def best_partners(scores: np.ndarray) -> np.ndarray:
    """(k, p, q) scores, NaN where not allowed: the best partner of each of p, the first on a tie, -1 without any."""
    if not scores.shape[2]:
        return np.full(scores.shape[:2], -1)
    filled = np.where(np.isnan(scores), -np.inf, scores)
    return np.where(np.isneginf(filled.max(axis=2)), -1, filled.argmax(axis=2))


def dealt_partners(scores: np.ndarray) -> np.ndarray:
    """As ``best_partners``, one to one with the highest total; what would add nothing stays alone."""
    k, p, q = scores.shape
    n = p + q
    out = np.full((k, p), -1)
    step = max(1, CELLS // (n * n))
    for start in range(0, k, step):
        part = scores[start:start + step]
        gains = np.rint(np.nan_to_num(np.maximum(part, 0)) * UNIT).astype(np.int64)
        # Everyone may stay alone: p more objects that are worth nothing, and q more persons who want nothing.
        square = np.zeros((len(part), n, n), np.int64)
        square[:, :p, :q] = gains
        chosen = auction(square)[:, :p]
        real = chosen < q
        value = np.take_along_axis(square[:, :p], chosen[:, :, None], axis=2)[:, :, 0]
        out[start:start + step] = np.where(real & (value > 0), chosen, -1)
    return out


def _rule(mine: list[str], theirs: list[str], allowed: Mapping[str, set[str]] | None):
    """Which types may meet as a matrix, and the place of each row's type in it; None where all may."""
    if allowed is None:
        return None, None, None
    ours, others = ({t: n for n, t in enumerate(dict.fromkeys(types))} for types in (mine, theirs))
    matrix = np.array([[t not in allowed or x in allowed[t] for x in others] for t in ours], bool).reshape(len(ours), len(others))
    return matrix, np.array([ours[t] for t in mine], np.int64), np.array([others[x] for x in theirs], np.int64)


class _Side:
    """The sections of one side of a block, sorted by key, type and index."""

    def __init__(self, table: pa.Table, key: str):
        own = table.filter(pc.is_valid(table[key])).sort_by([(c, "ascending") for c in (key, "section_type", "section_index")])
        self.types, self.index = own["section_type"].combine_chunks(), own["section_index"].combine_chunks()
        self.ids = pc.unique(own[key])
        place = pc.index_in(own[key], value_set=self.ids).to_numpy()
        self.start = np.searchsorted(place, np.arange(len(self.ids) + 1))
        vectors = own["embedding"].combine_chunks()
        if len(pc.unique(pc.list_value_length(vectors))) > 1:
            raise ValueError("vectors of sections differ in length")
        self.vectors = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1) if len(own) else np.empty((0, 0))

    def place(self, ids: pa.ChunkedArray) -> np.ndarray:
        return pc.fill_null(pc.index_in(ids, value_set=self.ids), -1).to_numpy()


def section_links(pairs: DataFrame, posting_sections: DataFrame, profile_sections: DataFrame,
                  partners: Mapping[str, Sequence[str]] | None = None, one_to_one: bool = False,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(posting_id, profile_id, posting_type, posting_index, section_type, section_index, score): the partner of every section
    of the posting in each pair.

    Inputs: distinct pairs(posting_id, profile_id); posting_sections(posting_id, section_type, section_index, embedding) and
    profile_sections(profile_id, ...) with one row per section and vectors of one length. Score: dot product in double
    precision rounded to six decimals.

    * ``partners`` says which types of profile sections a type of posting section may meet; types it doesn't name meet all
    * best partner: the highest score, ties to the first type and index
    * ``one_to_one``: no section has two partners and the scores add up to the most; a section whose partner would add
      nothing stays alone. The total is exact, of several assignments with that total one is taken, always the same
    * a section without a partner has nulls for partner and score; pairs without a posting section give no row
    * vectors that are null, empty or hold null or non-finite entries take no part; other columns are not looked at

    Pairs are dealt over a grid of blocks of postings and profiles, and a section moves once for each block in which its
    pairs lie, not once per pair. The pairs of a posting or profile in very many pairs lie in as many blocks as the other
    side has.
    """
    pairs = settle(pairs.select(*PAIR).where("posting_id IS NOT NULL AND profile_id IS NOT NULL"))
    parts = lambda c: F.ceil(F.approx_count_distinct(c) / block_rows)
    sizes = pairs.agg(F.greatest(parts("posting_id"), F.lit(1)).alias("a"), F.greatest(parts("profile_id"), F.lit(1)).alias("b")).first()
    share = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = pairs.withColumns({"a": share("posting_id", sizes["a"]), "b": share("profile_id", sizes["b"])})

    def sent(sections: DataFrame, key: str) -> DataFrame:
        sound = sections.where(usable(F.col("embedding"))).select(
            key, "section_type", F.col("section_index").cast("long").alias("section_index"), F.col("embedding").cast("array<double>").alias("embedding"))
        return dealt.select(key, "a", "b").distinct().join(sound, key)

    both = sent(posting_sections, "posting_id").unionByName(sent(profile_sections, "profile_id"), allowMissingColumns=True)
    both = both.select(F.col("a").alias("s_a"), F.col("b").alias("s_b"), F.col("posting_id").alias("s_posting"),
                       F.col("profile_id").alias("s_profile"), "section_type", "section_index", "embedding")
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in PAIR}
    shape = (f"posting_id {kinds['posting_id']}, profile_id {kinds['profile_id']}, posting_type string, posting_index bigint, "
             "section_type string, section_index bigint, score double")
    allowed = None if partners is None else {kind: set(types) for kind, types in partners.items()}
    choose = dealt_partners if one_to_one else best_partners

    def met(met_pairs: pa.Table, sections: pa.Table) -> Iterator[pa.Table]:
        left, right = _Side(sections, "s_posting"), _Side(sections, "s_profile")
        i, j = left.place(met_pairs["posting_id"]), right.place(met_pairs["profile_id"])
        rows = np.flatnonzero(i >= 0)
        i, j = i[rows], j[rows]
        p = left.start[i + 1] - left.start[i]
        q = np.where(j >= 0, right.start[j + 1] - right.start[j], 0)
        rule, left_type, right_type = _rule(left.types.to_pylist(), right.types.to_pylist(), allowed)
        # Pairs with as many sections on either side are worked on together, a bounded number at a time.
        for shape_pq in {(int(x), int(y)) for x, y in zip(p, q)}:
            of_shape = np.flatnonzero((p == shape_pq[0]) & (q == shape_pq[1]))
            step = max(1, CELLS // max(1, shape_pq[0] * max(shape_pq[1], 1) + sum(shape_pq) * left.vectors.shape[1]))
            for at in range(0, len(of_shape), step):
                some = of_shape[at:at + step]
                one = left.start[i[some]][:, None] + np.arange(shape_pq[0])
                other = right.start[np.maximum(j[some], 0)][:, None] + np.arange(shape_pq[1])
                if shape_pq[1]:
                    scores = np.round(np.einsum("kpd,kqd->kpq", left.vectors[one], right.vectors[other]), 6) + 0.0
                else:
                    scores = np.zeros((len(some), *shape_pq))
                if rule is not None:
                    scores[~rule[left_type[one][:, :, None], right_type[other][:, None, :]]] = np.nan
                partner = choose(scores)
                alone = (partner < 0).ravel()
                if shape_pq[1]:
                    at_partner = np.maximum(partner, 0)
                    target = np.take_along_axis(other, at_partner, axis=1).ravel()
                    value = np.take_along_axis(scores, at_partner[:, :, None], axis=2).ravel()
                else:
                    target, value = np.zeros(alone.size, np.int64), np.zeros(alone.size)
                take = pa.array(target, pa.int64(), mask=alone)
                own, pair = pa.array(one.ravel()), pa.array(np.repeat(rows[some], shape_pq[0]))
                yield pa.table({
                    "posting_id": met_pairs["posting_id"].take(pair), "profile_id": met_pairs["profile_id"].take(pair),
                    "posting_type": left.types.take(own), "posting_index": left.index.take(own),
                    "section_type": right.types.take(take), "section_index": right.index.take(take),
                    "score": pa.array(value, pa.float64(), mask=alone)})

    def group(_key, met_pairs: pa.Table, sections: pa.Table) -> pa.Table:
        tables = list(met(met_pairs, sections)) if met_pairs.num_rows and sections.num_rows else []
        return pa.concat_tables(tables) if tables else _nothing(met_pairs)

    return dealt.groupBy("a", "b").cogroup(both.groupBy("s_a", "s_b")).applyInArrow(group, shape)


def _nothing(pairs: pa.Table) -> pa.Table:
    kinds = {"posting_id": pairs.schema.field("posting_id").type, "profile_id": pairs.schema.field("profile_id").type, "posting_type": pa.string(),
             "posting_index": pa.int64(), "section_type": pa.string(), "section_index": pa.int64(), "score": pa.float64()}
    return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})


def late_interaction(links: DataFrame) -> DataFrame:
    """(posting_id, profile_id, sections, partnered, total, score) of ``section_links``.

    ``score`` is the mean over the posting's sections, a section without a partner counting as 0; ``total`` the sum.
    """
    found = F.coalesce("score", F.lit(0.0))
    sums = links.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("sections"), F.count("score").alias("partnered"),
                                    F.round(F.sum(found), 6).alias("total"))
    return sums.withColumn("score", F.round(F.col("total") / F.col("sections"), 9))
