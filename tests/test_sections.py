import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchflow.operators import sections

KINDS = ["experience", "project", "skills", "summary"]


def most(scores):
    """Highest total of a one-to-one assignment by trying all; what would add nothing stays alone."""
    p, q = scores.shape
    gains = np.nan_to_num(np.maximum(scores, 0))
    padded = np.hstack([gains, np.zeros((p, p))])
    return max(sum(padded[i, j] for i, j in enumerate(to)) for to in itertools.permutations(range(p + q), p))


@pytest.mark.parametrize("p,q", [(1, 1), (1, 4), (3, 2), (3, 3), (2, 5), (4, 3)])
def test_auction_reaches_the_most(p, q):
    rng = np.random.default_rng(p * 10 + q)
    loose = np.round(rng.uniform(-1, 1, (40, p, q)), 6)
    tied = rng.integers(-1, 2, (20, p, q)).astype(float)
    equal = np.ones((1, p, q))
    for scores in (loose, tied, equal, -equal, np.where(loose > 0.7, np.nan, loose)):
        dealt = sections.dealt_partners(scores)
        for one, partner in zip(scores, dealt):
            used = partner[partner >= 0]
            assert len(set(used)) == len(used)
            total = sum(one[i, j] for i, j in enumerate(partner) if j >= 0)
            assert total == pytest.approx(most(one), abs=1e-9)


def test_auction_with_many_near_equal_gains_ends():
    scores = np.round(1 - np.random.default_rng(1).integers(0, 3, (1, 40, 30)) * 1e-6, 6)
    dealt = sections.dealt_partners(scores)[0]
    assert sorted(dealt[dealt >= 0]) == list(range(30))


def made(spark, key, rows):
    return spark.createDataFrame(rows, f"{key} long, section_type string, section_index int, embedding array<float>, score string, a string")


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.default_rng(3)

    def side(n, kinds):
        rows = []
        for key in range(n):
            for at in range(int(rng.integers(1, 5))):
                v = rng.normal(size=6)
                rows.append((key, kinds[at % len(kinds)], at, [float(x) for x in np.float32(v / np.linalg.norm(v))], "x", "y"))
        return rows

    ours, theirs = side(25, ["duties", "requirements"]), side(20, KINDS)
    pairs = [(i, j) for i in range(25) for j in range(20) if i == 7 or (i + j) % 3 == 0]
    return ours, theirs, pairs


def expected(ours, theirs, pairs, allowed):
    for i, j in pairs:
        mine = sorted(r[1:4] for r in ours if r[0] == i)
        other = sorted(r[1:4] for r in theirs if r[0] == j)
        scores = np.array([[round(float(np.dot(np.float64(x[2]), np.float64(y[2]))), 6) if allowed(x[0], y[0]) else np.nan for y in other] for x in mine])
        yield i, j, mine, other, scores


@pytest.mark.parametrize("block_rows", [512, 4])
def test_best_partners_against_brute_force(spark, both, block_rows):
    ours, theirs, pairs = both
    rule = {"requirements": ["skills"]}
    got = sections.section_links(spark.createDataFrame(pairs, "posting_id long, profile_id long"), made(spark, "posting_id", ours),
                                 made(spark, "profile_id", theirs), rule, block_rows=block_rows).collect()
    want = {}
    for i, j, mine, other, scores in expected(ours, theirs, pairs, lambda x, y: x != "requirements" or y == "skills"):
        for n, x in enumerate(mine):
            best = min(((-s, other[m][0], other[m][1]) for m, s in enumerate(scores[n]) if s == s), default=None)
            want[i, j, x[0], x[1]] = (best[1], best[2], pytest.approx(-best[0], abs=1e-6)) if best else (None, None, None)
    assert len(got) == len(want)
    for r in got:
        assert (r.section_type, r.section_index, r.score) == want[r.posting_id, r.profile_id, r.posting_type, r.posting_index]


def test_one_to_one_against_brute_force(spark, both):
    ours, theirs, pairs = both
    links = sections.section_links(spark.createDataFrame(pairs, "posting_id long, profile_id long"), made(spark, "posting_id", ours),
                                   made(spark, "profile_id", theirs), one_to_one=True, block_rows=8)
    rows = links.where("score IS NOT NULL")
    assert rows.count() == rows.select("posting_id", "profile_id", "section_type", "section_index").distinct().count()
    got = {(r.posting_id, r.profile_id): r.total for r in sections.late_interaction(links).collect()}
    want = {(i, j): pytest.approx(most(scores), abs=1e-5) for i, j, _, _, scores in expected(ours, theirs, pairs, lambda x, y: True)}
    assert got == want


def test_odd_sections(spark):
    nan, inf = float("nan"), float("inf")
    ours = made(spark, "posting_id", [(1, "duties", 0, [1.0, 0.0], None, None), (1, "duties", 1, [nan, 0.0], None, None), (2, "duties", 0, None, None, None),
                                      (3, None, None, [0.0, 1.0], None, None), (None, "duties", 0, [1.0, 0.0], None, None)])
    theirs = made(spark, "profile_id", [(1, "skills", 0, [1.0, 0.0], None, None), (1, "skills", 1, [1.0, 0.0], None, None), (2, "skills", 0, [inf, 1.0], None, None),
                                        (1, "summary", 0, [], None, None), (1, "summary", 1, [None, 1.0], None, None)])
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 9), (2, 1), (3, 1), (None, 1)], "posting_id long, profile_id long")
    for one_to_one in (False, True):
        rows = {(r.posting_id, r.profile_id, r.posting_type): (r.section_index, r.score) for r in
                sections.section_links(pairs, ours, theirs, {"duties": ["skills"]}, one_to_one).collect()}
        # Equal vectors: the first one as the best, either where they are dealt out. A profile without usable sections leaves the posting's alone.
        assert rows == {(1, 1, "duties"): (rows[1, 1, "duties"][0] if one_to_one else 0, 1.0), (1, 2, "duties"): (None, None), (1, 9, "duties"): (None, None),
                        (3, 1, None): (None, None) if one_to_one else (0, 0.0)}
    assert sections.section_links(pairs.limit(0), ours, theirs).count() == 0
    assert sections.section_links(pairs, ours, theirs.limit(0)).where(F.col("score").isNotNull()).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        uneven = made(spark, "profile_id", [(1, "skills", 0, [1.0, 0.0], None, None), (1, "skills", 1, [1.0], None, None)])
        sections.section_links(pairs, ours, uneven).count()
