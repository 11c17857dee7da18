import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchflow.functions import fixed
from matchflow.functions.vectors import dot, is_zero, norm
from matchflow.operators import export, match, rewrite, vectors

T0 = dt.datetime(2024, 1, 1)


def frame(spark, m, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} long, embedding array<float>")


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def brute(q, v, k):
    sims = np.round(unit(q.astype(np.float32).astype(float)) @ unit(v.astype(np.float32).astype(float)).T, 6) + 0.0
    return [(i, int(j), sims[i, j]) for i in range(len(q)) for j in sorted(range(len(v)), key=lambda j: (-sims[i, j], j))[:k]]


@pytest.fixture(scope="module")
def crowded():
    """Clusters, a third of equal vectors and some zero vectors."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 8))
    m = np.repeat(centres, 30, axis=0) + 0.1 * rng.normal(size=(150, 8))
    m[:50] = m[0]
    m[50:53] = 0
    return rng.permutation(m)


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_nearest_is_exact_with_copies_and_zero_vectors(spark, crowded, block_rows):
    got = match.top_candidates(frame(spark, crowded, "posting_id"), frame(spark, crowded, "profile_id"), 7, block_rows)
    rows = sorted((r.posting_id, -r.similarity, r.profile_id) for r in got.collect())
    expected = sorted((i, -s, j) for i, j, s in brute(crowded, crowded, 7))
    assert [(i, j) for i, _, j in rows] == [(i, j) for i, _, j in expected]
    assert np.allclose([s for _, s, _ in rows], [s for _, s, _ in expected], atol=2e-6)


def test_nearest_rules_cells_out(crowded):
    pivots = unit(crowded[:4] + 1e-3)
    angles = vectors._angles(unit(crowded), pivots)
    cell = angles.argmin(axis=1)
    radius = {c: float(angles[cell == c, c].max()) for c in range(4) if (cell == c).any()}
    names, upper = vectors._upper(unit(crowded), pivots, radius)
    sims = unit(crowded) @ unit(crowded).T
    for j, c in enumerate(names):
        assert (sims[:, cell == c].max(axis=1) <= upper[:, j] + 1e-6).all()


def test_nearest_without_self_and_without_vectors(spark, crowded):
    a = frame(spark, crowded[:20], "posting_id")
    b = a.withColumnRenamed("posting_id", "profile_id")
    got = vectors.nearest(a, b, 3, exclude_self=True)
    assert got.filter("posting_id = profile_id").count() == 0 and got.count() == 60
    assert vectors.nearest(a, b.limit(0), 3).count() == 0
    zeros = frame(spark, np.zeros((3, 8)), "profile_id")
    assert {r.similarity for r in vectors.nearest(a, zeros, 2).collect()} == {0.0}


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_near_dups_keep_the_lowest_close_row(spark, crowded, block_rows):
    sims = np.round(unit(crowded.astype(np.float32).astype(float)) @ unit(crowded.astype(np.float32).astype(float)).T, 6)
    expected = {i: min([i] + [j for j in range(len(crowded)) if sims[i, j] >= 0.97]) for i in range(len(crowded))}
    # zero vectors equal each other, so their group keeps its lowest row
    zero = [i for i in range(len(crowded)) if not crowded[i].any()]
    expected.update({i: zero[0] for i in zero})
    got = vectors.near_dups(frame(spark, crowded, "vec_id"), 0.97, block_rows=block_rows)
    assert {r.vec_id: r.keeper for r in got.collect()} == expected


def test_zero_vectors_score_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.6, 0.8])], "a array<float>, b array<float>")
    row = vectors.cosine_pairs(df, "a", "b").select("score", is_zero(F.col("a")).alias("z"), norm(F.col("b")).alias("n"), dot(F.col("b"), F.col("b")).alias("d")).first()
    assert row.score == 0.0 and row.z and row.n == pytest.approx(1) and row.d == pytest.approx(1)


def test_encoders(spark):
    df = spark.createDataFrame([(1, "spark jobs"), (2, " "), (3, None), (4, "other words")], "id long, t string")
    for encoder in (vectors.fit_encoder(df, "t", 16), lambda texts: np.array([[len(t)] + [1] * 15 for t in texts])):
        got = {r.id: np.array(r.embedding) for r in vectors.vectorise(df, "t", encoder, dims=16).collect()}
        assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-5)
        assert not got[2].any() and not got[3].any() and len(got[3]) == 16


def test_refresh_encodes_only_changes_and_drops_the_vanished(spark):
    sections = spark.createDataFrame([(1, "skills", 0, "a", "h1"), (1, "summary", 0, "b", "h2")],
                                     "profile_id long, section_type string, section_index int, content string, content_hash string")
    store = spark.createDataFrame([(1, "skills", 0, "h1", [9.0], T0), (1, "summary", 0, "old", [9.0], T0), (2, "skills", 0, "h", [9.0], T0)],
                                  "profile_id long, section_type string, section_index int, content_hash string, embedding array<float>, created_at timestamp")
    out = vectors.refresh_vectors(sections, store, lambda d: d.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    assert sorted((r.section_type, r.embedding[0]) for r in out.collect()) == [("skills", 9.0), ("summary", 1.0)]


def scores(spark, *items):
    return spark.createDataFrame([(1, 2, k, i, float(s)) for k, i, s in items],
                                 "posting_id long, profile_id long, section_type string, section_index int, score double")


def test_overall_score(spark):
    full = scores(spark, ("summary", 0, .8), ("experience", 0, .6), ("experience", 1, .4), ("skills", 0, .5))
    assert match.overall_score(full).first().overall_score == pytest.approx(0.56)
    bare = scores(spark, ("experience", 0, .6), ("skills", 0, .5))
    assert match.overall_score(bare).first().overall_score == pytest.approx(0.567375887)


def test_weak_sections_and_score_map(spark):
    rows = scores(spark, ("summary", 0, .50), ("project", 1, .49), ("skills", 0, .1))
    assert [r.section_type for r in match.weak_sections(rows).orderBy("place").collect()] == ["skills", "project"]
    assert match.score_map(rows).first().scores == {"summary": .5, "project_1": .49, "skills": .1}


def test_pairs_without_sections_score_zero(spark):
    pairs = spark.createDataFrame([(0, 1)], "posting_id long, profile_id long")
    none = spark.createDataFrame([], "profile_id long, section_type string, section_index int, embedding array<float>")
    assert match.score_pairs(pairs, none, frame(spark, np.eye(2), "posting_id")).first().overall_score == 0.0


def test_leaderboard_falls_back_to_the_newest(spark):
    postings = frame(spark, np.eye(2), "posting_id")
    people = spark.createDataFrame([(1, None, T0), (2, None, T0 + dt.timedelta(days=1))], "profile_id long, embedding array<float>, created_at timestamp")
    sections = spark.createDataFrame([(1, "skills", 0, [1.0, 0.0]), (2, "skills", 0, [0.0, 1.0])],
                                     "profile_id long, section_type string, section_index int, embedding array<float>")
    best = match.leaderboard(postings, people, sections, 1).orderBy("posting_id").collect()
    assert [(r.posting_id, r.profile_id, r.overall_score) for r in best] == [(0, 1, 1.0), (1, 2, 1.0)]


def test_profile_vectors_use_the_mean_of_sections(spark):
    people = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "profile_id long, summary_embedding array<float>")
    sections = spark.createDataFrame([(2, [1.0, 0.0]), (2, [0.0, 1.0])], "profile_id long, embedding array<float>")
    got = {r.profile_id: r.embedding for r in match.profile_vectors(people, sections).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.5, 0.5]}
    assert match.profile_vectors(people, sections, strict=True).count() == 1


@pytest.mark.parametrize("score,place", [(.75, 0), (.65, 1), (.50, 2), (.4999, 3)])
def test_match_band(spark, score, place):
    df = spark.createDataFrame([(score,)], "s double").select(match.match_band("s").alias("b"))
    assert df.first().b == fixed.BAND_TEXT[place][1]


@pytest.mark.parametrize("s,k,name", [(.65, .65, "strong"), (.5, .5, "good"), (.4, .6, "content"), (.9, .4, "keywords"), (.4, .55, "poor")])
def test_matrix_band(spark, s, k, name):
    df = spark.createDataFrame([(s, k)], "s double, k double").select(match.matrix_band("s", "k").alias("b"))
    assert df.first().b == fixed.MATRIX_TEXT[name]


def test_route_uses_a_threshold(spark):
    best = spark.createDataFrame([(1, 7, .9, 1), (2, 7, .85, 1), (3, 8, .5, 1), (1, 9, .88, 2)], "posting_id long, profile_id long, overall_score double, rank int")
    chosen, uses = match.route(best)
    assert chosen.count() == 2 and [tuple(r) for r in uses.collect()] == [(7, 2)]


PEOPLE = ("profile_id long, full_name string, email string, phone string, location string, summary string, skills array<string>, "
          "experience array<struct<company:string,title:string,dates:string,description:array<string>>>, "
          "education array<struct<institution:string,degree:string,field:string,dates:string,gpa:string>>, "
          "projects array<struct<name:string,technologies:array<string>,description:array<string>,url:string>>")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(
        1, "Jo <b>", "j@x.org", None, "Salem", "I & you", ["sql", "C++"],
        [("Acme", "Dev", "2020", ["built 5% more"]), (None, None, None, [])],
        [("MIT", None, None, "2019", None)], [("Tool", ["java"], ["made it"], None)])], PEOPLE)


def test_section_rows_skip_blanks_but_keep_the_place(people):
    rows = {(r.section_type, r.section_index): r.content for r in match.section_rows(people).collect()}
    assert rows == {("summary", 0): "I & you", ("experience", 0): "Dev Acme 2020 built 5% more", ("project", 0): "Tool java made it", ("skills", 0): "sql, C++"}
    assert match.full_text(people).first().text == "Jo <b> I & you sql, C++ Dev Acme 2020 built 5% more Tool java made it MIT 2019"


def test_export_text(people):
    assert export.export_text(people).first().text == "\n".join([
        "JO <B>", "j@x.org | Salem", "", "SUMMARY", "I & you", "", "EXPERIENCE", "Dev - Acme", "2020", "  - built 5% more", "", " - ", "",
        "PROJECTS", "Tool", "Technologies: java", "  - made it", "", "SKILLS", "sql, C++", "", "EDUCATION", "Degree - MIT", "2019", ""])


def test_annotations_escape_and_mark(spark, people):
    rows = scores(spark, ("summary", 0, .5), ("experience", 0, .2)).withColumn("profile_id", F.lit(1).cast("long"))
    got = {r.section_type: r for r in export.annotated_sections(people, rows).collect()}
    assert got["summary"].html == "I &amp; you" and got["summary"].style == "moderate-section" and got["summary"].badge == "50%"
    assert got["experience"].badge_style == "weak" and got["summary"].badge_style is None
    gaps = spark.createDataFrame([(5, 1, [" SQL"])], "posting_id long, profile_id long, matched array<string>")
    assert [(r.skill, r.matched) for r in export.annotated_skills(people, gaps).orderBy("position").collect()] == [("sql", True), ("C++", False)]


def test_rewrite_worklist_splits_and_asks_once(spark, people):
    weak = spark.createDataFrame([(1, 1, "experience", 0), (2, 1, "experience", 0), (3, 1, "summary", 0), (1, 1, "skills", 0)],
                                 "posting_id long, profile_id long, section_type string, section_index int")
    head = "p" * 2000
    postings = spark.createDataFrame([(1, head + "a"), (2, head + "b"), (3, "q")], "posting_id long, description string")
    key = spark.createDataFrame([("I & you", "q")], "c string, d string").select(rewrite.cache_key("c", "d").alias("k")).first().k
    cache = spark.createDataFrame([(key, "done"), ("x", "")], "cache_key string, response_text string")
    hits, todo, unsupported = rewrite.rewrite_worklist(weak, rewrite.section_requests(people), postings, cache, 2000)
    assert [(r.posting_id, r.response_text) for r in hits.collect()] == [(3, "done")]
    (ask,) = todo.collect()
    assert ask.sections == 2 and "- built 5% more" in ask.prompt and head in ask.prompt and ask.prompt.startswith("Section: a job")
    assert unsupported.first().reason == fixed.UNSUPPORTED


def test_cache_expiry_keeps_the_limit_itself(spark):
    cache = spark.createDataFrame([("a", T0), ("b", T0 - dt.timedelta(seconds=1))], "cache_key string, created_at timestamp")
    now = F.lit(T0 + dt.timedelta(days=30))
    kept, gone = rewrite.expire_cache(cache, 30, now)
    assert [r.cache_key for r in kept.collect()] == ["a"] and gone.first().deleted == 1
    assert tuple(rewrite.cache_stats(cache, now).first()) == (2, 0)


def test_a_query_moves_once_per_tile_however_small_the_blocks(spark, crowded):
    """150 vectors in up to 75 cells: a query that may look into all of them is sent to the few tiles they lie in."""
    cells = vectors._Cells(frame(spark, crowded, "profile_id"), "profile_id", "embedding", 2)
    named = frame(spark, crowded, "q_id").withColumnRenamed("embedding", "q_vec")
    tiled, q_tiles = vectors._query_tiles(named, cells.pivots, 2)
    everywhere = lambda names, upper, pdf: np.ones_like(upper, dtype=bool)
    probes = vectors._probes(tiled.withColumn("floor", F.lit(-2.0)), cells, everywhere)
    tiles = max(t + n for t, n, _ in cells.tiles().values())
    assert len(cells.sizes) > 2 * tiles and q_tiles <= 150
    assert probes.count() == 150 * tiles
    assert {p for _, _, p in cells.tiles().values()} <= set(range(vectors.PLACES))


def test_a_task_works_on_few_similarities_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SIMS", 500)
    seen = spark.sparkContext.accumulator(0)
    m = np.random.default_rng(3).normal(size=(200, 8))
    cells = vectors._Cells(frame(spark, m, "profile_id"), "profile_id", "embedding", 4096)
    tiled, q_tiles = vectors._query_tiles(frame(spark, m, "q_id").withColumnRenamed("embedding", "q_vec"), cells.pivots, 4096)
    probes = vectors._probes(tiled.withColumn("floor", F.lit(-2.0)), cells, lambda names, upper, pdf: np.ones_like(upper, dtype=bool))

    def most(q, ids, sims):
        seen.add(sims.size)
        return q.assign(n=sims.size)[["q_id", "n"]]

    rows = vectors._meet(probes, cells, q_tiles, most, "q_id long, n long").collect()
    assert len(rows) == 200 and max(r.n for r in rows) <= 500 and seen.value == 200 * 200
