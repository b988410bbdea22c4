import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytequarry.operators import greedy, nearest, similar, warping


def vectors(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist(), "z", 1.0) for i, x in enumerate(v)], "vec long, e array<double>, cell string, best double").repartition(4)


def plain_best(a, b, exclude_self=True, first=0):
    s = np.round(similar.cosine(a, b), 6)
    if exclude_self:
        np.fill_diagonal(s, -np.inf)
    return {i: (int(s[i].argmax()), float(s[i].max())) for i in range(len(a)) if np.isfinite(s[i].max())}


def check(got, want):
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert {k: x[1] for k, x in got.items()} == pytest.approx({k: x[1] for k, x in want.items()})


def clustered(n, d=16, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, d))
    v = centers[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, d))
    v[5] = v[9] = v[13]  # equal vectors: the least id wins
    v[7] = 0
    v[11] = -v[3]
    return v


@pytest.mark.parametrize("make", [clustered, lambda n: np.random.default_rng(2).normal(size=(n, 8))])
def test_nearest_equals_all_pairs(spark, make):
    v = make(600)
    df = vectors(spark, v)
    got = nearest.nearest(df, df, "vec", "e", cell_rows=20)
    assert got.columns == ["vec", "match_id", "score", "compared"]
    check({r.vec: (r.match_id, r.score) for r in got.collect()}, plain_best(v, v))


def test_cells_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PIECE_ROWS", 16)
    v = clustered(300, groups=2)
    left, right = vectors(spark, v[:120], 1000), vectors(spark, v)
    got = {r.vec - 1000: (r.match_id, r.score) for r in nearest.nearest(left, right, "vec", "e", cell_rows=50).collect()}
    check(got, plain_best(v[:120], v, False))


def test_share_of_pairs_compared_falls_with_size(spark):
    shares = []
    for n in (400, 1600):
        v = clustered(n, groups=n // 20)
        df = vectors(spark, v)
        compared = nearest.nearest(df, df, "vec", "e", cell_rows=20).agg(F.sum("compared")).first()[0]
        shares.append(compared / n / n)
    assert shares[1] < 0.4 * shares[0] < 0.2


@pytest.mark.parametrize("exclude_self", [True, False])
def test_a_row_moves_once_for_each_block(spark, monkeypatch, exclude_self):
    for name, n in (("BLOCKS", 5), ("BLOCK_ROWS", 16), ("AT_ONCE", 37), ("PIECE_ROWS", 64)):
        monkeypatch.setattr(nearest, name, n, raising=False)
    kept, held = [], nearest.held
    monkeypatch.setattr(nearest, "held", lambda df: kept.append(held(df)) or kept[-1])
    v = np.random.default_rng(8).normal(size=(400, 8))
    v[100:180] = v[100] + 1e-5 * v[100:180]
    v[7] = v[8] = 0
    df = vectors(spark, v)
    check({r.vec: (r.match_id, r.score) for r in nearest.nearest(df, df, "vec", "e", exclude_self, cell_rows=20).collect()}, plain_best(v, v, exclude_self))
    asks = [df.agg(F.sum(F.size(c))).first()[0] for df in kept for c, t in df.dtypes if t == "array<int>"]
    assert asks and max(asks) <= 5 * len(v)


def test_nearest_of_nothing(spark):
    df = vectors(spark, clustered(20))
    assert nearest.nearest(df.limit(0), df, "vec", "e").collect() == [] == nearest.nearest(df, df.limit(0), "vec", "e").collect()
    nulls = df.limit(1).withColumn("e", F.lit(None).cast("array<double>")).unionByName(df.filter("vec < 1").withColumn("vec", F.lit(None).cast("long"))).unionByName(df.filter("vec = 2"))
    assert nearest.nearest(nulls, nulls, "vec", "e").collect() == []


def slow_warp(a, b, band=None):
    ok = warping.allowed(len(a), len(b), band)
    best = np.full((len(a) + 1, len(b) + 1), np.inf)
    best[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            if ok[i, j]:
                best[i + 1, j + 1] = np.linalg.norm(a[i] - b[j]) + min(best[i, j], best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


@pytest.mark.parametrize("n,m,band", [(8, 8, None), (8, 8, 2), (5, 9, None), (9, 4, 1), (1, 6, 2), (12, 7, 3), (1, 1, None)])
def test_warping_in_bulk(n, m, band):
    rng = np.random.default_rng(n * m)
    a, b = rng.normal(size=(30, n, 3)), rng.normal(size=(30, m, 3))
    want = np.array([slow_warp(x, y, band) for x, y in zip(a, b, strict=True)])
    assert np.isfinite(want).all() and warping.warped(a, b, band=band) == pytest.approx(want)
    if band is None:
        assert want / (n + m) == pytest.approx([similar.dtw(x, y) for x, y in zip(a, b, strict=True)])
    limit = np.median(want)
    cut = warping.warped(a, b, limit, band)
    assert (np.isfinite(cut) == (want <= limit)).all()
    full = np.array([[slow_warp(x, y, band) for y in b[:6]] for x in a[:6]])
    assert (warping.bounds(a[:6], b[:6], band) <= full + 1e-9).all()


def test_best_scores_equal_full_warping_and_warp_less():
    rng = np.random.default_rng(4)
    seeds = rng.normal(size=(12, 3)).cumsum(axis=0)
    left = [seeds[: rng.integers(5, 12)] * rng.uniform(0.5, 3) + rng.normal(size=3) * 2 for _ in range(25)]
    right = [seeds[: rng.integers(5, 12)] * rng.uniform(0.5, 3) + rng.normal(size=3) * 2 for _ in range(30)]
    near, rest = rng.random((25, 30)) < 0.9, rng.random((25, 30)) * 0.3
    full = np.where(near, [[(rest[i, j] + 2.5 / (1 + similar.dtw(x, y))) / 3 for j, y in enumerate(right)] for i, x in enumerate(left)], -np.inf)
    got, count = warping.best_scores(left, right, near, rest, 2.5, 3.0)
    assert (got.argmax(axis=1) == full.argmax(axis=1)).all() and got.max(axis=1) == pytest.approx(full.max(axis=1))
    assert count < 0.7 * near.sum()


def test_few_pairs_without_structure_are_warped_in_double_precision():
    rng = np.random.default_rng(6)
    rows = [*rng.normal(size=(90, 8, 8)), *rng.normal(size=(40, 5, 8))]
    rows[3], rows[4] = rows[70] + 1e-9, rows[70].copy()
    near, rest = ~np.eye(130, dtype=bool), rng.random((130, 130)) * 0.01
    full = np.where(near, [[rest[i, j] + 2.5 / (1 + similar.dtw(x, y)) for j, y in enumerate(rows)] for i, x in enumerate(rows)], -np.inf)
    got, count = warping.best_scores(rows, rows, near, rest, 2.5, 1.0)
    assert (got.argmax(axis=1) == full.argmax(axis=1)).all() and got.max(axis=1) == pytest.approx(full.max(axis=1))
    assert count < 2 * len(rows)


def pairs(spark, n, seed=3):
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.randint(0, 40), r.randint(0, 40), float(r.randint(0, 30)), 5) for _ in range(n)]
    rows += [("a", 1, 1, None, 0), (None, 1, 2, 3.0, 0), ("b", None, 2, 3.0, 0), ("a", 900, 901, 99.0, 1), ("a", 900, 901, 98.0, 1)]
    return spark.createDataFrame(rows, "problem string, l long, r long, score double, p int").repartition(3)


@pytest.mark.parametrize("task_pairs", [0, 50, 10_000])
def test_rounds_choose_what_the_sequential_choice_does(spark, task_pairs):
    df = pairs(spark, 1500)
    got = greedy.one_to_one_in_rounds(df, "problem", "l", "r", "score", task_pairs)
    used, want = set(), []
    for p, l, r, s in sorted({(x.problem, x.l, x.r, x.score) for x in df.dropna().collect()}, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if (p, "l", l) not in used and (p, "r", r) not in used:
            used |= {(p, "l", l), (p, "r", r)}
            want.append((p, l, r, s))
    assert sorted((x.problem, x.l, x.r, x.score) for x in got.collect()) == sorted(want)
    assert greedy.one_to_one_in_rounds(df.limit(0), "problem", "l", "r", "score", task_pairs).collect() == []


def test_left_rows_are_scored_some_at_a_time(spark):
    most = similar.AT_ONCE

    def score(l, r):
        assert len(l) <= most, "more rows at once than memory is meant for"
        return -np.abs(l.v.to_numpy(float)[:, None] - r.v.to_numpy(float))

    rows = spark.range(2 * most + 3).select("id", F.lit(1).alias("b"), F.col("id").cast("double").alias("v"))
    got = similar._best(rows, rows, "id", "b", {"v": "v"}, score, True).collect()
    assert sorted((r.id, r.match_id) for r in got) == [(i, max(i - 1, 0) or (i == 0)) if i < 2 else (i, i - 1) for i in range(2 * most + 3)]


def test_pairs_of_one_problem_are_not_gathered_by_it(spark, monkeypatch):
    marked = []
    monkeypatch.setattr(greedy, "light", lambda df: marked.append(df.columns) or F.broadcast(df))
    assert greedy.one_to_one_in_rounds(pairs(spark, 300), "problem", "l", "r", "score", 50).count() > 0
    assert marked and all(c == ["p", "large"] for c in marked)
