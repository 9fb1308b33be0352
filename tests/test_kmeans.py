"""k-means runs that share rounds, against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import kmeans


def points_of(n, d, seed, groups=4):
    rng = random.Random(seed)
    base = [[rng.random() for _ in range(d)] for _ in range(groups)]
    return [(i, [round(x + rng.random() * 0.4, 3) for x in base[i % groups]]) for i in range(n)]


def ranks(v):
    out = [0] * len(v)
    for r, i in enumerate(sorted(range(len(v)), key=lambda i: (v[i], i))):
        out[i] = r
    return out


def plain_loop(points, seeds, rounds):
    """One round after the other: (cluster and distance by id, settled)."""
    centres, last = [list(v) for v in seeds], None
    size = len(seeds[0])
    for _ in range(rounds):
        tops = [ranks(c) for c in centres]
        now = {i: min((sum(abs(a - b) for a, b in zip(ranks(v), t)), j) for j, t in enumerate(tops)) for i, v in points}
        if last == {i: j for i, (_, j) in now.items()}:
            return now, True
        last = {i: j for i, (_, j) in now.items()}
        for j in range(len(centres)):
            own = [v for i, v in points if last[i] == j]
            centres[j] = [sum(x) / len(own) for x in zip(*own)] if own else [0.0] * size
    return now, False


@pytest.mark.parametrize("rounds", [1, 2, 3, 40])
def test_shared_rounds_equal_the_plain_loop(spark, rounds):
    points = points_of(120, 12, 3, groups=7)
    table = kmeans.with_ranks(spark.createDataFrame(points, "id long, profile array<double>"))
    starts = [[1, 2, 3], [5, 50, 90, 7], [0, 1, 2, 3, 4, 5, 6]]
    runs = [kmeans.kmeans(table, len(s), rounds, init_ids=s) for s in starts]
    kmeans.solve(runs)
    for start, run in zip(starts, runs):
        want, _ = plain_loop(points, [dict(points)[i] for i in sorted(start)], rounds)
        assert {r.id: (int(r.dist), r.cluster) for r in run.assignment.collect()} == want
        assert abs(run.mean - np.mean([d for d, _ in want.values()])) < 1e-9


def test_circles_end_where_all_rounds_would(spark, monkeypatch):
    points = points_of(6, 4, 1)
    table = kmeans.with_ranks(spark.createDataFrame(points, "id long, profile array<double>"))
    ring = [[0.0, 1.0, 2.0, 3.0], [3.0, 2.0, 1.0, 0.0], [1.0, 0.0, 3.0, 2.0]]
    step = iter(range(1, 100))
    monkeypatch.setattr(kmeans, "_round", lambda p, c, size: {r: [(0, 6, 6.0, 6, ring[next(step) % 3])] for r in c})
    monkeypatch.setattr(kmeans, "_seeds", lambda runs: [[ring[0]]])
    for limit in (3, 4, 5, 10, 11, 12):
        step = iter(range(1, 100))
        run = kmeans.kmeans(table, 1, limit)
        kmeans.solve([run])
        assert not run.settled and run.rounds == limit and run.centres == [ring[limit % 3]] and len(run.history) == 3


def test_triangle_inequality_skips_and_changes_nothing(spark):
    points = points_of(1000, 20, 5, groups=10)
    all_ranks = np.array([ranks(v) for _, v in points])
    centres = all_ranks[:40]
    best, dist, computed = kmeans.assign(all_ranks, centres)
    full = np.abs(all_ranks[:, None] - centres[None]).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all()
    assert computed < 0.6 * full.size


def test_restarts_take_the_best_and_odd_rows(spark):
    points = points_of(60, 6, 9)
    df = spark.createDataFrame([*points, points[0], (None, points[1][1])], "id long, profile array<double>").withColumn("cluster", F.lit("own")).withColumn("dist", F.lit(-1))
    table = kmeans.with_ranks(df)
    got = kmeans.best_of_restarts(table, 4, restarts=3, rounds=20)
    alone = [kmeans.kmeans(table, 4, 20, s) for s in (1, 2, 3)]
    assert got.mean == min(x.mean for x in alone) and got.assignment.count() == 62
    assert 0 < got.computed <= got.possible
    assert kmeans.adaptive(df, most=4, restarts=2, rounds=5).columns == ["id", "cluster"]
    assert kmeans.adaptive(df.where("id < 0"), most=4, restarts=2, rounds=5).count() == 0
