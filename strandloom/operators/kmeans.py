"""k-means on rank vectors, and merging of clusters.

Points are (id, profile array<double>), written once with their ranks; they never leave the executors and are not
written again. Any number of runs (restarts) go through the same rounds together: a round is one job that
reads the points, assigns each to the nearest centre of every run, and adds up means, distances
and counts by run and cluster in one aggregation. The driver holds the centres, at most k vectors a run, and sends them as one broadcast.

Assignments depend on the ranks of the centres alone. So a run has settled when those stay as they were, and once they are
as in an earlier round the run goes round in a circle: its last round is then known without running
the others. Footrule is a metric: a centre at twice a point's distance or more from the
point's best centre so far is not nearer, and its distance is not computed. (Bounds kept for each point
would skip more, but rewriting them with the points in every round costs more than the distances do.)

Empty tables give no centres. Repeated points count each. Points with a null id or extra columns are points as others; a null profile is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.distance import footrule, l1
from strandloom.runtime import checkpoint, ship_package


def rank_array(v: Column | str) -> Column:
    """Ranks from 0 of an array's values, ties by index."""
    v = F.col(v) if isinstance(v, str) else v
    order = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    placed = F.array_sort(F.transform(order, lambda o, r: F.struct(o["i"].alias("i"), r.alias("r"))))
    return F.transform(placed, lambda p: p["r"])


def shared_rank_array(v: Column | str) -> Column:
    """Ranks from 0 where equal values share the smallest."""
    v = F.col(v) if isinstance(v, str) else v
    ordered = F.array_sort(v)
    return F.transform(v, lambda x: F.array_position(ordered, x) - 1)


def swap_rank_array(v: Column | str) -> Column:
    """Ranks from 0 as a selection sort gives them: the first smallest of what is left changes places with the first of it, so equal values may change their order."""
    v = F.col(v) if isinstance(v, str) else v
    order = F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    def swap(left: Column, i: Column) -> Column:
        rest = F.transform(F.slice(left, i + 1, F.size(left) - i), lambda e: e["x"])
        small = (F.array_position(rest, F.array_min(rest)) - 1 + i).cast("int")
        moved = F.transform(F.array(small), lambda s: F.transform(left, lambda e, j: F.when(j == i, F.get(left, s)).when(j == s, F.get(left, i)).otherwise(e)))
        return F.get(moved, F.lit(0))

    places = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    placed = F.array_sort(F.transform(F.aggregate(places, order, swap), lambda e, r: F.struct(e["i"].alias("i"), r.alias("r"))))
    return F.transform(placed, lambda p: p["r"])


def _ranks(v: list[float]) -> list[int]:
    out = [0] * len(v)
    for r, i in enumerate(sorted(range(len(v)), key=lambda i: (v[i], i))):
        out[i] = r
    return out


def nearest(points: DataFrame, centres: list[list[float]], of: str = "ranks", distance=footrule) -> DataFrame:
    """``points`` with cluster and dist: the nearest centre, the first of equals."""
    options = [F.struct(distance(F.col(of), F.array(*map(F.lit, c))).alias("dist"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]
    best = F.array_min(F.array(*options))
    return points.withColumn("_b", best).withColumns({"cluster": F.col("_b.cluster"), "dist": F.col("_b.dist")}).drop("_b")


def centroids(assigned: DataFrame, size: int) -> dict[int, list[float]]:
    """Mean profile of each cluster that has members."""
    sums = [F.avg(F.get("profile", F.lit(i))).alias(f"c{i}") for i in range(size)]
    return {r["cluster"]: [r[f"c{i}"] for i in range(size)] for r in assigned.groupBy("cluster").agg(*sums).collect()}


@dataclass
class Result:
    assignment: DataFrame  # id, cluster, dist
    centres: list[list[float]]
    rounds: int
    settled: bool  # no point moved in the last round
    mean: float | None = None  # of the distances
    computed: int = 0  # distances that were computed, of points times centres times rounds that ran
    possible: int = 0


@dataclass
class Run:
    """A run of k-means that is carried out when something of its result is asked for, or before, together with others, by ``solve``."""

    points: DataFrame  # id, profile, ranks
    k: int
    limit: int
    seed: int
    init_ids: list[int] | None = None
    result: Result | None = None
    # a row for each round that ran: centres, and (n, sum of distances, means) of its clusters
    history: list[tuple[list[list[float]], float]] = field(default_factory=list)
    seen: dict[bytes, int] = field(default_factory=dict)

    def _solved(self) -> Result:
        if self.result is None:
            solve([self])
        return self.result

    assignment = property(lambda self: self._solved().assignment)
    centres = property(lambda self: self._solved().centres)
    rounds = property(lambda self: self._solved().rounds)
    settled = property(lambda self: self._solved().settled)
    mean = property(lambda self: self._solved().mean)
    computed = property(lambda self: self._solved().computed)
    possible = property(lambda self: self._solved().possible)


def with_ranks(points: DataFrame) -> DataFrame:
    """id, profile and ranks of the points, written as a table; one that has ranks is taken as it is."""
    return points if "ranks" in points.columns else checkpoint(points.select("id", "profile", rank_array("profile").alias("ranks")))


def kmeans(points: DataFrame, k: int = 50, rounds: int = 100, seed: int = 1, init_ids: list[int] | None = None) -> Run:
    """Footrule k-means: ranks decide the assignment, profiles the means; ends when no point moves, or after ``rounds``, then perhaps not ``settled``.

    Seeds are ``init_ids``, or k distinct points in a random order fixed by ``seed``. A
    cluster without members keeps a centre of zeros. The run is a promise: its result is made when it is looked at, or by ``solve``.
    """
    return Run(with_ranks(points), k, rounds, seed, init_ids)


def assign(ranks: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centre, distance) of each row, the first of equals, and how many distances were computed."""
    between = np.abs(centres[:, None] - centres[None]).sum(axis=2)
    best, dist = np.zeros(len(ranks), dtype=np.int64), np.abs(ranks - centres[0]).sum(axis=1)
    computed = len(ranks)
    for j in range(1, len(centres)):
        near = np.flatnonzero(between[best, j] < 2 * dist)
        far = np.abs(ranks[near] - centres[j]).sum(axis=1)
        nearer = far < dist[near]
        best[near[nearer]], dist[near[nearer]] = j, far[nearer]
        computed += len(near)
    return best, dist, computed


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _round(points: DataFrame, centres: dict[int, np.ndarray], size: int) -> dict[int, list[tuple[int, int, float, int, list[float]]]]:
    """For each run: (cluster, members, sum of distances, distances computed, mean profile) of each cluster that has members."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            profile, ranks = _matrix(batch.column(0), "f8"), _matrix(batch.column(1), "i8")
            rows: dict[str, list] = {"run": [], "cluster": [], "n": [], "dist": [], "computed": [], "sums": []}
            for r, own in shared.value.items():
                best, dist, computed = assign(ranks, own)
                for c in np.unique(best).tolist():
                    mine = best == c
                    for name, x in (("run", r), ("cluster", c), ("n", int(mine.sum())), ("dist", float(dist[mine].sum())), ("computed", computed), ("sums", profile[mine].sum(axis=0))):
                        rows[name].append(x)
                    computed = 0
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], names=list(rows))

    found = points.select("profile", "ranks").mapInArrow(run, "run int, cluster int, n long, dist double, computed long, sums array<double>")
    total = [F.sum(c).alias(c) for c in ("n", "dist", "computed")] + [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)]
    out: dict[int, list] = {r: [] for r in centres}
    for row in found.groupBy("run", "cluster").agg(*total).collect():
        out[row["run"]].append((row["cluster"], row["n"], row["dist"], row["computed"], [row[f"s{i}"] / row["n"] for i in range(size)]))
    shared.unpersist()
    return out


def _assignment(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """id, cluster, dist under these centres."""
    shared = points.sparkSession.sparkContext.broadcast(np.array([_ranks(c) for c in centres], dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, dist, _ = assign(_matrix(batch.column(1), "i8"), shared.value)
                yield pa.record_batch({"id": batch.column(0), "cluster": pa.array(best, pa.int32()), "dist": pa.array(dist, pa.float64())})

    return points.select("id", "ranks").mapInArrow(run, f"id {dict(points.dtypes)['id']}, cluster int, dist double")


def _seeds(runs: list[Run]) -> list[list[list[float]]]:
    """The first centres of each run, all with one job."""
    parts = []
    for r, run in enumerate(runs):
        key = F.lit(0).cast("long") if run.init_ids else F.xxhash64("id", F.lit(run.seed))
        rows = run.points.select(F.lit(r).alias("run"), key.alias("key"), "id", "profile")
        parts.append(rows.where(F.col("id").isin(run.init_ids)) if run.init_ids else rows.orderBy("key", "id").limit(run.k))
    out: list[list] = [[] for _ in runs]
    for row in sorted(reduce(DataFrame.unionByName, parts).collect(), key=lambda x: (x["run"], x["key"], x["id"] is None, x["id"])):
        out[row["run"]].append(list(row["profile"]))
    return out


def solve(runs: list[Run]) -> None:
    """Carry out those of ``runs`` that have no result yet; those over the same table share every round."""
    ship_package(runs[0].points.sparkSession) if runs else None
    tables: dict[int, list[Run]] = {}
    for run in runs:
        if run.result is None:
            tables.setdefault(id(run.points), []).append(run)
    for own in tables.values():
        _solve_together(own)


def _solve_together(runs: list[Run]) -> None:
    points, centres = runs[0].points, _seeds(runs)
    counted = {r: [0, 0] for r in range(len(runs))}
    active = []
    for r, run in enumerate(runs):
        if centres[r]:
            active.append(r)
        else:
            run.result = Result(points.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("dist")), [], 0, True)
    while active:
        for r in list(active):
            run, key = runs[r], np.array([_ranks(c) for c in centres[r]]).tobytes()
            n, back = len(run.history) + 1, run.seen.get(key)
            if n > run.limit or back is not None:
                _finish(run, centres[r], n, back, counted[r])
                active.remove(r)
            else:
                run.seen[key] = n
        if not active:
            break
        found = _round(points, {r: np.array([_ranks(c) for c in centres[r]], dtype=np.int64) for r in active}, len(centres[active[0]][0]))
        for r in active:
            members = sum(n for _, n, _, _, _ in found[r])
            runs[r].history.append((centres[r], sum(d for _, _, d, _, _ in found[r]) / members))
            means = {c: mean for c, _, _, _, mean in found[r]}
            centres[r] = [means.get(i, [0.0] * len(c)) for i, c in enumerate(centres[r])]
            counted[r][0] += sum(x for _, _, _, x, _ in found[r])
            counted[r][1] += members * len(centres[r])


def _finish(run: Run, centres: list[list[float]], n: int, back: int | None, counted: list[int]) -> None:
    """Rounds 1 to n - 1 of ``run`` ran; round ``n`` would have the ranks of round ``back``, if that is given."""
    if back == n - 1:  # no centre's ranks changed
        used, mean = run.history[back - 1]
        run.result = Result(_assignment(run.points, used), centres, n, True, mean, *counted)
        return
    last, after = n - 1, centres
    if back is not None:  # a circle: the last round is one of those that ran
        last = back + (run.limit - back) % (n - back)
        after = run.history[last][0] if last < n - 1 else centres
    used, mean = run.history[last - 1]
    run.result = Result(_assignment(run.points, used), after, run.limit, False, mean, *counted)


def truncated_centroids(assigned: DataFrame) -> DataFrame:
    """cluster, idx, value: the whole part of the mean of integer profiles (column ``counts``)."""
    rows = assigned.select("cluster", F.posexplode("counts").alias("idx", "x"))
    return rows.groupBy("cluster", "idx").agg(F.expr("sum(x) div count(x)").alias("value"))


def distance_statistics(assigned: DataFrame) -> DataFrame:
    """cluster, n, mean, sd of the members' distances to their centre."""
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("mean"), F.coalesce(F.stddev_samp("dist"), F.lit(0.0)).alias("sd"))


def outliers(assigned: DataFrame, deviations: float = 2.0) -> DataFrame:
    """Points farther from their centre than the cluster's mean and ``deviations`` standard deviations."""
    far = F.col("dist") > F.col("mean") + F.lit(deviations) * F.col("sd")
    return assigned.join(distance_statistics(assigned), "cluster").where(far).select("id", "cluster", "dist")


def intra_distances(assigned: DataFrame, centres: list[list[float]]) -> dict[int, float]:
    return {r["cluster"]: r["mean"] for r in distance_statistics(assigned).collect()}


def merge_by_ratio(inter: dict[tuple[int, int], float], intra: dict[int, float], threshold: float, least: int = 4) -> dict[int, int]:
    """Clusters to merge: i and j join where threshold * inter <= mean of their intra distances, while more than ``least`` remain."""
    into = {i: i for i in intra}

    def find(i: int) -> int:
        while into[i] != i:
            i = into[i]
        return i

    for (i, j), d in sorted(inter.items(), key=lambda x: (x[1], x[0])):
        a, b = find(i), find(j)
        if a != b and threshold * d <= (intra[i] + intra[j]) / 2 and len({find(x) for x in into}) > least:
            into[max(a, b)] = min(a, b)
    return {i: find(i) for i in into}


def centre_distances(centres: list[list[float]]) -> dict[tuple[int, int], float]:
    """Footrule of each pair of centres' ranks."""
    ranks = [_ranks(c) for c in centres]
    return {(i, j): float(sum(abs(a - b) for a, b in zip(ranks[i], ranks[j]))) for i in range(len(ranks)) for j in range(i + 1, len(ranks))}


def agglomerate(centres: list[list[float]], weight: dict[int, int], intra: dict[int, float], threshold: float = 0.94, least: int = 1) -> dict[int, int]:
    """Merge the pair of smallest distance with (intra_i + intra_j) / inter > 2 * threshold, average by weight, and repeat."""
    alive = {i: list(c) for i, c in enumerate(centres) if weight.get(i)}
    weight, intra, into = dict(weight), dict(intra), {i: i for i in alive}
    while len(alive) > least:
        ids = sorted(alive)
        pairs = centre_distances([alive[i] for i in ids])
        fits = [(d, ids[a], ids[b]) for (a, b), d in pairs.items() if d == 0 or (intra[ids[a]] + intra[ids[b]]) / d > 2 * threshold]
        if not fits:
            break
        _, i, j = min(fits)
        wi, wj = weight[i], weight[j]
        alive[i] = [(wi * x + wj * y) / (wi + wj) for x, y in zip(alive[i], alive[j])]
        intra[i] = (wi * intra[i] + wj * intra[j]) / (wi + wj)
        weight[i] = wi + wj
        del alive[j]
        into = {k: i if v == j else v for k, v in into.items()}
    return into


def best_of_restarts(points: DataFrame, k: int, restarts: int = 10, rounds: int = 200, seed: int = 1) -> Result | Run:
    """The run with the smallest mean distance. All runs share their rounds."""
    points = with_ranks(points)
    runs = [kmeans(points, k, rounds, seed + r) for r in range(restarts)]
    solve([x for x in runs if isinstance(x, Run)])
    means = [x.assignment.agg(F.avg("dist")).first()[0] if x.mean is None else x.mean for x in runs]
    return runs[min(range(restarts), key=lambda r: (means[r] or 0.0, r))]


def adaptive(points: DataFrame, most: int = 10, least: int = 1, threshold: float = 0.94, restarts: int = 10, seed: int = 1, rounds: int = 200) -> DataFrame:
    """id and cluster with a number of clusters found by merging: restart with what is left until less than a tenth merges."""
    k, points = most, with_ranks(points)
    while True:
        got = best_of_restarts(points, k, restarts, rounds, seed)
        stats = {r["cluster"]: r for r in distance_statistics(got.assignment).collect() if r["cluster"] is not None}
        into = agglomerate(got.centres, {i: r["n"] for i, r in stats.items()}, {i: r["mean"] for i, r in stats.items()}, threshold, least)
        left = len(set(into.values()))
        merged = len(stats) - left
        if merged < 0.1 * max(1, len(stats)) or left <= least or left >= k:
            table = F.create_map(*[F.lit(x) for kv in into.items() for x in kv]) if into else F.create_map(F.lit(0), F.lit(0))
            return got.assignment.select("id", table[F.col("cluster")].alias("cluster"))
        k = max(least, left)


__all__ = ["Result", "Run", "adaptive", "agglomerate", "best_of_restarts", "centroids", "kmeans", "l1", "nearest", "outliers", "rank_array", "shared_rank_array", "solve"]
