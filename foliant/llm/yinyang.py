"""Exact integer k-means with Yinyang bounds.

Centroids are put into groups once. Every vector keeps an upper bound of the distance to its own centroid and one lower
bound for each group; both are moved by how far centroids went. A vector whose upper bound is below all lower bounds
keeps its centroid unseen (global filter); of the others only groups whose lower bound is reached are looked at (group
filter), and their centroids are compared exactly, in integers. Bounds are floats with slack, so they only ever cause a
comparison too many. The state of a round is a written table that the next one maps, without a shuffle; sums are
aggregated by cluster, and of a round only as many rows as there are clusters come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.workspace import Workspace

COMPONENTS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Centroids for each group, about.
GROUP = 10
#: Components are held within this bound, so that squared distances fit a long; beyond it they count as the bound.
MOST = 1 << 26
#: Below this bound products of components sum up exactly in doubles.
EXACT = 1 << 22
SLACK = 1e-9


def centroid_groups(centroids: np.ndarray, rounds: int = 5) -> np.ndarray:
    """A group number for each centroid, by a few rounds of k-means over the centroids themselves."""
    points = centroids.astype(float)
    count = max(1, -(-len(points) // GROUP))
    centres = points[np.linspace(0, len(points) - 1, count).astype(int)]
    for _ in range(rounds):
        near = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(count):
            if (near == g).any():
                centres[g] = points[near == g].mean(axis=0)
    return np.unique(near, return_inverse=True)[1]


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Rows x centroids, exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, c = x.astype(float), centroids.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def own_distances(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(axis=1)


class Move:
    """Where the centroids are in a round, and how far they went since the last."""

    def __init__(self, centroids: np.ndarray, groups: np.ndarray, before: np.ndarray | None):
        self.centroids, self.groups = centroids, groups
        old = centroids if before is None else before
        self.drift = np.sqrt(((centroids - old) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        self.reach = np.array([self.drift[groups == g].max() for g in range(groups.max() + 1)])
        self.slack = SLACK * (1 + np.sqrt((centroids.astype(float) ** 2).sum(axis=1)).max())

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, upper bound and lower bounds of vectors that have none yet."""
        n = len(x)
        start = np.zeros(n, np.int64)
        return self.settle(x, start, np.full(n, np.inf), np.full((n, len(self.reach)), -np.inf))

    def next(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.settle(x, cluster, upper + self.drift[cluster], lower - self.reach[None, :])

    def settle(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        within = lambda rows: lower[rows] <= upper[rows][:, None] * (1 + SLACK) + self.slack
        rows = np.flatnonzero(within(slice(None)).any(axis=1))
        own = own_distances(x[rows], self.centroids, cluster[rows])
        upper[rows] = np.sqrt(own.astype(float))
        near = within(rows)
        some = near.any(axis=1)
        rows, near, own = rows[some], near[some], own[some]
        # The least distance; of equal ones the centroid with the smaller number.
        best, least = cluster[rows].copy(), own.copy()
        seen: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for g in range(len(self.reach)):
            at = np.flatnonzero(near[:, g])
            if not len(at):
                continue
            members = np.flatnonzero(self.groups == g)
            d = squared_distances(x[rows[at]], self.centroids[members])
            seen.append((g, at, members, d))
            nearest = d.argmin(axis=1)  # the first of equal ones, and members ascend
            low, name = d[np.arange(len(at)), nearest], members[nearest]
            closer = (low < least[at]) | ((low == least[at]) & (name < best[at]))
            least[at[closer]], best[at[closer]] = low[closer], name[closer]
        left = best != cluster[rows]
        # A centroid that a vector leaves counts in the bound of its group, where that group wasn't looked at.
        home = self.groups[cluster[rows[left]]]
        lower[rows[left], home] = np.minimum(lower[rows[left], home], np.sqrt(own[left].astype(float)))
        for g, at, members, d in seen:
            others = np.where(members[None, :] == best[at][:, None], np.iinfo(np.int64).max, d).min(axis=1)
            lower[rows[at], g] = np.where(others == np.iinfo(np.int64).max, np.inf, np.sqrt(others.astype(float)))
        cluster[rows], upper[rows] = best, np.sqrt(least.astype(float))
        return cluster, upper, lower


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def assigned(state: DataFrame, move, components: int, first: bool, last: bool) -> DataFrame:
    """The state of the next round; in the last one vec_id, cluster and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = move.value
        groups = len(to.reach)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), components, np.int64)
            if first:
                cluster, upper, lower = to.first(x)
            else:
                held = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().copy(), _matrix(batch.column(4), groups, float)
                cluster, upper, lower = to.next(x, *held)
            named = pa.array(cluster.astype(np.int32))
            if last:
                yield pa.RecordBatch.from_arrays([batch.column(0), named, pa.array(own_distances(x, to.centroids, cluster))], ["vec_id", "cluster", "distance"])
                continue
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * groups)
            bounds = pa.ListArray.from_arrays(at, pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), named, pa.array(upper), bounds], ["vec_id", "x", "cluster", "upper", "lower"])

    schema = "vec_id long, cluster int, distance long" if last else "vec_id long, x array<int>, cluster int, upper double, lower array<double>"
    return state.mapInArrow(run, schema)


def cluster(vectors: DataFrame, *, clusters: int = CLUSTERS, components: int = COMPONENTS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each vector that is kept.

    Kept are rows with a vec_id and exactly `components` components, none null or non-finite; each component becomes
    floor(scale * x), held within plus or minus 2**26. The first centroids are the vectors with the least sha256 of
    `seed:vec_id`, of equal ids the lesser components; if there are fewer vectors than `clusters`, each is one. After
    `rounds` of assigning and replacing, vectors are assigned once more; of equally near centroids the smaller number
    wins, and empty ones stay. Repeated rows count as often as they occur, each with a row of its own, and may be two
    first centroids, of which the later one stays empty. An empty table, or one without a kept vector, gives an empty
    result. An inertia that doesn't fit a long is null. Columns besides vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "yinyang")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") == components) & finite, F.lit(False))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    state = work.put(vectors.where(sound).select(F.col("vec_id").cast("long"), whole.alias("x")), "vectors")
    # A row for each cluster comes to the driver.
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = np.array([r["x"] for r in state.orderBy(drawn, "x").limit(clusters).collect()], np.int64).reshape(-1, components)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    groups, before = centroid_groups(centroids), None
    sums = [F.sum(F.get("x", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(components)]
    for turn in range(rounds + 1):
        move = spark.sparkContext.broadcast(Move(centroids, groups, before))
        last = turn == rounds
        now = work.put(assigned(state, move, components, turn == 0, last), f"round-{turn}")
        work.only(now)
        state = now
        if not last:
            before, centroids = centroids, centroids.copy()
            for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
                centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(components)]
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(wide.alias("d")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = [(c, fits(d), fits(sum(inertia.values())), digest(c)) for c, d in sorted(inertia.items())]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # As many rows as clusters.
    return state.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
