"""Exact k-means over integer vectors, with bounds that are loosened by plane geometry.

Every vector keeps its cluster, its exact distance to that cluster's centroid, and a lower bound on its distance
to every other centroid. When centroids move, a vector whose new distance to its own centroid is below its
loosened lower bound, or below half the way from its centroid to the nearest other one, keeps its cluster
without a look at the other centroids. All others are scanned against all centroids in exact integers.

How much a lower bound must give way (``loosening``). Let a centroid move from a to b, let o be the middle of
the two, and x a vector. With s the coordinate of x - o along b - a,

    |x - a| - |x - b| = 2 |b - a| s / (|x - a| + |x - b|)  <=  |b - a| s / |x - o|  =  |b - a| cos(x - o, b - a),

as the two distances add up to twice |x - o| at least. All vectors of a cluster lie in the sphere round their
old centroid c that reaches to the farthest of them. Seen from o, in the plane through a, b and c, the sphere
fills the angles within asin(radius / |c - o|) of c's own angle, so the cosine is at most that of the
nearest edge. A centroid that moves sideways, or away from the sphere, loosens the cluster's bounds by
less than its drift, or not at all; the usual bound takes the full drift of the fastest centroid.

Everything a decision rests on is exact: distances are sums of whole numbers. Bounds are floats, and a vector is
only passed over if its bound is larger by a relative margin of 1e-9, which covers their rounding.

One round is one pass over the vectors, which writes them with their new state into the shared checkpoint folder,
and one aggregate of at most k rows: the vectors that changed cluster are added to the exact sums of their
new one and taken from those of the old one, so later rounds send few vectors through it. The state
of the round before is dropped when the next one is stored. Only k centroids with their sums are
at the driver; k and the number of components are parameters.

Vectors that are null, have another number of components, or hold a null or non-finite component are left out.
Repeated ids are vectors of their own; a vector without id comes last among the candidates for first
centroids. Ties of distance go to the smaller number; equal hashes (repeated ids) are ordered by their
components. With fewer vectors than centroids there are as many centroids as vectors; an empty table gives
an empty result. Other columns are not carried. A component beyond +-2^26 after scaling (about 262,144
before it) raises ValueError, as squared distances would leave a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.llm.exchange import arrow_schema, stored
from webtables.session import discard

MARGIN = 1e-9
#: Below this, sums of products of components are exact in doubles.
EXACT = 1 << 22
MOST = 1 << 26
STEP = 4096
_STATE = "vec_id long, vector array<double>, cluster int, was int, distance long, lower double, scanned boolean"


def whole_vectors(table: DataFrame, size: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector): floor(scale * x) of the finite vectors with ``size`` components, as doubles that are whole numbers."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = table.where(F.col(vector).isNotNull() & (F.size(vector) == size)).where(F.coalesce(finite, F.lit(False)))
    floors = F.transform(x, lambda v: F.floor(v * scale).cast("double"))
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), floors.alias("vector"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose hashed ids are smallest, in that order."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(named.asc_nulls_last(), "vector").limit(k).collect()
    return checked(np.array([r.vector for r in rows], np.float64))


def checked(x: np.ndarray) -> np.ndarray:
    if np.abs(x).max(initial=0) > MOST:
        raise ValueError(f"a component beyond {MOST}: squared distances would not fit a long")
    return x


def scan(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        out = (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)
        return out.astype(np.int64)
    x, centroids = x.astype(np.int64), centroids.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def own_distance(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    d = x - centroids[cluster]
    return ((d * d).sum(1) if np.abs(d).max(initial=0) < EXACT else (d.astype(np.int64) ** 2).sum(1)).astype(np.int64)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster: by how much any other centroid can have come nearer to any of its vectors.

    ``radius[i]`` is at least the distance of cluster i's farthest vector to ``old[i]`` (negative: no vectors).
    """
    move = new - old
    drift = np.sqrt((move * move).sum(1))
    middle = (old + new) / 2
    out = np.zeros(len(old))
    for i in range(len(old)):
        reach = radius[i] * (1 + MARGIN)
        way = old[i] - middle
        far = np.sqrt((way * way).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            angle = np.arccos(np.clip((way * move).sum(1) / (far * drift), -1, 1)) - np.arcsin(np.clip(reach / far, 0, 1))
        part = np.where(far > reach, np.cos(np.maximum(angle, 0)), 1.0)
        part = np.where(drift > 0, np.clip(part + MARGIN, 0, 1), 0) * drift
        part[i] = 0
        out[i] = part.max()
    return out


def half_gap(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one."""
    d = np.sqrt(scan(centroids, centroids).astype(float))
    np.fill_diagonal(d, np.inf)
    return d.min(1) / 2


def _assign(vectors: DataFrame, centroids: np.ndarray, loose: np.ndarray | None) -> DataFrame:
    """One round over all vectors; without ``loose`` they have no state yet and all are scanned."""
    schema, gap, size = arrow_schema(_STATE), half_gap(centroids), centroids.shape[1]

    def task(batches: Iterator) -> Iterator:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                lists = batch.column("vector")
                x = checked(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                n = len(x)
                if loose is None:
                    was, cluster, lower = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n)
                    distance, unsure = np.zeros(n, np.int64), np.ones(n, bool)
                else:
                    was = batch.column("cluster").to_numpy()
                    cluster, lower = was.copy(), batch.column("lower").to_numpy() - loose[was]
                    distance = own_distance(x, centroids, cluster)
                    unsure = np.sqrt(distance.astype(float)) * (1 + MARGIN) >= np.maximum(lower, gap[cluster]) * (1 - MARGIN)
                if unsure.any():
                    d = scan(x[unsure], centroids)
                    best = d.argmin(1)
                    row = np.arange(len(d))
                    cluster[unsure], distance[unsure] = best, d[row, best]
                    d[row, best] = np.iinfo(np.int64).max
                    lower[unsure] = np.sqrt(d.min(1).astype(float)) if len(centroids) > 1 else np.inf
                columns = [batch.column("vec_id"), lists, cluster, was, distance, lower, unsure]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)

    return vectors.mapInArrow(task, _STATE)


def _moved(state: DataFrame, size: int) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors gained, components gained)} in the last round; at most one row a cluster and task is shuffled."""
    ddl = "cluster int, n long, total array<long>"
    schema = arrow_schema(ddl)

    def task(batches: Iterator) -> Iterator:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            x = np.hstack([np.ones((len(x), 1), np.int64), x.astype(np.int64)])
            for column, sign in (("cluster", 1), ("was", -1)):
                own = batch.column(column).to_numpy()
                for c in np.unique(own[own >= 0]).tolist():
                    sums[c] = sums.get(c, 0) + sign * x[own == c].sum(0)
        rows = sorted(sums.items())
        columns = [[c for c, _ in rows], [int(v[0]) for _, v in rows], [v[1:].tolist() for _, v in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    parts = state.where("cluster <> was").select("cluster", "was", "vector").mapInArrow(task, ddl)
    totals = [F.sum(F.col("total")[k].cast("decimal(20,0)")).alias(f"t{k}") for k in range(size)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect()
    return {r.cluster: (r.n, [int(r[f"t{k}"]) for k in range(size)]) for r in rows}


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", size: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(state, centroids) after ``rounds`` updates and a last assignment.

    ``vectors`` has vec_id and vector (``whole_vectors``); state has vec_id, vector, cluster, distance (squared) and
    scanned (whether the last round had to compare the vector with all centroids).
    """
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.limit(0).selectExpr("vec_id", "vector", "0 AS cluster", "0L AS distance", "true AS scanned"), np.empty((0, size))
    held = [(0, [0] * size) for _ in centroids]
    state = stored(_assign(vectors, centroids, None))
    for _ in range(rounds):
        for c, (n, total) in _moved(state, size).items():
            held[c] = (held[c][0] + n, [a + b for a, b in zip(held[c][1], total)])
        new = np.array([[t // n for t in total] if n else list(old) for (n, total), old in zip(held, centroids)], np.float64)
        radius = np.full(len(centroids), -1.0)
        for r in state.groupBy("cluster").agg(F.max("distance").alias("far")).collect():
            radius[r.cluster] = np.sqrt(float(r.far))
        before, state = state, stored(_assign(state, new, loosening(centroids, new, radius)))
        discard(before)
        centroids = new
    return state.drop("was", "lower"), centroids


def centroid_hash(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def summary(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of a clustering; the table of clusters has k rows."""
    per = {r.cluster: int(r.s) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    total = sum(per.values())
    rows = [(c, s, total, centroid_hash(centroids[c])) for c, s in sorted(per.items())]
    clusters = state.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def skipped(state: DataFrame) -> Column:
    """Share of vectors that the last round passed over by their bounds."""
    return F.avg((~state["scanned"]).cast("double"))
