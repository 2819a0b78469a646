"""Centroid clustering in exact whole numbers, by Yinyang grouping.

Centroids are clustered into groups once.  Each vector keeps an upper bound of the distance
to its own centroid and one lower bound a group.  A round moves the bounds by how far the
centroids went: a vector whose upper bound lies below all lower bounds stays where it is; of
the others only the groups whose bound may be undercut are scanned, exactly.  The results are
those of scanning all centroids, ties included.

A round is one pass over the state, a table in the shared folder that the next round
replaces, and one grouping of it into sums, which each task adds up first.  Only ``k`` centroids and their
sums come to the driver; no vector is shuffled, so that hot clusters and repeated vectors cost
no more than others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.kernels import release
from ridgeline.llm.shared import Tables

#: Components of at least this size after scaling have no squared distance that a long is sure to hold.
MOST = 1 << 27
#: Below this size products of doubles are exact.
_DOUBLES = 1 << 22
#: Rows whose distances are computed at a time.
_ROWS = 4096


@dataclass(frozen=True)
class Clustering:
    k: int = 40
    rounds: int = 5
    size: int = 64  # components of a vector; others are left out
    scale: int = 256  # components become floor(scale * x)
    seed: int = 2
    per_group: int = 10  # centroids of a group on average

    @property
    def groups(self) -> int:
        return max(1, self.k // self.per_group)


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, s: Clustering) -> DataFrame:
    """``id, v``: the vectors of the right size without missing or non-finite components, in whole numbers."""
    def finite(x: Column) -> Column:
        d = x.cast("double")
        return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))

    def scaled(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(s.scale))
        held = F.abs(y) < F.lit(float(MOST))
        return F.when(held, F.floor(F.when(held, y)).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {s.scale} reaches {MOST}")).cast("int"))

    v = F.col(vector_col)
    there = rows.select(F.col(id_col).alias("id"), v.alias("v")).filter((F.size("v") == s.size) & F.forall("v", finite))
    return there.select("id", F.transform("v", scaled).alias("v"))


def seeds(vectors: DataFrame, s: Clustering) -> np.ndarray:
    """The first centroids: the ``k`` vectors with the smallest hash of seed and id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(s.k).collect()  # k rows
    return np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), s.size)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole vectors to centroids, exactly."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top < _DOUBLES:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), dtype=np.int64)
    for j, one in enumerate(c):
        out[:, j] = np.square(x - one).sum(1)
    return out


def grouped(centroids: np.ndarray, n: int, rounds: int = 5) -> list[np.ndarray]:
    """Numbers of the centroids of each group: centroids clustered among themselves."""
    own = centroids[np.linspace(0, len(centroids) - 1, n).astype(int)]
    for _ in range(rounds):
        near = squared(centroids, own).argmin(1)
        own = np.array([centroids[near == g].mean(0).astype(np.int64) if (near == g).any() else own[g] for g in range(n)])
    return [m for g in range(n) if len(m := np.flatnonzero(near == g))]


def _margin(x: np.ndarray) -> np.ndarray:
    """More than what rounding can add to a bound."""
    return 1e-9 * np.abs(x) + 1e-6


def assigned(x: np.ndarray, own: np.ndarray, bounds: np.ndarray | None, c: np.ndarray, moved: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (of equally near ones the smaller number), its new bounds, and how many distances that took.

    ``bounds`` holds the upper bound, then the groups' lower bounds, before the centroids went ``moved`` far; without them all are scanned.
    """
    n, scans = len(x), 0
    if bounds is None:
        rows, own = np.arange(n), np.zeros(n, dtype=np.int64)
        bounds = np.zeros((n, 1 + len(groups)))
    else:
        bounds = bounds.copy()
        bounds[:, 0] += moved[own]
        bounds[:, 1:] -= np.array([moved[g].max() for g in groups])
        rows = np.flatnonzero(bounds[:, 0] + _margin(bounds[:, 0]) >= bounds[:, 1:].min(1))
    if not len(rows):
        return own, bounds, scans
    own = own.copy()
    old = own[rows]
    best = old.copy()
    there = np.empty(len(rows), dtype=np.int64)
    for k in np.unique(old):
        of = old == k
        there[of] = squared(x[rows[of]], c[k : k + 1])[:, 0]
    scans += len(rows)
    least = there.copy()
    up, low = np.sqrt(there.astype(np.float64)), bounds[rows, 1:]
    scan = low <= (up + _margin(up))[:, None]
    firsts, seconds, places = np.empty(low.shape), np.full(low.shape, np.inf), np.empty(low.shape, dtype=np.int64)
    for g, members in enumerate(groups):
        at = np.flatnonzero(scan[:, g])
        if not len(at):
            continue
        d = squared(x[rows[at]], c[members])
        scans += d.size
        i = d.argmin(1)
        first = d[np.arange(len(at)), i]
        firsts[at, g], places[at, g] = np.sqrt(first.astype(np.float64)), members[i]
        if len(members) > 1:
            seconds[at, g] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
        nearer = (first < least[at]) | ((first == least[at]) & (members[i] < best[at]))
        best[at[nearer]], least[at[nearer]] = members[i[nearer]], first[nearer]
    lows = np.where(scan, np.where(places == best[:, None], seconds, firsts), low)
    left = best != old
    for g, members in enumerate(groups):  # the centroid that was left is now one of its group's others
        of = left & ~scan[:, g] & np.isin(old, members)
        lows[of, g] = np.minimum(lows[of, g], up[of])
    own[rows] = best
    bounds[rows, 0], bounds[rows, 1:] = np.sqrt(least.astype(np.float64)), lows
    return own, bounds, scans


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.ravel()))


def _pass(state: DataFrame, c: np.ndarray, moved: np.ndarray, groups: list[np.ndarray], first: bool) -> DataFrame:
    """``id, v, cluster, distance, bounds, scans`` of one assignment; ``scans`` is the number of distances computed for the row's slice."""
    size = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), _ROWS):
                part = batch.slice(i, _ROWS)
                x = _matrix(part.column("v"), size, np.int64)
                own = None if first else part.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                own, bounds, scans = assigned(x, own, None if first else _matrix(part.column("bounds"), 1 + len(groups), np.float64), c, moved, groups)
                share = np.zeros(len(x), dtype=np.int64)
                share[:1] = scans
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("v"), pa.array(own.astype(np.int32)), pa.array(np.square(x - c[own]).sum(1)), _lists(bounds), pa.array(share)],
                    names=["id", "v", "cluster", "distance", "bounds", "scans"],
                )
        release()

    kind = state.schema["id"].dataType.simpleString()
    return state.mapInArrow(run, f"id {kind}, v array<int>, cluster int, distance long, bounds array<double>, scans long")


def _moved_to_means(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of the mean of its vectors; centroids without vectors stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(c), dtype=np.int64), np.zeros(c.shape, dtype=np.int64)
        for batch in batches:
            own = batch.column("cluster").to_numpy(zero_copy_only=False)
            np.add.at(n, own, 1)
            np.add.at(sums, own, _matrix(batch.column("v"), c.shape[1], np.int64))
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), _lists(sums[full])], names=["cluster", "n", "sums"])

    own = state.select("cluster", "v").mapInArrow(run, "cluster int, n long, sums array<long>")  # k rows a task
    each = own.select("cluster", "n", F.posexplode("sums").alias("j", "x")).groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = c.copy()
    for r in each.collect():  # a row for each centroid and component
        out[r.cluster, r.j] = r.x // r.n
    return out


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", s: Clustering = Clustering()) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector of the right size.

    Vectors that are missing, of another size, or with a missing or non-finite component are
    left out; rows without id stay, and their seed is that of the empty text; repeated rows
    and equal vectors are all kept; with fewer than ``k`` vectors there are as many centroids
    as vectors; an empty table gives no rows.  Other columns, of any name, are not read.  A
    component that reaches ``MOST`` after scaling fails the job, as its distance fits no long.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col, s)
    kind = vectors.schema["id"].dataType.simpleString()
    c = seeds(vectors, s)
    if not len(c):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    groups = grouped(c, min(s.groups, len(c)))
    kept = Tables(spark, "clusters")
    state = kept.keep("state0", _pass(vectors, c, np.zeros(len(c)), groups, first=True))
    for i in range(1, s.rounds + 1):
        new = _moved_to_means(state, c)
        moved = np.sqrt(np.square((new - c).astype(np.float64)).sum(1)) * (1 + 1e-12)
        c = new
        state = kept.keep(f"state{i}", _pass(state, c, moved, groups, first=False))
        kept.drop(f"state{i - 1}")
    inertia = {r.cluster: r.d for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    of = spark.createDataFrame([(i, d, sum(inertia.values()), digests[i]) for i, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = state.select("id", "cluster", "distance").join(F.broadcast(of), "cluster")
    return out.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
