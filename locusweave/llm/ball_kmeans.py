"""Exact k-means over integer vectors by balls.

A cluster is a ball: its centroid and the reach of the vectors that live in it.  Every vector keeps a home ball; with d the distance to
the home's centroid, only centroids within 2 d of that one can be closer.  Centroids further than twice the reach are no neighbours
of the ball at all; the others, in order of distance, cut the ball into a core (no neighbour within 2 d: nothing is compared) and annuli
(the n-th holds the vectors with n neighbours within 2 d: just these are compared).  All comparisons are of exact integers, so the result
is that of plain k-means.

A round is one scan of the table of balls; a task sends one row for each centroid (count, component sums, reach, inertia), and the
driver holds nothing but the k centroids.  The home of a vector need not be its cluster of the round before, so the table is written again only
where more than REHOME of the vectors live elsewhere by now; that changes the work, not the result.

Defined cases: vectors that are null, of another width, or hold a null, NaN or infinite component, or one of 2^62 or more after
scaling, are left out.  Fewer vectors than k make fewer centroids; none make an empty result.  Repeated rows count as often as they
stand there; among first centroids of one id the order is that of the components.  A null id is kept and is the last choice as first centroid.
Sums and distances are exact at any size; a distance or inertia beyond a long is null.  Columns besides the id are not kept, whatever their names."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import delete_paths, give_back, shared_path

REHOME = 0.25  # share of vectors outside their home ball from which on the table is written again
SMALL = 1 << 26  # below this, distances of up to 64 components fit 64-bit integers
LONG = 1 << 63
_TOTAL = pa.decimal128(38, 0)


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, q): floor(scale * component) of the vectors that are kept, as bigints."""
    x = F.col(vec_col).cast("array<double>")
    scaled = F.transform(x, lambda c: c * F.lit(float(scale)))
    fits = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**62)))
    kept = vectors.select(F.col(id_col).alias("vec_id"), scaled.alias("q")).filter(F.col("q").isNotNull() & (F.size("q") == dims) & F.coalesce(fits, F.lit(False)))
    return kept.select("vec_id", F.transform("q", lambda c: F.floor(c).cast("bigint")).alias("q"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest sha256 of `seed:id` (at most k rows come to the driver)."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.q) for r in kept.select("q", named.alias("h")).orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()]


def _distance(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = q - c
    return (d * d).sum(axis=1)


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as 64-bit integers where distances fit, else as Python integers."""
    if all(not a.size or max(-int(a.min()), int(a.max())) < SMALL for a in arrays) and arrays[0].shape[1] <= 64:
        return list(arrays)
    return [a.astype(object) for a in arrays]


class Balls:
    """The centroids of a round, and for each ball its neighbours in order of distance.

    reach[b] is an upper bound of the distance of the vectors that live in b to its centroid (rounded up); None: not known,
    then all other centroids are neighbours."""

    def __init__(self, centroids: list[list[int]], reach: list[int | None]):
        self.c = centroids
        self.between = [[sum((x - y) ** 2 for x, y in zip(a, b)) for b in centroids] for a in centroids]
        self.near: list[list[int]] = []
        for b in range(len(centroids)):
            far = [o for o in range(len(centroids)) if o != b and (reach[b] is None or self.between[b][o] <= 4 * reach[b] ** 2)]
            self.near.append(sorted(far, key=lambda o: (self.between[b][o], o)))

    def assign(self, home: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, squared distance to the home's centroid) of each vector, and the number of distances counted."""
        q, c = _exact(q, np.array(self.c, dtype=np.int64).reshape(len(self.c), -1))
        own, cluster = np.zeros(len(q), q.dtype), home.copy()
        counted = len(q)
        for b in np.unique(home).tolist():
            rows = np.flatnonzero(home == b)
            own[rows] = _distance(q[rows], c[b])
        best = own.copy()
        for b in np.unique(home).tolist():
            rows = np.flatnonzero(home == b)
            edges = np.array([self.between[b][o] for o in self.near[b]], dtype=own.dtype if own.dtype == object else np.int64)
            annulus = np.searchsorted(edges, 4 * own[rows], "right")  # neighbours within twice the distance; 0: the core
            for n, other in enumerate(self.near[b]):
                met = rows[annulus > n]
                if not len(met):
                    break
                counted += len(met)
                d = _distance(q[met], c[other])
                wins = (d < best[met]) | (d == best[met]) & (other < cluster[met])
                best[met[wins]], cluster[met[wins]] = d[wins], other
        return cluster, best, own, counted


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _totals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], _TOTAL)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array([int(v) if v < LONG else None for v in values] if values.dtype == object else values, pa.int64())


def _homes(kept: DataFrame, balls: Balls) -> DataFrame:
    """(vec_id, q, home): each vector in the ball of its cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home = batch.column("home").to_numpy().copy() if "home" in batch.schema.names else np.zeros(batch.num_rows, np.int32)
                cluster = balls.assign(home, _vectors(batch))[0]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.array(cluster.astype(np.int32))], ["vec_id", "q", "home"])
        give_back()

    return kept.mapInArrow(run, f"vec_id {dict(kept.dtypes)['vec_id']}, q array<bigint>, home int")


def _written(homes: DataFrame) -> tuple[DataFrame, str]:
    path = shared_path(homes.sparkSession, "balls")
    homes.write.parquet(path)
    return homes.sparkSession.read.schema(homes.schema).parquet(path), path


def _measure(table: DataFrame, balls: Balls) -> tuple[dict[int, tuple[int, list[int]]], list[int], int, int, list[int]]:
    """One scan: (count and component sums of each cluster, squared reach of each home ball, vectors outside their home, distances
    counted, inertia of each cluster)."""
    k = len(balls.c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, away, met = [0] * k, [0] * k, [0] * k
        sums: list = [0] * k
        reach, inertia = [0] * k, [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            home, q = batch.column("home").to_numpy(), _vectors(batch)
            cluster, best, own, counted = balls.assign(home, q)
            met[0] += counted
            wide = q.astype(object) if max(-int(q.min()), int(q.max())) >= 1 << 40 else q
            for b in np.unique(np.concatenate([cluster, home])).tolist():
                mine, lives = cluster == b, home == b
                if mine.any():
                    n[b] += int(mine.sum())
                    sums[b] = sums[b] + wide[mine].sum(axis=0).astype(object)
                    inertia[b] += int(best[mine].astype(object).sum())
                if lives.any():
                    reach[b] = max(reach[b], int(own[lives].max()))
                    away[b] += int((cluster[lives] != b).sum())
        held = [b for b in range(k) if n[b] or away[b] or reach[b] or met[b]]
        if held:
            totals = pa.array([[Decimal(int(v)) for v in sums[b]] if n[b] else None for b in held], pa.list_(_TOTAL))
            columns = [pa.array(held, pa.int32()), pa.array([n[b] for b in held], pa.int64()), totals, _totals([reach[b] for b in held])]
            columns += [pa.array([away[b] for b in held], pa.int64()), pa.array([met[b] for b in held], pa.int64()), _totals([inertia[b] for b in held])]
            yield pa.RecordBatch.from_arrays(columns, ["b", "n", "s", "reach", "away", "met", "inertia"])
        give_back()

    told = table.mapInArrow(run, "b int, n bigint, s array<decimal(38,0)>, reach decimal(38,0), away bigint, met bigint, inertia decimal(38,0)")
    dims = len(balls.c[0])
    sums = F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dims)])
    rows = told.groupBy("b").agg(
        F.sum("n").alias("n"), sums.alias("s"), F.max("reach").alias("reach"), F.sum("away").alias("away"), F.sum("met").alias("met"), F.sum("inertia").alias("inertia")
    ).collect()
    members = {r.b: (r.n, [int(v) for v in r.s]) for r in rows if r.n}
    reach, inertia = [0] * k, [0] * k
    for r in rows:
        reach[r.b], inertia[r.b] = int(r.reach), int(r.inertia)
    return members, reach, sum(r.away for r in rows), sum(r.met for r in rows), inertia


def _up(square: int) -> int:
    """The root of a square distance, rounded up."""
    return math.isqrt(square - 1) + 1 if square else 0


def ball_kmeans(
    vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding",
    told: list[dict] | None = None,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    told: gets a dict for each scan (round, distances counted, vectors outside their home ball).  Rounds end early once no
    centroid moves, as all later ones would repeat the last."""
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, dims, scale, id_col, vec_col)
    centroids = first_centroids(kept, k, seed)
    if not centroids:
        return _told(_homes(kept, Balls([[0] * dims], [None])), Balls([[0] * dims], [None]), [0])
    everywhere = Balls(centroids, [None] * len(centroids))
    table, path = _written(_homes(kept, everywhere))
    total, reach, balls = table.count(), [None] * len(centroids), everywhere
    for turn in range(rounds + 1):
        members, squares, away, met, inertia = _measure(table, balls)
        if told is not None:
            told.append({"round": turn, "distances": met, "away": away, "rows": total})
        if turn == rounds:
            break
        moved = [[v // members[b][0] for v in members[b][1]] if b in members else c for b, c in enumerate(balls.c)]
        if moved == balls.c:
            break
        if away > REHOME * total:
            old = path
            table, path = _written(_homes(table, balls))
            delete_paths(spark, [old])
            reach = [None] * len(centroids)  # of the new balls: not measured yet
        else:  # a ball's reach grows by no more than its centroid moves
            reach = [_up(s) + _up(sum((x - y) ** 2 for x, y in zip(a, b))) for s, a, b in zip(squares, balls.c, moved)]
        balls = Balls(moved, reach)
    return _told(table, balls, inertia)


def _told(table: DataFrame, balls: Balls, inertia: list[int]) -> DataFrame:
    fits = lambda v: v if v < LONG else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in balls.c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, best, _, _ = balls.assign(batch.column("home").to_numpy(), _vectors(batch))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), _longs(best)], ["vec_id", "cluster", "distance"])
        give_back()

    found = table.mapInArrow(run, f"vec_id {dict(table.dtypes)['vec_id']}, cluster int, distance bigint")
    of_cluster = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster"))
    return found.select(
        "vec_id", "cluster", "distance", of_cluster([fits(v) for v in inertia], "bigint").alias("cluster_inertia"),
        F.lit(fits(sum(inertia))).cast("bigint").alias("inertia"), of_cluster(names, "string").alias("centroid_sha256"),
    )
