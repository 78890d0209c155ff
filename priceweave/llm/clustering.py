"""Exact k-means with Drake's adaptive bounds.

Each vector stores its cluster, lower bounds of its distances to several nearest other centroids, in order, and one bound
for all the remaining ones. When centroids have moved, the bounds shrink by what their centroids moved by (the last one by
the greatest move). The distance to the own centroid is computed; the listed centroids whose bounds, or any bound behind
them, do not lie strictly above it are measured again and put in order; where even the last bound is not above it, all
centroids are. So a vector's cluster is always that of the exact rule, ties included. The number of listed centroids
starts at a quarter of all and falls to what the last round needed, an eighth at least.

A round is one pass that writes the vectors with their new bounds as a table in the shared folder, and one grouped sum
over it with partial sums before the shuffle; only k centroids pass the driver. Tables of earlier rounds are deleted.

Defined results
- vectors that are null, of another number of components, or that hold null or non-finite ones take no part; null ids do,
  and come last in the choice of first centroids. Repeated rows are vectors of their own.
- fewer vectors than k: as many centroids; no vectors: no rows. Empty clusters keep their centroids.
- ties go to the smaller number. Extra columns are ignored.
- components are integers, cut to +-2^27 so that squared distances fit 64 bits; all results are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, scratch, table
from .common import read, slices

#: Bounds are moved by this share to the safe side, far more than rounding does.
SLACK = 1e-9
#: Components up to which sums of products are exact in doubles.
SMALL = 1 << 20
LARGEST = 1 << 27

STATE = "vec_id long, v array<long>, cluster int, distance long, near array<int>, lower array<float>, rest float, measured int, missed boolean"


def integers(df: DataFrame, width: int, scale: float = 256.0) -> DataFrame:
    """vec_id, v of the vectors that take part."""
    x = lambda c: c.cast("double")
    finite = F.forall("embedding", lambda c: F.coalesce(~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")), F.lit(False)))
    kept = df.where(F.col("embedding").isNotNull() & (F.size("embedding") == width)).where(finite)
    bounded = lambda c: F.least(F.greatest(F.floor(F.lit(scale) * x(c)), F.lit(-LARGEST)), F.lit(LARGEST)).cast("long")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", bounded).alias("v"))


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centroids."""
    if max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0))) <= SMALL and v.shape[1] <= 4096:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)[None, :]).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(axis=1) for row in c], axis=1)


def below(square: np.ndarray) -> np.ndarray:
    """Distances, moved down."""
    return np.sqrt(square.astype(np.float64)) * (1 - SLACK)


class Bounds:
    """Clusters, listed centroids and bounds of some vectors."""

    def __init__(self, n: int, listed: int):
        self.cluster, self.distance = np.zeros(n, np.int32), np.zeros(n, np.int64)
        self.near, self.lower, self.rest = np.zeros((n, listed), np.int32), np.full((n, listed), np.inf), np.full(n, np.inf)
        #: distances computed for each vector, and whether all were
        self.measured, self.missed = np.ones(n, np.int32), np.zeros(n, bool)

    def scan(self, rows: np.ndarray, v: np.ndarray, centroids: np.ndarray) -> None:
        """Measure all centroids for these rows."""
        listed = self.near.shape[1]
        for s in range(0, len(rows), 4096):
            at = rows[s : s + 4096]
            square = squares(v[at], centroids)
            order = np.argsort(square, axis=1, kind="stable")  # of equal distances the smaller number comes first
            ranked = np.take_along_axis(square, order, axis=1)
            self.cluster[at], self.distance[at] = order[:, 0], ranked[:, 0]
            self.near[at], self.lower[at] = order[:, 1 : listed + 1], below(ranked[:, 1 : listed + 1])
            self.rest[at] = below(ranked[:, listed + 1]) if ranked.shape[1] > listed + 1 else np.inf
            self.measured[at], self.missed[at] = len(centroids), True

    def move(self, v: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> None:
        """New clusters and bounds, the centroids having moved by at most moved."""
        n, listed = self.near.shape
        self.lower -= moved[self.near]
        self.rest -= moved.max(initial=0)
        self.distance = ((v - centroids[self.cluster]) ** 2).sum(axis=1)
        upper = np.sqrt(self.distance.astype(np.float64)) * (1 + SLACK)
        chain = np.concatenate([self.lower, self.rest[:, None]], axis=1)
        least = np.minimum.accumulate(chain[:, ::-1], axis=1)[:, ::-1]
        open_ = (least <= upper[:, None]).sum(axis=1)
        for z in range(1, listed + 1):
            rows = np.flatnonzero(open_ == z)
            if len(rows):
                numbers = np.concatenate([self.cluster[rows, None], self.near[rows, :z]], axis=1)
                far = ((v[rows, None, :] - centroids[self.near[rows, :z]]) ** 2).sum(axis=2)
                square = np.concatenate([self.distance[rows, None], far], axis=1)
                order = np.lexsort((numbers, square), axis=1)
                numbers, square = np.take_along_axis(numbers, order, axis=1), np.take_along_axis(square, order, axis=1)
                self.cluster[rows], self.distance[rows] = numbers[:, 0], square[:, 0]
                self.near[rows, :z], self.lower[rows, :z] = numbers[:, 1:], below(square[:, 1:])
                self.measured[rows] = z + 1
        self.scan(np.flatnonzero(open_ > listed), v, centroids)

    def shorten(self, listed: int) -> None:
        """List fewer centroids; the others join the remainder."""
        if listed < self.near.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, listed:].min(axis=1))
            self.near, self.lower = self.near[:, :listed], self.lower[:, :listed]


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


def _flat(column: pa.Array, n: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, width)


def assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, listed: int) -> DataFrame:
    """STATE after the centroids have moved; moved is None in the first round, whose state has vec_id and v only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            n = batch.num_rows
            v = _flat(batch["v"], n, centroids.shape[1])
            if moved is None:
                bounds = Bounds(n, listed)
                bounds.scan(np.arange(n), v, centroids)
            else:
                width = len(batch["near"][0]) if n else listed
                bounds = Bounds(n, width)
                bounds.cluster = batch["cluster"].to_numpy().copy()
                bounds.near, bounds.lower = _flat(batch["near"], n, width).copy(), _flat(batch["lower"], n, width).astype(np.float64)
                bounds.rest = batch["rest"].to_numpy().astype(np.float64)
                bounds.move(v, centroids, moved)
                bounds.shorten(listed)
            down = lambda x: np.nextafter(x.astype(np.float32), np.float32(-np.inf))
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["v"], pa.array(bounds.cluster), pa.array(bounds.distance), _lists(bounds.near, pa.int32()), _lists(down(bounds.lower), pa.float32()), pa.array(down(bounds.rest)), pa.array(bounds.measured), pa.array(bounds.missed)],
                names=["vec_id", "v", "cluster", "distance", "near", "lower", "rest", "measured", "missed"],
            )

    return state.mapInArrow(run, STATE)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest hashes of seed:vec_id, in their order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "v").select("v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, seed: int = 2, report: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. vectors: vec_id, v (array<long> of width).

    report, if given, gets (centroids listed, distances measured, vectors measured in full, vectors) of each pass."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, seed)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    listed, moved, state, path = min(max(k // 4, 1), k - 1), None, vectors, None
    for number in range(rounds + 1):
        last, before = number == rounds, path
        new = assigned(state, centroids, moved, listed)
        path = scratch(spark)
        state = table(new.select("vec_id", "cluster", "distance", "measured", "missed") if last else new, path)
        if before:
            discard(spark, before)
        counts = [F.count("*").alias("n"), F.sum("distance").alias("inertia"), F.sum("measured").alias("measured"), F.sum(F.col("missed").cast("long")).alias("missed"), F.max(F.when(~F.col("missed"), F.col("measured"))).alias("most")]
        sums = [] if last else [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)]
        found = state.groupBy("cluster").agg(*counts, *sums).collect()  # k rows at most
        if report is not None:
            report.append((listed, sum(r["measured"] for r in found), sum(r["missed"] for r in found), sum(r["n"] for r in found)))
        if last:
            break
        old, centroids = centroids, centroids.copy()
        for r in found:
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        moved = np.sqrt(((centroids - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        # what the vectors that were not measured in full needed
        listed = min(listed, max(k // 8, 1, max((r["most"] or 1) - 1 for r in found))) if number else listed
    inertia = sum(r["inertia"] for r in found)
    rows = [(r["cluster"], r["inertia"], inertia, sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in found]
    # k rows
    totals = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return state.join(totals, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(integers(read(spark, sf_dir, "embeddings"), 64), k=40, rounds=5, width=64, seed=2)


_SQUARES = "CAST(list_sum([(e.v[i] - c.v[i]) * (e.v[i] - c.v[i]) FOR i IN range(1, 65)]) AS BIGINT)"


def _sql(rounds: int = 5) -> str:
    parts = [
        """e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), v) - 1 AS number, v FROM e QUALIFY number < 40)",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(e.v) AS v, min({{'d': {_SQUARES}, 'c': number}}) AS m FROM e, c{n} c GROUP BY r)")
        if n < rounds:
            parts.append(f"s{n} AS MATERIALIZED (SELECT m.c AS number, i, sum(v[i]) AS s, count(*) AS n FROM a{n}, range(1, 65) t(i) GROUP BY ALL)")
            parts.append(
                f"c{n + 1} AS MATERIALIZED (SELECT number, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY number"
                f" UNION ALL SELECT number, v FROM c{n} WHERE number NOT IN (SELECT number FROM s{n}))"
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN e USING (r) JOIN c{rounds} c ON c.number = a.m.c"""


QUERIES = {"op11_clustering": op11_clustering}
ORACLES = {"op11_clustering": _sql()}
