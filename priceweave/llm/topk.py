"""Exact top-k inner products by a score-at-a-time index.

Rows are indexed in shards. A shard keeps its postings (dimension, row, weight) in segments by quantised impact: the
segment of level L holds weights of magnitude 2^L to 2^(L+1)-1. Segments are processed from the highest impact down;
after each, what is left of any score is bounded by Cauchy-Schwarz over the unprocessed weights. Processing stops for a
shard only when the bound proves that few rows can still be members; these are rescored exactly in integers.

Defined results
- vectors that are null or hold a null or non-finite component take no part, as queries or candidates.
- null ids take no part. A row never answers a query of the same id; repeated rows of other ids answer each.
- vectors of other lengths are padded by zeros; empty vectors score 0.
- ties go to the smaller id; fewer candidates than k: all. Empty tables give none. Extra columns are ignored.
- scores are exact while the sums of absolute products stay under 2^53.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

RESULT = "query_id long, vec_id long, score long"
#: Pairs that are rescored at a time, and queries that a shard answers at a time.
RESCORED, TOGETHER = 1 << 16, 128


def quantised(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v: array<long> of floor(scale * component), without the vectors that take no part."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    x = lambda c: c.cast("double")
    finite = F.forall("embedding", lambda c: F.coalesce(~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")), F.lit(False)))
    return df.where(ok).where(finite).select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(scale) * x(c))).alias("v"))


class Shard:
    """The impact-ordered index of some rows: for each level of impact, from the highest, the posting lists of the
    dimensions that have any (rows and weights), and a bound of what each row has left below the level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        # level of each posting: bit length of its magnitude, 0 for no posting
        level = np.frexp(np.abs(vectors).astype(np.float64))[1]
        level[vectors == 0] = 0
        left = (vectors.astype(np.float64) ** 2).sum(axis=1)
        self.segments: list[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]] = []
        for k in (int(x) for x in np.unique(level)[::-1] if x):
            lists = []
            for d in np.flatnonzero((level == k).any(axis=0)):
                rows = np.flatnonzero(level[:, d] == k)
                weights = vectors[rows, d].astype(np.float64)
                left[rows] -= weights**2
                lists.append((int(d), rows, weights))
            # squares of integers are exact, so nothing is left is 0
            self.segments.append((lists, np.sqrt(np.maximum(left, 0))))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, few: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, row's place, score) of every possible member of each query's top k in this shard."""
        q = queries.astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", q, q))
        acc = np.zeros((len(self.ids), len(q)))
        own = self.ids[:, None] == query_ids[None, :]
        n = len(self.ids)
        possible = ~own
        for lists, left in self.segments:
            for d, rows, weights in lists:
                if len(rows) == n:
                    acc += weights[:, None] * q[None, :, d]
                else:
                    acc[rows] += weights[:, None] * q[None, :, d]
            bound = left[:, None] * norms[None, :] * (1 + 1e-9)
            if n > k + 1:
                low = np.where(own, -np.inf, acc - bound)
                kth = np.partition(low, n - k, axis=0)[n - k]
                possible = (acc + bound >= kth[None, :]) & ~own
                # the proof: all but a few rows are below k others; those few are rescored
                if possible.sum() <= few * len(q):
                    break
        row, at = np.nonzero(possible)
        score = np.empty(len(at), np.int64)
        for s in range(0, len(at), RESCORED):  # where many rows tie, all stay possible
            e = s + RESCORED
            score[s:e] = np.einsum("ij,ij->i", queries[at[s:e]], self.vectors[row[s:e]])
        return at, row, score


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    offsets = values.offsets.to_numpy()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(offsets)
    out = np.zeros((len(values), max(width, int(lengths.max(initial=0)))), np.int64)
    rows = np.repeat(np.arange(len(values)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    keep = rank < k
    return query[keep], vec[keep], score[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score. vectors, queries: as quantised() returns.

    Queries are a stated set. Rows are dealt into shards of about shard_rows; each query goes to every shard, as data,
    behind the shard's rows, so a task holds one shard's index and a few queries, and gives k rows a query and shard."""
    shards = max(1, -(-vectors.count() // shard_rows))
    number = lambda df: df.select(F.pmod(F.monotonically_increasing_id(), F.lit(shards)).alias("shard"), F.lit(0).alias("asks"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("asks"), "vec_id", "v")
    dealt = number(vectors).unionByName(asked).repartition(F.col("shard")).sortWithinPartitions("shard", "asks")

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, shard = None, [], None
        for batch in batches:
            of, asks = batch["shard"].to_numpy(), batch["asks"].to_numpy()
            edges = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (asks[1:] != asks[:-1])])
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]) if batch.num_rows else ():
                part = batch.slice(s, e - s)
                if of[s] != current:
                    current, held, shard = of[s], [], None
                if not asks[s]:
                    held.append(part)
                    continue
                if shard is None and held:
                    mats = [_matrix(x["v"], 1) for x in held]
                    width = max(m.shape[1] for m in mats)
                    shard = Shard(np.concatenate([x["vec_id"].to_numpy() for x in held]), np.vstack([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in mats]))
                    held = []
                if shard is not None:
                    for t in range(0, e - s, TOGETHER):
                        yield found(shard, part.slice(t, TOGETHER))

    def found(shard: Shard, asked: pa.RecordBatch) -> pa.RecordBatch:
        # dimensions that one side does not have add nothing
        width = shard.vectors.shape[1]
        ids, q = asked["vec_id"].to_numpy(), _matrix(asked["v"], width)[:, :width]
        at, row, score = shard.search(ids, q, k)
        at, vec, score = _best(at, shard.ids[row], score, k)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    # repeated query rows ask the same question once each; they are told apart by nothing, so one answer stands
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = dealt.mapInArrow(answer, RESULT).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0).dropDuplicates(["vec_id"]), k=5)


SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op6_topk": op6_topk}
ORACLES = {"op6_topk": SQL}
