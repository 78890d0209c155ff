"""Queries of tables that keep their versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut, discard, scratch
from ..sources.versioned import VersionTable
from .registry import query
from .tables import read

DAYS = [f"2024-01-0{k}" for k in (1, 2, 3)]


def _batches(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    key = F.col("key")
    second = c.where((key % 3 == 0) | (key % 5 == 0)).withColumn("segment", F.concat(F.lit("B2-"), "segment")).withColumn("removed", key % 5 == 0)
    return [c, second, c.where(key % 2 == 0)]


def _kept(spark, sf, of):
    """What of(table) gives after three batches, the second of which is handed over twice."""
    path = scratch(spark)
    table = VersionTable(spark, path, "key long", "segment string", buckets=16)
    first, second, third = _batches(spark, sf)
    for number, batch in ((0, first), (1, second), (1, second), (2, third)):
        table.upsert(batch, F.lit(DAYS[number]), "query", number)
    out = cut(of(table))
    discard(spark, path)
    return out


_VERSIONS = """k AS (SELECT c_custkey AS key, c_mktsegment AS segment, c_custkey % 5 = 0 AS gone, c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AS changed, c_custkey % 2 = 0 AS again FROM customer),
v AS (SELECT key, segment, 1 AS version, '2024-01-01' AS valid_from, CASE WHEN gone OR changed THEN '2024-01-02' END AS valid_to FROM k
  UNION ALL SELECT key, 'B2-' || segment, 2, '2024-01-02', CASE WHEN again THEN '2024-01-03' END FROM k WHERE changed
  UNION ALL SELECT key, segment, CASE WHEN gone THEN 2 ELSE 3 END, '2024-01-03', NULL FROM k WHERE again AND (gone OR changed))"""


@query(f"WITH {_VERSIONS} SELECT * FROM v")
def kept_versions(spark, sf):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return _kept(spark, sf, lambda t: t.read().select("key", "segment", "version", day("valid_from"), day("valid_to")))


@query(f"WITH {_VERSIONS} SELECT key, segment, 'now' AS state FROM v WHERE valid_to IS NULL UNION ALL SELECT key, CASE WHEN changed THEN 'B2-' || segment ELSE segment END, 'before' FROM k WHERE NOT gone")
def current_and_earlier_state(spark, sf):
    """The open rows after the last batch, and as they were before it."""
    return _kept(spark, sf, lambda t: t.current().withColumn("state", F.lit("now")).unionByName(t.current(2).withColumn("state", F.lit("before"))))
