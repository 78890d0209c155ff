"""Queries that put cases to a judge."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import judge
from ..session import table
from .registry import query
from .tables import SQL_PRICE_LIST, SQL_REORDER, price_list, reorder

#: Candidates of a case at most.
SHOWN = 5


def cases(spark, sf):
    """qid, supplier, candidates: of each product and supplier the rows of its code, the best five by score."""
    rows = price_list(spark, sf).select("supplier", F.col("source_row").alias("iid"), "ean", (F.col("discount_rate").cast("double") * 10).alias("score"))
    # rows of a code are ranked before products meet them, equal ones as one
    rank = F.dense_rank().over(Window.partitionBy("ean", "supplier").orderBy(F.desc("score"), "iid"))
    shown = rows.withColumn("rank", rank).where(F.col("rank") <= SHOWN).groupBy("ean", "supplier").agg(F.array_sort(F.collect_set(F.struct("iid", "score"))).alias("candidates"))
    products = reorder(spark, sf).select(F.col("source_row").alias("qid"), "ean").distinct()
    # cases are keyed, remembered and asked: made once
    return table(products.join(shown, "ean").select("qid", "supplier", "candidates"))


def remembered(of):
    """Answers from before: those of every third product are good, some of the others name a row that was never shown."""
    qid, key = F.col("qid"), judge.case_key(of.columns, "rule", "").alias("key")
    none = F.lit(None)
    good = of.where(qid % 3 == 0).select(key, F.lit("REJECT").alias("action"), none.cast("long").alias("iid"), F.lit("LOW").alias("confidence"), F.lit("seen before").alias("reason"))
    bad = of.where(qid % 3 == 1).where(qid % 2 == 0).select(key, F.lit("ACCEPT").alias("action"), F.lit(-1).cast("long").alias("iid"), F.lit("HIGH").alias("confidence"), none.cast("string").alias("reason"))
    return good.unionByName(bad)


def unsteady(case):
    """The rule, but for one product in eleven, where it fails, and one in thirteen, where it accepts what it was not shown."""
    if case["qid"] % 11 == 0:
        raise TimeoutError("no answer")
    if case["qid"] % 13 == 0:
        return {"action": "ACCEPT", "iid": -7, "confidence": "HIGH"}
    return judge.by_score(case)


_CASES = f"""WITH {SQL_REORDER}, {SQL_PRICE_LIST},
pairs AS (SELECT DISTINCT r.source_row AS qid, p.supplier, p.source_row AS iid, CAST(p.discount_rate AS DOUBLE) * 10 AS score FROM reorder r JOIN price_list p ON p.ean = r.ean),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, supplier ORDER BY score DESC, iid) AS k FROM pairs),
c AS (SELECT qid, supplier, max(score) AS best, max(score) FILTER (WHERE k = 2) AS next, max(iid) FILTER (WHERE k = 1) AS top FROM ranked GROUP BY ALL),
d AS (SELECT qid, supplier, top, CASE WHEN qid % 3 = 0 THEN 'MEMORY' WHEN qid % 11 = 0 THEN 'ERROR' WHEN qid % 13 = 0 THEN 'INVALID' ELSE 'ANSWERED' END AS state,
  CASE WHEN best < 0.4 THEN 'REJECT' WHEN best >= 0.65 AND (next IS NULL OR best - next >= 0.05) THEN 'ACCEPT' ELSE 'UNRESOLVED' END AS said, best FROM c)"""


@query(f"""{_CASES} SELECT qid, supplier, state, CASE state WHEN 'MEMORY' THEN 'REJECT' WHEN 'ANSWERED' THEN said END AS action, CASE WHEN state = 'ANSWERED' AND said = 'ACCEPT' THEN top END AS iid,
  CASE state WHEN 'MEMORY' THEN 'LOW' WHEN 'ANSWERED' THEN CASE said WHEN 'REJECT' THEN 'HIGH' WHEN 'UNRESOLVED' THEN 'LOW' ELSE CASE WHEN best >= 0.9 THEN 'HIGH' ELSE 'MEDIUM' END END END AS confidence,
  CASE state WHEN 'MEMORY' THEN 0 WHEN 'ERROR' THEN 2 ELSE 1 END AS calls, CASE state WHEN 'ERROR' THEN 'TimeoutError: no answer' END AS error FROM d""")
def judged_cases(spark, sf):
    of = cases(spark, sf)
    decisions, _ = judge.decide(of, remembered(of), unsteady)
    return decisions.select("qid", "supplier", "state", "action", "iid", "confidence", "calls", "error")


@query(f"""{_CASES} SELECT CASE WHEN qid % 3 = 0 THEN 'MEMORY' ELSE 'NO_JUDGE' END AS state, count(*) AS cases, 0 AS calls FROM d GROUP BY 1""")
def cases_without_a_judge(spark, sf):
    of = cases(spark, sf)
    return judge.accounting(judge.decide(of, remembered(of), None)[0])


@query(f"""{_CASES} SELECT CASE WHEN qid % 3 = 0 OR state = 'ANSWERED' THEN 'MEMORY' ELSE state END AS state, count(*) AS cases, CAST(sum(CASE WHEN qid % 3 = 0 THEN 0 WHEN state = 'ERROR' THEN 2 WHEN state = 'INVALID' THEN 1 ELSE 0 END) AS BIGINT) AS calls FROM d GROUP BY 1""")
def cases_asked_again(spark, sf):
    """A second run over the same cases: only what failed before is asked."""
    of = cases(spark, sf)
    memory = remembered(of)
    _, new = judge.decide(of, memory, unsteady)
    held = memory.where("iid is null").unionByName(new)
    return judge.accounting(judge.decide(of, held, unsteady)[0])
