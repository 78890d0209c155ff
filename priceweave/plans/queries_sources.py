"""Queries on scraped pages and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard, scratch
from ..sources.adapters import Counters, Mapping, records
from ..sources.delivery import DeliverySource
from ..sources.html_tables import exploded, list_items
from ..sources.lists import grids
from ..sources.paged import TablePages, extraction_report, in_blocks
from ..streaming import orders as streams
from ..streaming.progress import ProgressLog
from .registry import query
from .tables import read


@query()
def html_list_rows(spark, sf):
    return exploded(read(spark, sf, "pages"), "page_id", list_items("html"))


def _streamed(spark, sf, make, name):
    """The rows of a stream over a table, run to its end."""
    schema = read(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    where = f"{scratch(spark)}-{name}"
    q = make(source).writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/rows")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), r AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, n FROM r WHERE ended <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_session_gap(spark, sf):
    out = _streamed(spark, sf, lambda s: streams.sessions(s), "sessions")
    return out.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS k FROM events) WHERE k = 1")
def stream_once(spark, sf):
    return _streamed(spark, sf, lambda s: streams.once(s, ["event_id"]).select("event_id", "event_type"), "once")


def _layout(supplier: str = "any"):
    return Mapping(
        supplier,
        {"ean": "EAN", "supplier_code": 2, "description": "C", "unit_price_pre": "list price", "discount": 5, "order_multiplier": 6, "availability": 7},
        header_row=1,
        data_start=2,
        filters=[("supplier_code", r"^[0-9]+-[ANR]$")],
        excludes=[("returned", "supplier_code", "-R$"), ("few", "description", "^few")],
        italian=True,
        available_prefix="open",
        required_headers=("EAN", "description", "list price"),
        multiplier_pattern=r"x\s*(\d+(?:,\d+)?)",
    )


def _grid(spark, sf):
    """The price list as cells of a sheet, the header in row 1."""
    l = read(spark, sf, "lineitem")  # noqa: E741
    # the smallest table gives the one row of the header
    header = read(spark, sf, "region").where("r_regionkey = 0").select(F.lit(1).cast("long").alias("source_row"), F.array(*[F.lit(h) for h in ("Ean", "code", "Description", "List-price", "disc", "mult", "state")]).alias("cells"))
    code = F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") == 7, "x").otherwise(F.lit("-")), F.col("l_returnflag"))
    price = F.when(F.col("l_quantity") == 1, "n.d.").otherwise(F.concat(F.floor("l_extendedprice").cast("string"), F.lit(",5")))
    words = F.when(F.col("l_quantity") < 4, F.concat(F.lit("few "), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    times = F.when(F.col("l_linenumber") == 2, "each").otherwise(F.concat(F.lit("Ct x "), F.col("l_quantity").cast("int").cast("string"), F.lit(",0")))
    cells = F.array(F.col("l_partkey").cast("string"), code, words, price, F.col("l_discount").cast("string"), times, F.when(F.col("l_linestatus") == "O", "Open now").otherwise(F.lit("closed")))
    rows = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1).alias("source_row"), cells.alias("cells"))
    return header.unionByName(rows)


@query("""WITH r AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem), c AS (SELECT count(*) AS "read", count(*) FILTER (WHERE l_linenumber = 7) AS filtered, 0 AS no_product,
  count(*) FILTER (WHERE l_linenumber <> 7 AND l_returnflag = 'R') AS e1, count(*) FILTER (WHERE l_linenumber <> 7 AND l_returnflag <> 'R' AND l_quantity < 4) AS e2,
  count(*) FILTER (WHERE l_linenumber <> 7 AND l_returnflag <> 'R' AND l_quantity >= 4) AS p, count(*) FILTER (WHERE l_linenumber <> 7 AND l_returnflag <> 'R' AND l_quantity >= 4 AND l_linenumber = 2) AS u1,
  count(*) FILTER (WHERE l_linenumber NOT IN (2, 7) AND l_returnflag <> 'R' AND l_quantity >= 4 AND l_linestatus <> 'O') AS u2 FROM r)
SELECT * FROM (SELECT 'read' AS counter, "read" AS n FROM c UNION ALL SELECT 'filtered', filtered FROM c UNION ALL SELECT 'no_product', no_product FROM c UNION ALL SELECT 'excluded: returned', e1 FROM c UNION ALL SELECT 'excluded: few', e2 FROM c
  UNION ALL SELECT 'unusable: no description', 0 FROM c UNION ALL SELECT 'unusable: no price', 0 FROM c UNION ALL SELECT 'unusable: no pieces', u1 FROM c UNION ALL SELECT 'unusable: not available', u2 FROM c UNION ALL SELECT 'kept', p - u1 - u2 FROM c)""")
def reading_counters(spark, sf):
    """The counters of a reading, filled while its rows are written."""
    counters = Counters()
    path = scratch(spark)
    records(_grid(spark, sf), _layout(), counters).write.parquet(path)
    discard(spark, path)
    return spark.createDataFrame(list(counters.values().items()), "counter string, n long")


@query("""SELECT CASE WHEN n_nationkey % 12 = 5 THEN 'failed' ELSE 'read' END AS outcome, count(DISTINCT n_nationkey) AS files, CAST(coalesce(sum(CASE WHEN n_nationkey % 12 <> 5 THEN n END), 0) AS BIGINT) AS rows
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey WHERE n IS NOT NULL GROUP BY 1""")
def lists_with_failures(spark, sf):
    """A list of each nation as a file, some of them broken: all others are read whole."""
    path = scratch(spark)
    text = F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(";", F.col("c_custkey").cast("string"), "c_mktsegment"))))
    lists = read(spark, sf, "customer").groupBy("c_nationkey").agg(text.alias("value"))
    # a file that starts like a workbook and is none
    broken = F.when(F.col("c_nationkey") % 12 == 5, F.concat(F.lit("PK\x03\x04"), F.col("value"))).otherwise(F.col("value"))
    lists.select(broken.alias("value"), "c_nationkey").repartition("c_nationkey").write.partitionBy("c_nationkey").option("lineSep", "\n").text(path)
    rows, files = grids(spark, path, delimiter=";", glob="part-*")
    read_rows = rows.groupBy("path").agg(F.count("*").alias("n"))
    out = files.join(read_rows, "path", "left").groupBy(F.when(F.col("error").isNull(), "read").otherwise("failed").alias("outcome"))
    out = cut(out.agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")))
    discard(spark, path)
    return out


#: Ids of a page, pages of a batch, batches of a stream at least where there are several, and streams at most: each has a
#: Python process of some 100 MB beside the driver.
PAGE, STEP, BATCHES, STREAMS = 20, 4, 8, 2


def _extracted(spark, sf, runs=None):
    """The pages of a site, read as streams in two runs: the first one is stopped after its first batch. Streams have
    neighbouring ranges of pages. runs gets the run ids with the number of batches before their stream's first one."""
    spark.dataSource.register(TablePages)
    where, pages = scratch(spark), read(spark, sf, "pages")
    in_blocks(pages, f"{where}/blocks", 50 * PAGE)
    batches = -(-((pages.agg(F.max("page_id")).first()[0] or 0) // PAGE + 1) // STEP)
    n = max(1, min(STREAMS, batches // BATCHES))
    starts = [batches * k // n for k in range(n)]

    def begin(k):
        source = spark.readStream.format("table_pages").option("path", f"{sf}/pages.parquet").option("pageSize", PAGE).option("pagesPerBatch", STEP).option("blocks", f"{where}/blocks").option("blockSize", 50 * PAGE)
        source = source.option("firstPage", starts[k] * STEP + 1)
        # the last stream has whatever comes behind
        source = source.option("lastPage", starts[k + 1] * STEP) if k + 1 < n else source
        return source.load().writeStream.format("parquet").option("path", f"{where}/rows{k}").option("checkpointLocation", f"{where}/state{k}").start()

    first = [begin(k) for k in range(n)]
    for q in first:
        while not any(p.numInputRows for p in q.recentProgress) and q.isActive:
            q.awaitTermination(1)
        q.stop()
    second = [begin(k) for k in range(n)]
    for q in second:
        q.processAllAvailable()
        q.stop()
    if runs is not None:
        runs += [(str(q.runId), start) for of in (first, second) for q, start in zip(of, starts)]
    discard(spark, f"{where}/blocks")
    rows = [spark.read.parquet(f"{where}/rows{k}") for k in range(n)]
    return reduce(DataFrame.unionByName, rows)


@query("SELECT page_id, url, page_id // 20 + 1 AS page, max(page_id) OVER () // 20 + 1 AS declared_pages, count(*) OVER () AS declared_items FROM pages")
def pages_as_a_stream(spark, sf):
    return _extracted(spark, sf).select("page_id", "url", "page", "declared_pages", "declared_items")


@query("SELECT max(page_id) // 20 + 1 AS pages, count(*) AS items, true AS steady, 0 AS missing_pages, 0 AS missing_items, true AS complete FROM pages")
def extraction_totals(spark, sf):
    return extraction_report(_extracted(spark, sf))


@query("""WITH s AS (SELECT c_custkey, c_name, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT lpad(CAST(c_custkey AS VARCHAR), 13, '0') AS ean, c_name || ', "' || c_mktsegment || '"' AS description, CASE WHEN n = 0 THEN 'not listed' ELSE 'unavailable' END AS reason FROM s WHERE n < 8""")
def delivered_sheet(spark, sf):
    """What is to be sourced elsewhere, delivered as files and read back."""
    spark.dataSource.register(DeliverySource)
    orders = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = read(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < 8")
    sheet = c.select(F.lpad(F.col("c_custkey").cast("string"), 13, "0").alias("ean"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("description"), F.when(F.col("n") == 0, "not listed").otherwise("unavailable").alias("reason"))
    path = scratch(spark)
    sheet.write.format("delivery").mode("overwrite").option("path", path).save()
    out = cut(spark.read.option("header", True).option("escape", '"').schema(sheet.schema).csv(f"{path}/*.csv"))
    discard(spark, path)
    return out


@query("SELECT page_id // 20 // 4 AS batch, count(*) AS rows FROM pages GROUP BY 1")
def progress_of_a_stream(spark, sf):
    """The rows of each batch, as a listener was told of them while the pages were read."""
    log, runs = ProgressLog(spark), []
    spark.streams.addListener(log)
    try:
        _extracted(spark, sf, runs)
        for run, _ in runs:
            log.wait(run)
    finally:
        spark.streams.removeListener(log)
    before = F.create_map(*[F.lit(v) for pair in runs for v in pair])
    return log.rows().where(F.col("run").isin([run for run, _ in runs])).select((F.col("batch") + before[F.col("run")]).alias("batch"), "rows")
