"""The engine's tables as views over the test data, and the same views in SQL for checks by another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import MONEY, RATE, net


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _ean(c):
    return F.lpad(c.cast("string"), 13, "0")


def reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products wanted."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("source_row"), _ean(F.col("p_partkey")).alias("ean"), F.concat_ws(" ", "p_name", "p_brand", F.concat(F.lit("X"), F.col("p_size").cast("string"))).alias("description"), F.col("p_brand").alias("brand"), F.col("p_retailprice").cast(MONEY).alias("last_unit_price"), F.col("p_size").alias("suggested_cartons"))


def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the suppliers' price lists; a supplier is a nation."""
    rows = read(spark, sf_dir, "lineitem")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    pre, rate = F.col("l_extendedprice").cast(MONEY), F.col("l_discount").cast(RATE)
    return joined.select(
        F.col("n_name").alias("supplier"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_row"),
        _ean(F.col("l_partkey")).alias("ean"),
        pre.alias("unit_price_pre"),
        rate.alias("discount_rate"),
        net(pre, rate).alias("unit_price_net"),
        F.col("l_quantity").cast(MONEY).alias("pieces_per_carton"),
        ((F.col("l_returnflag") != "R") & (F.col("l_quantity") > 0)).alias("usable"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.col("l_suppkey").alias("list_id"),
    )


SQL_REORDER = """reorder AS (
  SELECT p_partkey AS source_row, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS ean,
         p_name || ' ' || p_brand || ' X' || CAST(p_size AS VARCHAR) AS description, p_brand AS brand,
         CAST(p_retailprice AS DECIMAL(18,4)) AS last_unit_price, p_size AS suggested_cartons
  FROM part)"""

SQL_PRICE_LIST = """price_list AS (
  SELECT n_name AS supplier, l_orderkey * 10 + l_linenumber AS source_row, lpad(CAST(l_partkey AS VARCHAR), 13, '0') AS ean,
         CAST(l_extendedprice AS DECIMAL(18,4)) AS unit_price_pre, CAST(l_discount AS DECIMAL(9,4)) AS discount_rate,
         CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(9,4))) AS DECIMAL(18,4)) AS unit_price_net,
         CAST(l_quantity AS DECIMAL(18,4)) AS pieces_per_carton, (l_returnflag <> 'R' AND l_quantity > 0) AS usable,
         l_returnflag AS flag, l_linestatus AS status, l_suppkey AS list_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
