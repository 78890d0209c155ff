"""Queries of messages and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import wording
from .registry import query
from .tables import read


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 12 + 1 AS threshold, CASE o_orderkey % 4 WHEN 0 THEN 'ct.' WHEN 1 THEN 'PZ' WHEN 2 THEN 'collo' ELSE '' END AS unit, o_custkey % 12 AS rewards, o_orderkey % 5 = 0 AS once, o_custkey % 3 AS products FROM orders),
u AS (SELECT *, CASE unit WHEN 'ct.' THEN CASE WHEN threshold = 1 THEN 'cartone' ELSE 'cartoni' END WHEN 'PZ' THEN CASE WHEN threshold = 1 THEN 'pezzo' ELSE 'pezzi' END WHEN 'collo' THEN CASE WHEN threshold = 1 THEN 'collo' ELSE 'colli' END ELSE 'unità' END AS named,
  CASE unit WHEN 'ct.' THEN 'cartoni' WHEN 'PZ' THEN 'pezzi' WHEN 'collo' THEN 'colli' ELSE 'unità' END AS plural FROM o)
SELECT o_orderkey, threshold || ' ' || named || CASE WHEN products > 1 THEN ' fra i ' || products || ' prodotti dell''offerta' ELSE '' END || ' = 1 pezzo di gel blu in omaggio: ne hai ' || (threshold * rewards) || '.5' || CASE WHEN products > 1 THEN ' in tutto' ELSE '' END ||
  CASE WHEN once THEN ', l''omaggio spetta una volta sola.' ELSE CASE WHEN rewards > 1 THEN ', sono ' || rewards || ' omaggi' ELSE '' END || ', te ne mancano ' || CASE WHEN threshold = 1 THEN '0.5' ELSE (threshold - 1) || '.5' END || ' ' || plural || ' per ' ||
  CASE rewards WHEN 1 THEN 'il secondo' WHEN 2 THEN 'il terzo' WHEN 3 THEN 'il quarto' WHEN 4 THEN 'il quinto' WHEN 5 THEN 'il sesto' WHEN 6 THEN 'il settimo' WHEN 7 THEN 'l''ottavo' WHEN 8 THEN 'il nono' WHEN 9 THEN 'il decimo' ELSE 'il prossimo' END || '.' END AS message FROM u""")
def earned_messages(spark, sf):
    key, n = F.col("o_orderkey"), F.col("o_custkey")
    unit = F.when(key % 4 == 0, "ct.").when(key % 4 == 1, "PZ").when(key % 4 == 2, "collo").otherwise("")
    threshold, rewards, half = n % 12 + 1, n % 12, F.lit("0.5").cast("decimal(10,4)")
    gift = wording.gift_text(F.lit(None).cast("int"), F.lit("pz"), F.lit(" gel   blu "))
    text = wording.earned_message(threshold, unit, threshold * rewards + half, threshold - half, rewards, gift, key % 5 != 0, n % 3)
    return read(spark, sf, "orders").select("o_orderkey", text.alias("message"))


@query("""SELECT o_orderkey, day(o_orderdate) || ' ' || ['gennaio', 'febbraio', 'marzo', 'aprile', 'maggio', 'giugno', 'luglio', 'agosto', 'settembre', 'ottobre', 'novembre', 'dicembre'][month(o_orderdate)] || ' ' || year(o_orderdate) AS date FROM orders""")
def long_dates(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", wording.long_date(F.col("o_orderdate")).alias("date"))
