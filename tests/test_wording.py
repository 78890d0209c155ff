"""Words of messages: agreement, ordinals, and lines in order."""

import datetime

from pyspark.sql import functions as F

from priceweave.operators import wording


def test_units_agree(spark):
    rows = [(1.0, "CT."), (6.0, "ct"), (1.0, "pezzi"), (2.5, "Collo"), (None, "pz"), (1.0, None), (3.0, "bancali"), (1.0, "unita"), (0.1234567, "kg")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q double, u string")
    got = [r[0] for r in df.orderBy("i").select(wording.with_unit(F.col("q"), F.col("u"))).collect()]
    assert got == ["1 cartone", "6 cartoni", "1 pezzo", "2.5 colli", "pezzi", "1 unità", "3 bancali", "1 unità", "0.123457 kg"]


def test_messages(spark):
    args = lambda rewards, remaining, repeatable, n: [F.lit(10), F.lit("ct"), F.lit(10 * rewards), F.lit(remaining), F.lit(rewards), wording.gift_text(F.lit(2), F.lit("pz"), F.lit("sapone")), F.lit(repeatable), F.lit(n)]
    one = lambda *a: spark.range(1).select(wording.earned_message(*args(*a))).first()[0]
    assert one(1, 1, True, 1) == "10 cartoni = 2 pezzi di sapone in omaggio: ne hai 10, te ne mancano 1 cartone per il secondo."
    assert one(7, 4, True, 3) == "10 cartoni fra i 3 prodotti dell'offerta = 2 pezzi di sapone in omaggio: ne hai 70 in tutto, sono 7 omaggi, te ne mancano 4 cartoni per l'ottavo."
    assert one(12, None, True, 1).endswith("ne hai 120, sono 12 omaggi.")
    assert one(12, 5, True, 1).endswith("per il prossimo.")
    assert one(2, 5, False, 1).endswith("ne hai 20, l'omaggio spetta una volta sola.")


def test_dates_and_lines(spark):
    day = spark.createDataFrame([(datetime.datetime(2026, 8, 12, 14, 35),), (None,)], "t timestamp")
    assert {r[0] for r in day.select(wording.long_date(F.col("t"))).collect()} == {"12 agosto 2026", None}
    lines = spark.createDataFrame([("a", "Élan", 2.0), ("a", "eau", 9.0), ("b", "Zoo", 5.0), ("a", "dado", None), ("a", "fico", 2.0)], "supplier string, name string, subtotal double")
    names = lambda **k: [r["name"] for r in wording.summary_lines(lines, **k).collect()]
    assert names() == ["eau", "Zoo", "Élan", "fico", "dado"]
    assert names(supplier="a", by_total=False) == ["dado", "eau", "Élan", "fico"]
