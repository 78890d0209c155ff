"""Rules whose simple form would be wrong: order history, prices of catalogues, dates of expiry, order of names."""

import datetime

from pyspark.sql import functions as F

from priceweave.functions.text import natural_order
from priceweave.operators import intake, ledger

HISTORY = "order_id string, run_id string, supplier string, status string, total double, created_at string"


def test_deleting_a_compilation_needs_its_whole_key(spark):
    ids = ["2026_2:a", "2026_20:a", "2026_2:b", "2026_2", None]
    rows = spark.createDataFrame([(i,) for i in ids], "order_id string")
    left = lambda key: [r[0] for r in ledger.without_compilation(rows, key).collect()]
    assert left(" 2026_2 ") == ["2026_20:a", "2026_2", None]
    for key in ("", "  ", None):
        assert left(key) == ids


def test_recording_a_plan_replaces_delivered_suppliers_only(spark):
    history = [
        ("k1:larch", "r1", "larch", "pending", 5.0, "mon"),  # replaced by k2:larch
        ("k1:beech", "r1", "beech", "pending", 6.0, "mon"),  # not in the plan: stays
        ("k1:elm", "r1", "elm", "received", 7.0, "mon"),  # answered: stays
        ("k0:larch", "r0", "larch", "pending", 8.0, "sun"),  # another run
        ("k2:ash", "r1", "ash", "received", 9.0, "tue"),  # recorded again: keeps its state and moment
        ("k1:fir", "r1", "fir", "pending", 1.0, "mon"),  # in the plan, but not delivered
    ]
    plan = [("k2:larch", "r1", "LARCH", "pending", 50.0, "wed"), ("k2:elm", "r1", "elm", "pending", 70.0, "wed"), ("k2:ash", "r1", "ash", "pending", 90.0, "wed"), ("k2:fir", "r1", "fir", "pending", 10.0, "wed")]
    h, p = spark.createDataFrame(history, HISTORY), spark.createDataFrame(plan, HISTORY)
    got = {r[0]: tuple(r)[2:] for r in ledger.record_plan(h, p, "r1", spark.createDataFrame([("Larch",), ("elm",), ("ash",), ("",)], "supplier string")).collect()}
    assert got == {
        "k2:larch": ("LARCH", "pending", 50.0, "wed"),
        "k1:beech": ("beech", "pending", 6.0, "mon"),
        "k1:elm": ("elm", "received", 7.0, "mon"),
        "k2:elm": ("elm", "pending", 70.0, "wed"),
        "k0:larch": ("larch", "pending", 8.0, "sun"),
        "k2:ash": ("ash", "received", 90.0, "tue"),
        "k1:fir": ("fir", "pending", 1.0, "mon"),
    }
    everyone = {r[0] for r in ledger.record_plan(h, p, "r1").collect()}
    assert everyone == (set(got) - {"k1:fir"}) | {"k2:fir"}


def test_closing_an_order_whatever_it_was(spark):
    states = ["pending", "received", "expired", "closed", None]
    rows = spark.createDataFrame([(s,) for s in states], "s string").select(ledger.closed_status(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["closed"] * 4 + [None]


def test_prices_of_catalogues_are_italian_and_may_be_zero(spark):
    prices = ["1,50", "1.50", "0", "0,00", "1.234,5", "1.23,5", "12.345.678", " 1 234,5 ", "3 ,20", "-1", "1,", "", None, "ask", "1.234.5"]
    rows = spark.createDataFrame([(i, f"p{i}", p, "1") for i, p in enumerate(prices)], "row int, product string, price string, page string")
    kept = {prices[r["row"]] for r in intake.checked_catalogue(rows, "product", "price", "page").where("discarded is null").collect()}
    assert kept == {"1,50", "0", "0,00", "1.234,5", "12.345.678", " 1 234,5 ", "3 ,20"}


def test_expiry_is_cut_out_whatever_the_date(spark):
    pattern = r"<br>\s*scadenza\s*(\d{1,2})/(\d{1,2})/(\d{2,4})"
    cases = {
        "SOAP ML.500<br> Scadenza 30/08/2026": ("SOAP ML.500", "<br> Scadenza 30/08/2026", datetime.date(2026, 8, 30), True),
        "SOAP<BR>SCADENZA 1/2/2077 XL": ("SOAP XL", "<BR>SCADENZA 1/2/2077", datetime.date(2077, 2, 1), False),
        "SOAP <br>Scadenza 31/2/2026": ("SOAP", "<br>Scadenza 31/2/2026", None, False),
        "A<br>scadenza 1/2/2026 B<br>scadenza 3/4/2026": ("A B<br>scadenza 3/4/2026", "<br>scadenza 1/2/2026", datetime.date(2026, 2, 1), True),
        "A<br>scadenza 1/2/30": ("A", "<br>scadenza 1/2/30", datetime.date(30, 2, 1), False),
        " SOAP  30/08/2026": (" SOAP  30/08/2026", None, None, None),
    }
    rows = spark.createDataFrame([(c,) for c in [*cases, None]], "d string").select("d", ledger.expiry_of(F.col("d"), pattern, 2026).alias("x"))
    got = {r["d"]: (r["x"]["text"], r["x"]["raw"], r["x"]["day"], r["x"]["plausible"]) for r in rows.withColumn("x", F.struct("x.text", "x.raw", F.col("x.expires").alias("day"), "x.plausible")).collect()}
    assert got == {**cases, None: (None, None, None, None)}


def test_names_order_by_value_of_their_numbers(spark):
    names = ["NEVAL 10ML", "neval 9ml", "Nevál 100ml", "999999999999", "123456789012345", "00012", "13", "A0", "A00", "12345678901234567890123"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in rows.orderBy(natural_order(F.col("n")), "n").collect()]
    assert got == ["00012", "13", "999999999999", "123456789012345", "12345678901234567890123", "A0", "A00", "neval 9ml", "NEVAL 10ML", "Nevál 100ml"]
