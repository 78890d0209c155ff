import datetime

import pytest

from priceweave.streaming import orders


def drain(query, spark, name):
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


@pytest.fixture
def landing(spark, tmp_path):
    def put(number, rows):
        spark.createDataFrame(rows, "key long, ts timestamp, state string").coalesce(1).write.parquet(str(tmp_path / f"in/{number}"))

    put(0, [(1, datetime.datetime(2024, 1, 1), "pending"), (2, datetime.datetime(2024, 1, 1), "pending"), (3, datetime.datetime(2024, 1, 2), "received")])
    stream = spark.readStream.schema("key long, ts timestamp, state string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    return put, stream, str(tmp_path)


def test_pending_orders_expire(spark, landing):
    put, stream, path = landing
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        try:
            q = orders.expiring(stream).writeStream.format("memory").queryName("expiry").option("checkpointLocation", f"{path}/state").outputMode("append").start()
            q.processAllAvailable()
        except Exception as e:  # the state server needs packages that not every installation has
            if "protobuf" in str(e).lower() or "ModuleNotFound" in str(e):
                pytest.skip(str(e)[:200])
            raise
        put(1, [(2, datetime.datetime(2024, 2, 20), "pending")])
        q.processAllAvailable()
        put(2, [(9, datetime.datetime(2024, 3, 5), "pending")])
        q.processAllAvailable()
        put(3, [(9, datetime.datetime(2024, 3, 6), "pending")])
        got = {(r["key"], r["outcome"]) for r in drain(q, spark, "expiry")}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert (3, "received") in got and (1, "expired") in got and (2, "expired") not in got


def test_versioned_sink_keeps_the_newest(spark, tmp_path):
    write = orders.versioned_sink(str(tmp_path / "t"), ["k"], "v")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v long, x string")
    write(frame([(1, 1, "a"), (2, 5, "b")]), 0)
    write(frame([(1, 2, "c"), (2, 4, "d")]), 1)
    write(frame([(1, 2, "c"), (2, 4, "d")]), 1)  # a replay
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/batch=1")).select("k", "v", "x").collect()) == [(1, 2, "c"), (2, 5, "b")]


def test_sessions_close_after_silence(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    spark.createDataFrame([(1, at(0)), (1, at(3)), (1, at(20)), (2, at(60))], "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = orders.sessions(stream).writeStream.format("memory").queryName("runs").outputMode("append").start()
    got = sorted((r["user_id"], r["n"]) for r in drain(q, spark, "runs"))
    assert (1, 2) in got


def test_questions_are_asked_again_after_a_week(spark, tmp_path):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)

    def put(number, rows):
        spark.createDataFrame(rows, "key long, ts timestamp, answer string").coalesce(1).write.parquet(str(tmp_path / f"in/{number}"))

    put(0, [(1, day(1), "no"), (2, day(1), "no"), (4, day(1), "yes"), (5, day(1), "no"), (5, day(1, 1), "asked")])
    stream = spark.readStream.schema("key long, ts timestamp, answer string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = orders.ask_again(stream).writeStream.format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    q.processAllAvailable()
    put(1, [(2, day(3), "yes"), (3, day(5), "no")])
    q.processAllAvailable()
    put(2, [(9, day(9), "yes")])
    q.processAllAvailable()
    assert [(r["key"], r["due"]) for r in spark.sql("SELECT * FROM due").collect()] == [(1, day(8))]
    put(3, [(9, day(20), "yes")])
    got = {(r["key"], r["due"]) for r in drain(q, spark, "due")}
    assert got == {(1, day(8)), (3, day(12))}
