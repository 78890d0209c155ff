"""Version tables: replays, crashes, overtaken writers, broken constraints, and how much a batch writes."""

import os

import pytest
from pyspark.sql import functions as F

from priceweave.sources.versioned import ConstraintBroken, Overtaken, VersionTable


def rows(spark, pairs):
    return spark.createDataFrame([(k, v, r) for k, v, r in pairs], "key long, value string, removed boolean")


def at(day):
    return F.lit(f"2024-01-{day:02d}")


def versions(t, state=None):
    return sorted((r["key"] if r["key"] is not None else -1, r["version"], r["value"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day) for r in t.read(state).collect())


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_versions_of_a_key(spark, tmp_path):
    t = VersionTable(spark, str(tmp_path / "t"), "key long", "value string", buckets=4)
    assert t.read().count() == 0 and t.current().count() == 0
    t.upsert(rows(spark, [(1, "a", None), (2, "b", False), (3, None, None), (None, "n", None)]), at(1))
    t.upsert(rows(spark, [(1, "a", None), (2, "c", None), (3, "x", None), (9, "z", True), (None, "m", None)]), at(2))
    t.upsert(rows(spark, [(2, "c", True), (3, None, None)]), at(3))
    t.upsert(rows(spark, [(2, "c", None)]), at(4))
    assert versions(t) == [(-1, 1, "n", 1, 2), (-1, 2, "m", 2, None), (1, 1, "a", 1, None), (2, 1, "b", 1, 2), (2, 2, "c", 2, 3), (2, 3, "c", 4, None), (3, 1, None, 1, 2), (3, 2, "x", 2, 3), (3, 3, None, 3, None)]
    assert len(versions(t, 1)) == 4 and t.states() == [1, 2, 3, 4]
    assert {(r["key"], r["value"]) for r in t.current(3).collect()} == {(None, "m"), (1, "a"), (3, None)}
    assert t.vacuum(keep=1) >= 1 and t.states() == [4] and len(versions(t)) == 9


def test_replayed_batches_change_nothing(spark, tmp_path):
    t = VersionTable(spark, str(tmp_path / "t"), "key long", "value string")
    for number, value in ((0, "a"), (1, "b"), (1, "b"), (0, "a")):
        t.upsert(rows(spark, [(1, value, None)]), at(number + 1), "stream", number)
    assert versions(t) == [(1, 1, "a", 1, 2), (1, 2, "b", 2, None)] and t.states() == [1, 2]
    t.upsert(rows(spark, [(1, "c", None)]), at(3), "other", 0)
    assert len(versions(t)) == 3


def test_a_crash_before_the_manifest_leaves_the_table(spark, tmp_path, monkeypatch):
    t = VersionTable(spark, str(tmp_path / "t"), "key long", "value string")
    t.upsert(rows(spark, [(1, "a", None)]), at(1), "s", 0)

    def dies(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(VersionTable, "_put", dies)
        with pytest.raises(KeyboardInterrupt):
            t.upsert(rows(spark, [(1, "b", None)]), at(2), "s", 1)
    assert versions(t) == [(1, 1, "a", 1, None)]
    t.upsert(rows(spark, [(1, "b", None)]), at(2), "s", 1)
    assert versions(t) == [(1, 1, "a", 1, 2), (1, 2, "b", 2, None)]
    assert t.vacuum() == 1  # what the dead writer left


def test_an_overtaken_writer_fails(spark, tmp_path, monkeypatch):
    t, other = (VersionTable(spark, str(tmp_path / "t"), "key long", "value string") for _ in range(2))
    t.upsert(rows(spark, [(1, "a", None)]), at(1))
    merged = VersionTable._merged

    def slow(self, *args):
        monkeypatch.setattr(VersionTable, "_merged", merged)
        other.upsert(rows(spark, [(1, "b", None)]), at(2))
        return merged(self, *args)

    monkeypatch.setattr(VersionTable, "_merged", slow)
    with pytest.raises(Overtaken):
        t.upsert(rows(spark, [(1, "c", None)]), at(3))
    assert versions(t) == [(1, 1, "a", 1, 2), (1, 2, "b", 2, None)]
    assert t.vacuum(keep=2) == 0  # the loser's files are gone already


def test_a_broken_constraint_leaves_the_table(spark, tmp_path):
    t = VersionTable(spark, str(tmp_path / "t"), "key long", "value string")
    t.upsert(rows(spark, [(1, "a", None)]), at(1))
    with pytest.raises(ConstraintBroken):
        t.upsert(rows(spark, [(1, "b", None), (1, "c", None)]), at(2))
    assert versions(t) == [(1, 1, "a", 1, None)] and t.states() == [1]


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    t = VersionTable(spark, str(tmp_path / "t"), "key long", "value string", buckets=64)
    t.upsert(spark.range(20_000).select(F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value")), at(1))
    whole = written(tmp_path)
    t.upsert(rows(spark, [(5, "x", None)]), at(2))
    one = written(tmp_path) - whole
    assert one < whole / 20
    t.upsert(rows(spark, [(k, "y", None) for k in range(8)]), at(3))
    assert written(tmp_path) - whole - one < 10 * one


def test_a_stream_into_a_table(spark, tmp_path):
    source, t = str(tmp_path / "in"), VersionTable(spark, str(tmp_path / "t"), "key long", "value string", buckets=4)
    for k in range(3):
        spark.createDataFrame([(1, f"v{k}"), (10 + k, "x")], "key long, value string").coalesce(1).write.mode("append").parquet(source)
    q = spark.readStream.schema("key long, value string").option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(t.sink("s")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert t.read().where("key = 1").count() == 3 and t.current().count() == 4 and t.manifest()["applied"] == {"s": 2}
