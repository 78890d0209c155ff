"""Deliveries appear as a whole or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from priceweave.sources.delivery import DeliverySource, report_of, settle


def deliver(df, path, mode="overwrite", **options):
    df.sparkSession.dataSource.register(DeliverySource)
    df.write.format("delivery").mode(mode).options(path=str(path), **options).save()


def names(folder):
    return sorted(os.listdir(folder))


def test_a_delivery_is_replaced_as_a_whole(spark, tmp_path):
    path = tmp_path / "out"
    deliver(spark.range(10).select("id", F.lit('a "b", c').alias("text")).repartition(3), path)
    assert report_of(str(path))["rows"] == 10
    back = spark.read.option("header", True).option("escape", '"').csv(f"{path}/*.csv")
    assert sorted((int(r["id"]), r["text"]) for r in back.collect()) == [(i, 'a "b", c') for i in range(10)]
    deliver(spark.range(4).coalesce(1), path, format="json")
    assert report_of(str(path))["rows"] == 4 and len(names(path)) == 2 and names(tmp_path) == ["out"]
    lines = [json.loads(x) for n in names(path) if n.endswith(".json") and n != "report.json" for x in (path / n).read_text().splitlines()]
    assert sorted(x["id"] for x in lines) == [0, 1, 2, 3]


def test_a_failing_task_leaves_the_destination(spark, tmp_path):
    path = tmp_path / "out"
    deliver(spark.range(5).coalesce(1), path)
    before = {n: (path / n).read_bytes() for n in names(path)}

    @F.udf("long")
    def breaks(x):
        if x == 77:
            raise ValueError("this row cannot be delivered")
        return x

    with pytest.raises(Exception, match="cannot be delivered"):
        deliver(spark.range(100).repartition(4).select(breaks("id").alias("id")), path)
    assert {n: (path / n).read_bytes() for n in names(path)} == before and names(tmp_path) == ["out"]


def test_an_existing_delivery_is_not_appended_to(spark, tmp_path):
    path = tmp_path / "out"
    deliver(spark.range(5), path)
    with pytest.raises(Exception, match="is there already"):
        deliver(spark.range(1), path, mode="append")
    assert report_of(str(path))["rows"] == 5 and names(tmp_path) == ["out"]


def test_an_empty_delivery_has_a_report(spark, tmp_path):
    deliver(spark.range(0), tmp_path / "out")
    assert report_of(str(tmp_path / "out"))["rows"] == 0 and names(tmp_path / "out") == ["report.json"]


def test_a_writer_that_died_between_the_renames(spark, tmp_path):
    path = tmp_path / "out"
    deliver(spark.range(3).coalesce(1), path)
    os.rename(path, tmp_path / "out.old-x")  # as if it had died here
    settle(str(path))
    assert names(tmp_path) == ["out"] and report_of(str(path))["rows"] == 3
    os.mkdir(tmp_path / "out.old-y")  # or behind the second rename
    settle(str(path))
    assert names(tmp_path) == ["out"]
