"""Every query with SQL gives what the SQL gives, on the smallest tables; the others run."""

import math

import duckdb
import pandas as pd
import pytest

from priceweave.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    def value(v):
        if isinstance(v, (list, dict, str)):
            return v
        if v is None or v is pd.NA or pd.isna(v) or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    columns = sorted(frame.columns)
    return columns, sorted((tuple(value(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, db, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if name in catalogue.oracles():
        assert plain(got) == plain(db.sql(catalogue.oracles()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_whole_tables(spark, tmp_path):
    rows = [(k, f"blue anvil {k % 3}", f"Brand#{k % 90}", 7 if k % 50 == 0 else 1 + k % 6, 1.0) for k in range(1, 2601)]
    small = [x for x in rows if x[0] <= 300]
    for name, part in (("large", rows), ("small", small)):
        spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/{name}/part.parquet")
    missing = {r[0] for r in catalogue.queries()["missing_pages_anti"](spark, f"{tmp_path}/large").collect()}
    assert missing == set(range(50, 2601, 50))
    scored = catalogue.queries()["semantic_score"](spark, f"{tmp_path}/small").collect()
    assert {r["qid"] for r in scored} == {x[0] for x in small}
    for x in small:
        others = [y for y in small if y[2] == x[2] and y[0] != x[0]]
        assert len([r for r in scored if r["qid"] == x[0]]) == min(5, len(others))
