"""The pipeline's stages keep clean documents, act on what they find, and hand on the columns of documents."""

import corpus_pipeline
from pyspark.sql import functions as F

from .cases import SCHEMA


def test_stages(spark, tmp_path):
    prose = lambda k, n=80: " ".join(f"w{(k * 37 + i * (k + 3)) % 997}" for i in range(n))
    line = "a line that many documents repeat without any change"
    rows = []
    for k in range(60):
        rows.append((k, f"{prose(k)}\n{prose(k + 200, 20)}" + (f"\n{line}" if k % 6 == 0 else "")))
    rows.append((60, rows[1][1].replace(" ", "  ", 1).replace("\n", " ")))  # a near copy of 1
    rows += [(k, "%%% ### spam %%% " * 40) for k in range(61, 75)]
    rows += [(k, prose(k) + " vile") for k in range(75, 115)]
    rows.append((115, None))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, int(not 61 <= i < 75), int(75 <= i < 115)) for i in range(115) if i % 5 or i >= 61]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, " ".join(prose(5).split()[10:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append(now)
        if k < 4:
            assert now.columns == docs.columns
            assert now.where(F.col("n_chars") != F.char_length("text")).count() == 0
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen]
    clean = set(range(60))
    assert clean <= ids[0] and not ids[0] & set(range(61, 115))
    assert clean <= ids[1]
    assert sum(line in r["text"] for r in seen[1].where("text is not null").collect()) == 1
    assert clean <= ids[2] and 60 not in ids[2]
    cleaned = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert " ".join(prose(5).split()[10:30]) not in cleaned[5] and prose(6) in cleaned[6]
    assert ids[4] == ids[3]


def test_stage_on_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
