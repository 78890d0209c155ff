"""Exhaustive and awkward cases that the operators' main tests leave out."""

import itertools

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from priceweave.llm import extract

from .cases import SCHEMA, awkward, frame


@pytest.mark.parametrize("n", [1, 2, 5, 8, 11])
def test_decoding_is_the_best_of_all_choices(n):
    r = np.random.default_rng(n)
    for _ in range(6 if n < 10 else 3):
        tree = object.__new__(extract.Tree)
        tree.tag = ["div"] * n
        tree.parent = [-1, *(int(r.integers(0, i)) for i in range(1, n))]
        logit, cut = r.normal(size=n) * 3, float(r.choice([0.0, 0.5, 1.0, 3.0]))
        weight = np.clip(logit, -4, 4)

        def worth(chosen):
            return sum(weight[i] if chosen[i] else -weight[i] for i in range(n)) - cut * sum(not chosen[i] and chosen[tree.parent[i]] for i in range(1, n))

        def consistent(chosen):
            return all(chosen[tree.parent[i]] or not chosen[i] for i in range(1, n))

        best = max(worth(c) for c in ((True, *rest) for rest in itertools.product([True, False], repeat=n - 1)) if consistent(c))
        chosen = tree.decode(logit, cut)
        assert consistent(chosen) and worth(chosen) == pytest.approx(best)


def test_extract_on_an_empty_table_and_extra_columns(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "y"), (2, "v", "<p>" + "word " * 40 + "</p>", "z")], "page_id long, url string, html string, text string")
    model = extract.fit_model(pages=20)
    out = extract.extract(pages, model)
    assert out.columns == ["page_id", "url", "text"] and out.where("text is null").count() == 0 and out.count() == 3
    assert extract.extract(pages.limit(0), model).count() == 0


def test_all_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_stages_on_awkward_rows(spark, tmp_path):
    """Clashing names, ties, nulls, repeated rows and long texts go through all stages."""
    rows = [*awkward(), awkward()[6], (None, *awkward()[7][1:]), (None, None, None, None, None, None, None, None, None)]
    labels = [(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(20)] + [(None, 1, 0), (3, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(awkward()[16][1].split()[:12])), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        after = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert after.columns == now.columns and after.count() <= now.count()
            # a stage makes no rows: each one has the columns of one before it
            assert after.select("doc_id", "keep", "row").subtract(now.select("doc_id", "keep", "row")).count() == 0
            assert after.where(F.col("n_chars") < 0).count() == 0
        now = after
    assert now.where("length > 1024 or offset < 0").count() == 0
