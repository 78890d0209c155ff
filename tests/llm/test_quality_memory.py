"""The texts go to the classifier once a pass, in small steps."""

from priceweave.llm import quality


def test_texts_are_sent_once(spark, monkeypatch):
    sent = []
    evidence = quality.with_evidence

    def seen(docs, *rest):
        sent.append(docs.schema.simpleString().count("text:string"))
        return evidence(docs, *rest)

    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"word {i} of some text", "a", "en") for i in range(60)], "doc_id long, text string, source string, lang string").coalesce(1)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality, "with_evidence", seen)
    want = {r["doc_id"]: (r["quality"], r["toxic"], r["keep"]) for r in quality.classify(docs, labels).collect()}
    assert sent == [1, 1]
    assert len(want) == 60
    # steps of a few bytes: offsets within a batch
    monkeypatch.setattr(quality, "SLICE_BYTES", 300)
    assert {r["doc_id"]: (r["quality"], r["toxic"], r["keep"]) for r in quality.classify(docs, labels).collect()} == want
