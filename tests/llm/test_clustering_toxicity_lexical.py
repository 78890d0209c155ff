"""Clustering, toxicity and ranked search against plain versions, and their defined results on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from priceweave.llm import clustering, lexical, toxicity

from .cases import SCHEMA, awkward, frame

# 11


def plain_clusters(rows, k, rounds, width):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(kept, key=name)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((square(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    final = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in final:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i if i is not None else -1, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in final))


def vectors(n=400, width=8, seed=5):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 2, (12, width))
    rows = [(i, [float(x) for x in centres[r.integers(12)] + r.normal(0, 0.7, width)]) for i in range(n)]
    rows += [(n + i, [round(float(x)) for x in r.normal(0, 0.5, width)]) for i in range(60)]  # many ties
    rows += [rows[3], rows[3], (None, rows[5][1]), (900, None), (901, [1.0] * (width - 1)), (902, [float("nan")] + [0.0] * (width - 1)), (903, [None] + [0.0] * (width - 1)), (904, [float("inf")] + [0.0] * (width - 1)), (905, [])]
    return [(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows]


@pytest.mark.parametrize("k,rounds", [(40, 5), (9, 8), (2, 3), (1, 2), (600, 2)])
def test_clusters_equal_plain(spark, k, rounds):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string").repartition(3)
    report = []
    got = clustering.cluster(clustering.integers(df, 8), k=k, rounds=rounds, width=8, report=report).collect()
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1, *list(r)[1:]) for r in got) == plain_clusters([(i, v) for i, v, _ in rows], k, rounds, 8)
    if k == 40:
        # the bounds save distances, and the lists grow no longer
        assert report[-1][1] < 0.8 * report[0][1] and report[-1][0] <= report[0][0] == 10
    assert len(report) == rounds + 1


def test_clusters_of_nothing_and_of_large_components(spark):
    schema = "vec_id long, embedding array<float>"
    assert clustering.cluster(clustering.integers(spark.createDataFrame([(1, None)], schema), 64)).count() == 0
    rows = [(1, [3e37, 0.0]), (2, [-3e37, 5.0]), (3, [30000.0, 1.0])]
    got = clustering.cluster(clustering.integers(spark.createDataFrame(rows, schema), 2), k=2, rounds=1, width=2).collect()
    assert len(got) == 3 and all(r["distance"] >= 0 for r in got)


def test_bounds_shorten_to_the_remainder():
    bounds = clustering.Bounds(1, 3)
    bounds.near, bounds.lower, bounds.rest = np.array([[4, 2, 7]], np.int32), np.array([[1.0, 6.0, 3.0]]), np.array([5.0])
    bounds.shorten(1)
    assert bounds.near.tolist() == [[4]] and bounds.rest.tolist() == [3.0]


# 12


def toxic_rows(n=900, seed=1):
    r = random.Random(seed)
    syllables = ["ba", "lo", "mi", "ren", "tu", "sa", "ki", "do", "fe", "nu", "gor", "pla"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.choice([8, 40, 200]))]
        toxic = i % 6 == 0
        if toxic:
            for at in range(0, len(words), 20):
                words[at] = "vexi" + word()  # compounds, most of them unseen
        rows.append((i, " ".join(words), "en", "s", 0, "x", "y", "z", "w"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_finds_unseen_compounds_of_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, rows)
    model = toxicity.fit_model(docs.select("doc_id", "text"), spark.createDataFrame(labels, LABELS))
    assert not any(s == "<vexiba>" for s in model.values) or any(s.startswith("<vex") for s in model.values)
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs.withColumn("held", toxicity.held_out(docs.doc_id)), model).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in out if out[i]["held"]} == set(held)
    bad = [i for i in held if i % 6 == 0]
    assert sum(out[i]["predicted"] for i in bad) >= 0.9 * len(bad)
    assert sum(out[i]["predicted"] for i in held if i % 6) <= 0.02 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())


def test_toxicity_never_learns_from_held_out_labels(spark):
    rows, labels = toxic_rows(300)
    docs = frame(spark, rows).select("doc_id", "text")
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    one, two = (toxicity.fit_model(docs, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert one.prior == two.prior and one.values == two.values and one.values


def test_toxicity_score_is_the_mean_of_the_words(spark):
    model = toxicity.Model(-2.0, {"<ab": 3.0, "abc": 5.0, "<xy>": -1.0})
    for text in (None, "", "1 2", "abc xy zz", "ABC-xy\nabc", "q" * 5000):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        worth = []
        for w in words:
            marked = f"<{w}>"
            parts = {marked} | {marked[i : i + n] for n in (3, 4, 5, 6) for i in range(len(marked) - n + 1)}
            found = [model.values[p] for p in parts if p in model.values]
            worth.append(sum(found) / len(found) if found else 0)
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(2.0 - (sum(worth) / len(worth) if worth else 0))))


def test_toxicity_gradient(monkeypatch):
    # one step of plain descent on the joint parameters lowers the loss
    rows, labels = toxic_rows(120)
    y = np.array([t for *_, t in labels], float)
    loss = lambda m: -np.mean([math.log(max(1e-9, m.score(r[1]) if t else 1 - m.score(r[1]))) for r, t in zip(rows, y)])
    losses = [loss(toxicity.fit([r[1] for r in rows], y, epochs=n)) for n in (0, 5, 40, 100)]
    assert losses[0] > losses[1] > losses[2] > losses[3]


def test_toxicity_on_awkward_rows(spark):
    docs = frame(spark, awkward() + [awkward()[6], (None, *awkward()[7][1:])])
    none = spark.createDataFrame([], LABELS)
    for labels in (none, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, 1, None)], LABELS), spark.createDataFrame([(i, 1, i % 2) for i in range(20)], LABELS)):
        model = toxicity.fit_model(docs.select("doc_id", "text"), labels)
        out = toxicity.score_toxicity(docs.withColumnRenamed("spans", "Score"), model)
        assert out.count() == len(awkward()) + 2 and "Score" not in out.columns and "keep" in out.columns
        scores = {r["score"] for r in out.where("text is null or text = ''").collect()}
        assert len(scores) == 1
    assert toxicity.score_toxicity(spark.createDataFrame([], SCHEMA), model).count() == 0
    assert toxicity.fit_model(spark.createDataFrame([], SCHEMA).select("doc_id", "text"), none).values == {}


# 13


def plain_rank(docs, items, k):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(lower))
    there = [(i, terms(t)) for i, t in docs if i is not None]
    there = [(i, w) for i, w in there if w]
    n_docs, size = len(there), sum(len(w) for _, w in there)
    held = Counter(t for _, w in there for t in set(w))
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, query in asked.items():
        found = []
        for place, (i, w) in enumerate(there):
            tf = Counter(w)
            m = 50 + 50 * len(w) * n_docs // size
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in query if tf[t])
            if score > 0:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def asked_items(rows):
    words = rows[16][1].split()
    return [(1, " ".join(words[20:45])), (2, "One TWO é ☃"), (3, None), (4, ""), (5, "ab ab ab"), (None, "one"), (6, "nothing-of-this 123456"), (7, " ".join(words[:8])), (7, "one " + " ".join(words[40:60])), (8, "line stands in several documents")]


@pytest.mark.parametrize("k,small", [(50, False), (3, True), (1, True)])
def test_rank_equals_plain(spark, monkeypatch, k, small):
    rows = awkward() + [awkward()[6], (None, *awkward()[7][1:])]
    block = lexical.BLOCK_TERMS
    if small:
        monkeypatch.setattr(lexical, "RANGE_DOCS", 4)
        monkeypatch.setattr(lexical, "TOP", 1)
        monkeypatch.setattr(lexical, "SHIFT", 1)
        monkeypatch.setattr(lexical, "PIECE", 50)
        block = 30
    items = spark.createDataFrame(asked_items(rows), "item_id long, text string")
    got = sorted(tuple(r) for r in lexical.rank(frame(spark, rows, parts=2), items, k=k, block_terms=block).collect())
    assert got == plain_rank([(r[0], r[1]) for r in rows], asked_items(rows), k)


def test_rank_of_nothing(spark):
    items = spark.createDataFrame(asked_items(awkward()), "item_id long, text string")
    assert lexical.rank(spark.createDataFrame([], SCHEMA), items).count() == 0
    assert lexical.rank(frame(spark), items.limit(0)).count() == 0
    assert lexical.rank(frame(spark, awkward()[:4]), items).count() == 0


def test_trees_prune_and_open_ties():
    r = np.random.default_rng(2)
    docs, n_terms = 4000, 30
    doc, term = np.repeat(np.arange(docs), 6), r.integers(0, n_terms, 6 * docs)
    doc, term = np.divmod(np.unique(doc * n_terms + term), n_terms)
    # values that fall along the documents, and equal ones in the last quarter
    value = np.where(doc < 3000, 5000 - doc + r.integers(0, 50, len(doc)), 7)
    trees = lexical.MaxTrees(docs, doc, term, value)
    # a document holds six of thirty terms, so the bounds of few terms are near their sums and those of all are far
    for terms, share in ((np.array([0, 3, 9]), 0.6), (np.array([29]), 0.6), (np.arange(30), 1.0)):
        scores = np.zeros(docs, np.int64)
        there = np.isin(term, terms)
        np.add.at(scores, doc[there], value[there])
        ids = r.permutation(docs)
        best = []
        opened = trees.search(terms, ids, 20, best)
        want = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if s > 0)[:20]
        assert sorted((-s, -i) for s, i in best) == want
        assert opened < share * sum(nodes for nodes, _, _ in trees.levels[1:])
    # where all tie, every node is opened and the smallest ids win
    best = []
    flat = lexical.MaxTrees(docs, np.arange(docs), np.zeros(docs, np.int64), np.full(docs, 7))
    ids = r.permutation(docs)
    flat.search(np.array([0]), ids, 20, best)
    assert sorted(-i for _, i in best) == list(range(20))
