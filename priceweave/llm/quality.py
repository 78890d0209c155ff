"""Quality and toxicity by hierarchical empirical Bayes.

A document classifier, fitted on a bounded sample of the labelled rows, gives each document log-odds of being of good
quality and of being toxic. Grouped sums of its probabilities give each host (source) and each path in it (by default
source and language, as the documents have no addresses; any column serves) a posterior: a path shrinks towards its
host, a host towards the global mean. The strengths come from the spread between groups by the method of moments, for
hosts and for the paths of each host; groups are weighted by their documents, and the spread that sampling alone makes
is taken off. A document's log-odds are shifted by its path's posterior, leaving out its own share on both levels, so
sparse sites count as the average one.

Defined results
- null or empty text: features of no words; null source or language: groups of their own; null ids: ordinary rows.
- repeated rows: each is judged; equal texts of the sample are one row, with the greatest labels; labels without a
  document: unused.
- no labels, or one class only: the model is the base rate, and everything of good quality stays.
- ties: a document of exactly even odds stays. Extra columns are kept; in classify those
  with a result's name give way. Empty tables: no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosted import BoostedTrees, fit
from .common import SLICE_BYTES, cut, read, shielded, slices, utf8, without

#: The bound of the labelled sample that the classifier is fitted on.
SAMPLE_ROWS = 8000
#: Paths up to which their posteriors are sent to every task; beyond, they are joined by a shuffle.
BROADCAST_PATHS = 50_000

#: Lengths of the beginnings of words that may tell toxicity.
BEGINNINGS = (3, 4, 5, 6, 7)

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = b"%#$&*|!<>{}[]=~^\\/@+_"

_CLASS = np.zeros((256, 7))
FEATURES = 7 + 4
for _b in range(256):
    _c = bytes([_b])
    _CLASS[_b] = (_c.isalpha() or _b >= 128, _c.isupper(), _c.isdigit(), _c in _SYMBOLS, _c == b"|", _c == b"\n", _c in b".,;:!?")


def features(texts: pa.Array, words: list[list[str]]) -> np.ndarray:
    """A row for each text: shares of character classes, and how words are spread and repeated."""
    raw, offsets = utf8(texts)
    length = np.diff(offsets).astype(np.float64)
    out = np.zeros((len(words), FEATURES))
    # bytes counted by text and value; a bounded slice of texts at a time
    for s in range(0, len(words), 512):
        e = min(s + 512, len(words))
        part = raw[offsets[s] : offsets[e]]
        of = np.repeat(np.arange(e - s, dtype=np.int32) << 8, np.diff(offsets[s : e + 1]))
        counts = np.bincount(of + part, minlength=(e - s) << 8).reshape(e - s, 256)
        out[s:e, : _CLASS.shape[1]] = counts @ _CLASS / np.maximum(length[s:e, None], 1)
    for i, w in enumerate(words):
        n = len(w)
        if n:
            out[i, -4:] = np.log1p(n), len(set(w)) / n, sum(map(str.__eq__, w, w[1:])) / n, length[i] / n
    return out


def terms(words: set[str], lengths: Iterable[int], told: dict[int, set[str]] | None = None) -> set[str]:
    """The words, and the beginnings of these lengths that one, two or three of them share, as ^beginning#number:
    where compounds tell, a text holds several of a kind. told: the only beginnings that matter, by length."""
    out = set(words)
    for k in lengths:
        heads = [w[:k] for w in words if len(w) > k]
        shared = Counter(heads if told is None else [h for h in heads if h in told[k]])
        out.update(f"^{p}#{m}" for p, n in shared.items() for m in range(1, min(n, 3) + 1))
    return out


@dataclass
class Model:
    quality: BoostedTrees
    lexicon: dict[str, float]
    toxic_base: float

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lowered = [_WORD.findall((t or "").lower()) for t in texts.to_pylist()]
        # log-odds of good quality need words as written; the lower-cased ones serve both
        quality = self.quality.logit(features(texts, lowered)) if lowered else np.zeros(0)
        toxic = np.full(len(lowered), self.toxic_base)
        heads: dict[int, set[str]] = {}
        for w in self.lexicon:
            if w[0] == "^":
                heads.setdefault(len(w) - 3, set()).add(w[1:-2])
        for i, words in enumerate(lowered):
            told = self.lexicon.keys() & terms(set(words), heads, heads)
            if told:
                toxic[i] = max(self.lexicon[w] for w in told)
        return quality, toxic


def decision_list(there: list[set[int]], toxic: np.ndarray, shrink: float = 10.0, support: int = 2, least: float = 0.7) -> dict[int, float]:
    """Word -> shrunk log-odds of toxicity; greedy: each word must explain toxic documents that none before explains,
    so the other words of a document with many copies stay out."""
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
    open_ = {}
    for i, words in enumerate(there):
        for w in words:
            open_.setdefault(w, set()).add(i)
    out: dict[int, float] = {}
    done: set[int] = set()
    bad = set(np.flatnonzero(toxic).tolist())
    while open_:
        # a wrongly caught document outweighs several caught ones
        gain = {w: len((rows & bad) - done) - 4 * len(rows - bad - done) for w, rows in open_.items()}
        best = max(gain, key=lambda w: (gain[w], -len(open_[w]), -w))
        if gain[best] < support:
            break
        rows = open_.pop(best)
        p = (len(rows & bad) + shrink * rate) / (len(rows) + shrink)
        if p >= least:
            out[best] = float(np.log(p / (1 - p)))
            done |= rows
    return out


def fit_model(docs: DataFrame, labels: DataFrame) -> Model:
    """From SAMPLE_ROWS labelled documents at most, the first by a hash of their ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "quality", "toxic")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(SAMPLE_ROWS)
    # the sample has a fixed bound
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # ids and texts that repeat are one row: the sample keeps its bound, and copies tell no more than one
    rows = cut(rows.groupBy("text").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("text"), "text").limit(SAMPLE_ROWS))

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few texts at a time: their terms are many times their size
        for batch in slices(batches, 500, SLICE_BYTES // 2):
            n, bad = Counter(), Counter()
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                found = terms(set(_WORD.findall((text or "").lower())), BEGINNINGS)
                n.update(found)
                if toxic:
                    bad.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64()), pa.array([bad[w] for w in n], pa.int64())], names=["word", "n", "bad"])

    counted = rows.mapInArrow(counts, "word string, n long, bad long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    told = [r["word"] for r in counted.where((F.col("bad") >= 5) & (F.col("bad") >= 0.75 * F.col("n"))).orderBy(F.desc("bad"), "word").collect()]  # of a bounded sample
    place = {w: i for i, w in enumerate(told)}

    def evidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lowered = [_WORD.findall((t or "").lower()) for t in batch["text"].to_pylist()]
            there = [sorted(place[w] for w in place.keys() & terms(set(x), BEGINNINGS)) for x in lowered]
            yield pa.RecordBatch.from_arrays([pa.array(list(features(batch["text"], lowered)), pa.list_(pa.float64())), pa.array(there, pa.list_(pa.int32())), batch["quality"].cast(pa.int32()), batch["toxic"].cast(pa.int32())], names=["x", "there", "quality", "toxic"])

    got = rows.mapInArrow(evidence, "x array<double>, there array<int>, quality int, toxic int").toPandas()
    x = np.array(got["x"].tolist()) if len(got) else np.zeros((0, FEATURES))
    toxic = got["toxic"].to_numpy(np.float64)
    listed = decision_list([set(t) for t in got["there"]], toxic)
    lexicon = {told[i]: v for i, v in listed.items()}
    rest = np.array([not (set(t) & listed.keys()) for t in got["there"]], bool)
    base = (toxic[rest].sum() + 0.5) / (rest.sum() + 5)
    return Model(fit(x, got["quality"].to_numpy(np.float64) if len(got) else np.ones(0)), lexicon, float(np.log(base / (1 - base))))


#: The columns that classify adds.
JUDGED = ("quality", "toxic", "site_quality", "site_toxic", "keep")
EVIDENCE = [("quality_logit", pa.float64(), T.DoubleType()), ("toxic_logit", pa.float64(), T.DoubleType())]


def with_evidence(docs: DataFrame, model: Model, text: Callable[[pa.RecordBatch], pa.Array] = lambda b: b["text"]) -> DataFrame:
    """docs' columns and the classifier's log-odds. text: where a batch has the texts."""
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, byte_limit=SLICE_BYTES):
            quality, toxic = sent.value.logits(text(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quality), pa.array(toxic)], names=[*names, "quality_logit", "toxic_logit"])

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, _, t in EVIDENCE)]))


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _probability(logit):
    return 1 / (1 + F.exp(-logit))


#: Bounds of a prior's strength, in documents.
STRENGTH = (1.0, 1000.0)


def _spread(groups: DataFrame, parent: str, kind: str, n: str) -> DataFrame:
    """parent, strength: of the Beta prior of a parent's groups, by the method of moments.

    The groups' means are weighted by their documents; what sampling alone would spread them by is taken off, so many
    tiny groups of one kind don't look like groups that differ. groups: parent, n, kind (a sum)."""
    total, sums = F.sum(n), F.sum(kind)
    by = groups.groupBy(parent).agg(total.alias("t"), sums.alias("s"), F.count("*").alias("m"), F.sum(F.col(n) * F.col(n)).alias("q"), F.sum(F.col(kind) * F.col(kind) / F.col(n)).alias("u"))
    mean = F.col("s") / F.col("t")
    between = F.col("u") - F.col("s") * mean  # sum of n * (mean of group - mean)^2
    noise = mean * (1 - mean)
    # E[between] = (m - 1) * noise + (t - q / t) * (1 - 1 / t) * variance, up to the variance's own part in noise
    variance = (between - (F.col("m") - 1) * noise) / F.greatest(F.col("t") - F.col("q") / F.col("t"), F.lit(1e-9))
    strength = F.when((F.col("m") > 1) & (variance > 1e-9), noise / variance - 1).otherwise(F.lit(STRENGTH[1]))
    return by.select(parent, F.least(F.greatest(strength, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])).alias("strength"))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """host, path, n, host_n, and for quality and toxic: sum, host_sum, mean (global), host_strength and strength (of the
    host's paths).

    evidence: host, path, quality_logit, toxic_logit. Only sums are shuffled, a row for each path and task."""
    kinds = ("quality", "toxic")
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(_probability(F.col(f"{k}_logit"))).alias(k) for k in kinds])
    paths = cut(paths)  # the texts are read once for the sums, whatever is derived from them
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(k).alias(f"host_{k}") for k in kinds])
    out = paths.join(hosts, "host").withColumn("all", F.lit(0))
    total = hosts.groupBy(F.lit(0).alias("all")).agg(F.sum("host_n").alias("all_n"), *[F.sum(f"host_{k}").alias(f"all_{k}") for k in kinds])
    for k in kinds:
        of_host = _spread(hosts.withColumn("all", F.lit(0)), "all", f"host_{k}", "host_n").withColumnRenamed("strength", f"host_strength_{k}")
        total = total.join(of_host, "all").withColumn(f"mean_{k}", (F.col(f"all_{k}") + 0.5) / (F.col("all_n") + 1))
        out = out.join(_spread(paths, "host", k, "n").withColumnRenamed("strength", f"strength_{k}"), "host")
    # one row
    return out.join(F.broadcast(total), "all").drop("all")


def leave_one_out(kind: str, own: Column) -> Column:
    """The posterior mean of a document's path by the other documents: of the host shrunk towards the global mean, and of
    the path shrunk towards the host. The document's own share (own) counts on no level."""
    mean, host_strength, strength = F.col(f"mean_{kind}"), F.col(f"host_strength_{kind}"), F.col(f"strength_{kind}")
    host = (F.col(f"host_{kind}") - own + host_strength * mean) / (F.col("host_n") - 1 + host_strength)
    return (F.col(kind) - own + strength * host) / (F.col("n") - 1 + strength)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", weight: float = 0.5) -> DataFrame:
    """docs' columns, quality and toxic (probabilities), site_quality, site_toxic (the path's posteriors), keep.

    weight: share of a path's shift that a document takes. The texts are read by the classifier twice, for the sums
    and for the decisions, and are never shuffled while the paths can be broadcast."""
    docs = without(docs, JUDGED)
    model = fit_model(docs, labels)
    site = [F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path")]
    sites = cut(site_posteriors(with_evidence(docs.select("text", *site), model).drop("text")))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    # the texts go to the tasks and back once, within their rows
    inner = docs.select(row, *site)
    small = sites.count() <= BROADCAST_PATHS
    judged = with_evidence(inner.join(F.broadcast(sites) if small else sites, ["host", "path"], "left"), model, lambda b: b["row"].field("text"))
    found = {}
    for k in ("quality", "toxic"):
        site_mean = leave_one_out(k, _probability(F.col(f"{k}_logit")))
        found[f"site_{k}"] = site_mean
        found[k] = _probability(F.col(f"{k}_logit") + weight * (_logit(site_mean) - _logit(F.col(f"mean_{k}"))))
    out = judged.select("row.*", *[v.alias(k) for k, v in found.items()])
    return out.withColumn("keep", (F.col("quality") >= 0.5) & (F.col("toxic") <= 0.5))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify keeps, with docs' columns."""
    docs, back = shielded(docs, JUDGED)
    return classify(docs, labels).where("keep").select(*back)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return classify(docs, read(spark, sf_dir, "labels")).select("doc_id", "quality", "toxic", "site_quality", "site_toxic", "keep")


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
