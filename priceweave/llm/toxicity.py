"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its subwords: the word itself and its character n-grams, with marks at its
beginning and end, so a misspelling or a compound that no label has seen shares vectors with the words it is made of.
Words without any have the zero vector. The vectors of a text's words are averaged and go into a linear softmax of two
classes. Vectors and softmax are trained jointly, in numpy, over the subwords that tell the classes apart.

The model is fitted in one task on a bounded sample of the labelled rows (SAMPLE_ROWS texts, SAMPLE_BYTES in all, chosen
by a hash); all rows are scored, in one pass without a shuffle. What is broadcast is the model, folded to a number for
each of SUBWORDS subwords at most: the difference of the softmax's rows times a vector is all that a score needs.

Defined results
- null or empty text, or one without letters: the score of the zero vector.
- labels: of rows that repeat an id or a text the greatest counts, each text of the sample is there once. Held-out rows
  (crc32 of the id, as text, modulo 4 is 2) never enter the sample. Null ids have no labels and are not held out. No
  labels, or none of one class: every score is the share of toxic ones.
- repeated rows are each scored; texts of any length are read whole. Empty tables give no rows. Extra columns are kept in
  score_toxicity, those with a result's name give way.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, read, slices, without

#: The bound of the labelled sample: texts, and bytes of all texts.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 24_000_000
#: Subwords that have a vector at most, and what makes one telling.
SUBWORDS, CERTAIN, TEXTS, REPEATS = 100_000, 4.5, 3, 8
#: Lengths of character n-grams, numbers of a vector, passes over the sample.
GRAMS, DIMENSIONS, EPOCHS, RIDGE = (3, 4, 5, 6), 8, 100, 1e-4
#: Words whose scores a worker keeps.
KEPT = 200_000
THRESHOLD = 0.3
#: What averages are multiplied by, so that a few telling words of a text weigh enough.
SCALE = 64

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def subwords(word: str) -> set[str]:
    marked = f"<{word}>"
    return {marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1))}


@dataclass
class Model:
    """What subwords add to the log-odds, and the log-odds of a text without any."""

    prior: float
    values: dict[str, float]
    kept: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        there = self.kept.get(word)
        if there is None:
            found = [self.values[s] for s in subwords(word) if s in self.values]
            there = sum(sorted(found)) / len(found) if found else 0.0
            if len(self.kept) < KEPT:
                self.kept[word] = there
        return there

    def score(self, text: str | None) -> float:
        words = words_of(text)
        mean = sum(map(self.word, words)) / len(words) if words and self.values else 0.0
        return float(1 / (1 + np.exp(-(self.prior + mean))))


class Sample:
    """Texts as numbered words, and the words' telling subwords.

    A subword is told by how much more often words of toxic texts hold it than words of the others, or the other way: the
    logarithm of the ratio is CERTAIN times its standard error at least, and TEXTS different texts of that kind hold it.
    Others say nothing but by chance, and would only let the vectors remember single texts."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        number: dict[str, int] = {}
        words = [np.array([number.setdefault(x, len(number)) for x in words_of(t)], np.int64) for t in texts]
        self.n, self.n_words = len(texts), len(number)
        size = np.array([len(w) for w in words])
        self.text, self.word, count = _pairs(np.repeat(np.arange(self.n), size), np.concatenate(words), self.n_words)
        self.share = count / size[self.text]
        place: dict[str, int] = {}
        parts = [np.array([place.setdefault(s, len(place)) for s in sorted(subwords(w))], np.int64) for w in number]
        of_word = np.repeat(np.arange(self.n_words), [len(x) for x in parts])
        subword = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        # a text's repetitions of a word count REPEATS times at most
        bad = toxic[self.text] > 0
        seen = np.minimum(count, REPEATS).astype(np.float64)
        held = [np.bincount(subword, np.bincount(self.word[of], seen[of], self.n_words)[of_word], len(place)) + 0.5 for of in (~bad, bad)]
        rate = np.log(held[1] / (seen[bad].sum() + 1)) - np.log(held[0] / (seen[~bad].sum() + 1))
        telling = np.abs(rate) >= CERTAIN * np.sqrt(1 / held[0] + 1 / held[1])
        keep = telling[subword]
        of_word, subword = of_word[keep], subword[keep]
        # in how many texts of its kind each one is
        at = np.searchsorted(of_word, np.arange(self.n_words + 1))
        n = np.diff(at)[self.word]
        each = np.repeat(at[self.word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        text, sub, _ = _pairs(np.repeat(self.text, n), subword[each], max(len(place), 1))
        of_kind = (toxic[text] > 0) == (rate[sub] > 0)
        telling &= np.bincount(sub[of_kind], minlength=len(place)) >= TEXTS
        order = np.lexsort((np.arange(len(place)), -np.abs(rate)))
        listed = np.sort(order[telling[order]][:SUBWORDS])
        new = np.full(len(place), -1)
        new[listed] = np.arange(len(listed))
        keep = new[subword] >= 0
        self.of_word, self.subword = of_word[keep], new[subword[keep]]
        self.weight = 1 / np.maximum(np.bincount(self.of_word, minlength=max(self.n_words, 1)), 1)[self.of_word]
        names = list(place)
        self.listed = [names[i] for i in listed]


def _pairs(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of a and b, and how often each occurs."""
    both, n = np.unique(a * width + b, return_counts=True)
    return both // width, both % width, n


class Adam:
    """Gradient steps, each parameter scaled by its own gradients' size."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.step = value, rate, 0
        self.mean, self.square = np.zeros_like(value), np.zeros_like(value)

    def down(self, gradient: np.ndarray) -> None:
        self.step += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.01 * (gradient**2 - self.square)
        self.value -= self.rate * (self.mean / (1 - 0.9**self.step)) / (np.sqrt(self.square / (1 - 0.99**self.step)) + 1e-8)


def fit(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, rate: float = 0.03, ridge: float = RIDGE) -> Model:
    """Train vectors and softmax on all texts at once, pass by pass; nothing is drawn but the first vectors, from a seed."""
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    prior = float(np.log(share / (1 - share)))
    sample = Sample(texts, toxic) if 0 < toxic.sum() < len(toxic) else None
    if sample is None or not sample.listed:
        return Model(prior, {})
    draw = np.random.default_rng(7)
    vectors = Adam(draw.normal(0, 0.01, (len(sample.listed), DIMENSIONS)), rate)
    softmax = Adam(draw.normal(0, 1, (2, DIMENSIONS)), rate)
    base = Adam(np.array([0.0, prior]), rate)
    for _ in range(epochs):
        difference = softmax.value[1] - softmax.value[0]
        value = vectors.value @ difference * SCALE
        of_word = np.bincount(sample.of_word, value[sample.subword] * sample.weight, sample.n_words)
        logit = np.bincount(sample.text, of_word[sample.word] * sample.share, sample.n) + base.value[1] - base.value[0]
        slope = (1 / (1 + np.exp(-logit)) - toxic) / len(toxic)
        by_word = np.bincount(sample.word, slope[sample.text] * sample.share, sample.n_words)
        by_subword = np.bincount(sample.subword, by_word[sample.of_word] * sample.weight, len(sample.listed)) * SCALE
        pull = by_subword @ vectors.value
        vectors.down(by_subword[:, None] * difference[None, :] + ridge * vectors.value)
        softmax.down(np.stack([-pull, pull]) + ridge * softmax.value)
        base.down(np.array([-slope.sum(), slope.sum()]))
    value = vectors.value @ (softmax.value[1] - softmax.value[0]) * SCALE
    return Model(float(base.value[1] - base.value[0]), dict(zip(sample.listed, value.tolist())))


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the bounded sample; docs: doc_id, text."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # the sample has a fixed bound
    rows = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    rows = cut(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("place", F.xxhash64("text")))
    sizes = rows.select("place", F.octet_length("text").alias("n")).orderBy("place").limit(SAMPLE_ROWS).toPandas()
    if not len(sizes):
        return Model(0.0, {})
    fits = np.flatnonzero(sizes["n"].cumsum().to_numpy() <= SAMPLE_BYTES)
    last = int(sizes["place"].iloc[fits[-1] if len(fits) else 0])
    chosen = rows.where(F.col("place") <= last).repartition(1).sortWithinPartitions("place", "text")

    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch["text"].to_pylist()
            toxic += batch["toxic"].to_pylist()
        if texts:
            model = fit(texts, (np.array(toxic) > 0).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([None, *model.values]), pa.array([model.prior, *model.values.values()])], names=["subword", "value"])

    found = dict(zip(*chosen.mapInArrow(train, "subword string, value double").toArrow().to_pydict().values()))  # SUBWORDS rows at most
    return Model(found.pop(None), found)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns, score, predicted."""
    docs = without(docs, ("score", "predicted"))
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = np.array([sent.value.score(t) for t in batch["text"].to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_model(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op12_toxicity": op12_toxicity}
ORACLES: dict[str, str] = {}
