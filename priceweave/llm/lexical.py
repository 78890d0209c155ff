"""Exact ranked lexical search by hierarchical max trees.

Each task cuts its documents into ranges. For a range and a term the tree holds, on level 0, what the term adds to the
score of each document that holds it, and on each higher level the greatest such value under a node of FANOUT nodes
below. A query's bound at a node is the sum of its terms' values there; best-first descent opens the node of the highest
bound until that is under the query's k-th best score so far, which a task carries from range to range. Nodes whose bound
equals that score are opened too, so ties are decided by their ids. What is found on level 0 is an exact score.

Two passes over the texts, in blocks of items with a bounded number of terms: sums (documents, terms, documents that hold
each term of the block), then trees and search. Nothing of the texts is shuffled: a task gives counts per term in the
first pass and k rows an item in the second; these meet in two steps, so no task takes the rows of all tasks for an item.

Defined results
- null text: no terms; texts and items without terms find nothing and count as no document. Null ids, of documents or
  items, take no part and count nowhere. Items of one id are one item with the terms of all its rows.
- rows of one doc_id are documents of their own; ties go to the smaller doc_id. Only scores above 0 are returned.
- texts of any length are read whole, PIECE bytes at a time. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, slices

#: Terms of a block of items: what a search knows at a time. An item of more terms is a block alone.
BLOCK_TERMS = 20_000
#: Documents and postings of a range at most (a document's postings stay together).
RANGE_DOCS, RANGE_POSTINGS = 1 << 14, 1 << 20
#: Nodes under a node are 2^SHIFT; the top level has TOP nodes at most.
SHIFT, TOP = 4, 64
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 22
#: Groups of tasks whose best rows meet before all meet.
GROUPS = 256

_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def term_counts(text: str | None) -> tuple[int, Counter]:
    """(number of terms, how often each occurs); A-Z count as a-z, other letters as they are."""
    raw = (text or "").encode()
    found: Counter = Counter()
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > PIECE:
            gap = _GAP.search(raw, at + PIECE)
            end = gap.start() if gap else end
        found.update(_TERM.findall(raw[at:end].lower()))
        at = end
    return sum(found.values()), found


def blocks_of(items: DataFrame, terms: int = BLOCK_TERMS) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items and their sorted terms, in blocks of few different terms; the driver holds a block at a time."""
    block: list[tuple[int, list[bytes]]] = []
    known: set[bytes] = set()
    last, held = None, set()

    def closed() -> Iterator[list[tuple[int, list[bytes]]]]:
        nonlocal block, known
        if last is not None and held:
            if block and len(known | held) > terms:
                yield block
                block, known = [], set()
            block.append((last, sorted(held)))
            known |= held

    rows = items.where(F.col("item_id").isNotNull()).select("item_id", "text").orderBy("item_id")
    for row in rows.toLocalIterator():
        if row["item_id"] != last:
            yield from closed()
            last, held = row["item_id"], set()
        held |= term_counts(row["text"])[1].keys()
    yield from closed()
    if block:
        yield block


def statistics(docs: DataFrame, known: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """(documents with terms, all terms with repeats, documents that hold each known term)."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        held = np.zeros(len(place) + 2, np.int64)
        for batch in slices(batches):
            for text in batch["text"].to_pylist():
                n, found = term_counts(text)
                if n:
                    held[-2] += 1
                    held[-1] += n
                    for t in found.keys() & place.keys():
                        held[place[t]] += 1
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], names=["term", "n"])

    out = np.zeros(len(known) + 2, np.int64)
    summed = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # a row for each term of a block
        out[row["term"]] = row["n"]
    return int(out[-2]), int(out[-1]), out[:-2]


class MaxTrees:
    """The trees of one range: on each level the keys term * nodes + node in order, and their values."""

    def __init__(self, docs: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.levels = []
        nodes = max(docs, 1)
        while True:
            key = term * nodes + doc
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            key, value = key[first], np.maximum.reduceat(value, first) if len(first) else value
            self.levels.append((nodes, key, value))
            if nodes <= TOP:
                break
            term, doc = key // nodes, (key % nodes) >> SHIFT
            nodes = (nodes + (1 << SHIFT) - 1) >> SHIFT

    def sums(self, level: int, terms: np.ndarray, begin: int, end: int) -> np.ndarray:
        """The summed values of the terms at nodes begin to end of a level."""
        nodes, key, value = self.levels[level]
        base = terms * nodes
        s, e = np.searchsorted(key, base + begin), np.searchsorted(key, base + end)
        n = e - s
        total = int(n.sum())
        out = np.zeros(end - begin, np.int64)
        if total:
            at = np.repeat(s - np.cumsum(n) + n, n) + np.arange(total)
            np.add.at(out, key[at] - np.repeat(base + begin, n), value[at])
        return out

    def search(self, terms: np.ndarray, ids: np.ndarray, k: int, best: list[tuple[int, int]]) -> int:
        """Put the range's members of the k best into best, a heap of (score, -id); returns how many nodes it opened."""
        top = len(self.levels) - 1
        bounds = self.sums(top, terms, 0, self.levels[top][0])
        queue = [(-int(bounds[n]), top, int(n)) for n in np.flatnonzero(bounds > 0)]
        heapq.heapify(queue)
        opened = 0
        while queue:
            bound, level, node = heapq.heappop(queue)
            if len(best) == k and -bound < best[0][0]:
                break  # no node left can hold a member
            if level == 0:
                entry = (-bound, -int(ids[node]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                continue
            opened += 1
            begin = node << SHIFT
            sums = self.sums(level - 1, terms, begin, min(begin + (1 << SHIFT), self.levels[level - 1][0]))
            least = best[0][0] if len(best) == k else 1
            for n in np.flatnonzero(sums >= max(least, 1)).tolist():
                heapq.heappush(queue, (-int(sums[n]), level - 1, begin + n))
        return opened


def _ranges(batches: Iterable[pa.RecordBatch], place: dict[bytes, int], weight: np.ndarray, n_docs: int, all_terms: int):
    """(ids, doc, term, value) of ranges of a task's documents; what a term adds to a document's score is exact."""
    ids, docs, terms, tfs, sizes = [], [], [], [], []
    for batch in slices(batches):
        for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            n, found = term_counts(text)
            there = found.keys() & place.keys()
            if not there:
                continue
            docs.append(np.full(len(there), len(ids)))
            ids.append(i)
            terms.append(np.fromiter((place[t] for t in there), np.int64, len(there)))
            tfs.append(np.fromiter((found[t] for t in there), np.int64, len(there)))
            # 100 - 50 + 50 * n * N div L, of unbounded integers
            sizes.append(50 + 50 * n * n_docs // all_terms)
            if len(ids) >= RANGE_DOCS or len(ids) % 64 == 0 and sum(map(len, terms)) >= RANGE_POSTINGS:
                yield _scored(ids, docs, terms, tfs, sizes, weight)
                ids, docs, terms, tfs, sizes = [], [], [], [], []
    if ids:
        yield _scored(ids, docs, terms, tfs, sizes, weight)


def _scored(ids, docs, terms, tfs, sizes, weight):
    doc, term, tf = np.concatenate(docs), np.concatenate(terms), np.concatenate(tfs)
    m = np.array(sizes, np.int64)
    # documents of like length side by side: their values are alike, so the maxima above them are near their sums
    order = np.argsort(m, kind="stable")
    m, doc = m[doc], np.argsort(order)[doc]
    return np.array(ids, np.int64)[order], doc, term, weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def _found(docs: DataFrame, block: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """item_id, doc_id, score, part: each task's k best documents of each item."""
    place = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    n_docs, all_terms, held = statistics(docs, place)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * h + 1))) for h in held.tolist()], np.int64)
    asked = [(i, np.array([place[t] for t in terms], np.int64)) for i, terms in block]
    sent = docs.sparkSession.sparkContext.broadcast((place, weight, asked))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weight, asked = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        for ids, doc, term, value in _ranges(batches, place, weight, n_docs, max(all_terms, 1)):
            trees = MaxTrees(len(ids), doc, term, value)
            for (_, terms), heap in zip(asked, best):
                trees.search(terms, ids, k, heap)
        rows = [(i, -d, s) for (i, _), heap in zip(asked, best) for s, d in heap]
        part = TaskContext.get().partitionId() % GROUPS
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([part] * len(rows), pa.int32())], names=["item_id", "doc_id", "score", "part"])

    return docs.mapInArrow(search, "item_id long, doc_id long, score long, part int")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents for each item. docs: doc_id, text; items: item_id, text."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks_of(items, block_terms):
        found = _found(docs, block, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc("doc_id")]
    near = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = near.drop("rank").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE item_id IS NOT NULL),
total AS (SELECT count(*) AS big_n, CAST(sum(len(ts)) AS BIGINT) AS big_l FROM d WHERE len(ts) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY t),
m AS (SELECT r, doc_id, 50 + (50 * len(ts) * big_n) // big_l AS m FROM d, total WHERE len(ts) > 0),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""

QUERIES = {"op13_lexical": op13_lexical}
ORACLES = {"op13_lexical": SQL}
