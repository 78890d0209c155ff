"""Benchmark decontamination by an FM-index over each shard of the training texts.

The words of a shard become one symbol sequence. Its suffix array gives the Burrows-Wheeler transform, kept as a wavelet
matrix; test phrases are searched backward, all at once, by wavelet ranks; rows of the matched intervals walk back to
sampled suffix positions; the occurrences' spans are merged per document.

Words that no phrase holds, and words that no phrase holds next to their neighbours, cannot lie inside an occurrence:
runs of them become one separator before the index is built. The shard is a bounded slice of one task's rows, so
nothing is shuffled, and a lost executor costs its tasks only. Phrases go to the tasks in blocks of bounded size; each
block is a further pass over the rows.

Defined results
- null or empty text: no words, no hits; null or empty items: no window, never found; null item_id: ignored.
- repeated rows and ids: each row is judged by itself; items of the same words are all reported.
- an item's window is parameter n of its words, or the whole item if it has fewer. Extra columns: kept as they are; in
  find_hits those with a result's name give way.
- empty tables: no rows, or nothing hit.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, shielded, slices, without

#: Words of a lower-cased UTF-8 text: digits, letters and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SEP, FIRST = 1, 2  # symbols: 0 closes the text, 1 separates runs, words from 2 on


class _Ids(dict):
    def __missing__(self, key):
        return 0


class Phrases:
    """Windows of the items of one block: their words' symbols, and the items that hold each."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.vocabulary: dict[bytes, int] = _Ids()
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item_id, text in items:
            words = WORD.findall((text or "").encode().lower())
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + FIRST) for w in words)
            for s in range(max(1, len(ids) - n + 1)):
                if ids[s : s + n]:
                    found[ids[s : s + n]].add(str(item_id))
        self.windows = list(found)
        self.items = [sorted(found[w]) for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        width = int(self.lengths.max(initial=0))
        # column j holds the j-th symbol from the end: backward search reads columns in order
        self.reversed = np.zeros((len(self.windows), width), np.int64)
        for i, w in enumerate(self.windows):
            self.reversed[i, : len(w)] = w[::-1]
        size = len(self.vocabulary) + FIRST
        self.size = size
        pairs = {a * size + b for w in self.windows for a, b in zip(w, w[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.alone = np.array(sorted({w[0] for w in self.windows if len(w) == 1}), np.int64)

    def useful(self, symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which words stand beside a neighbour as in some window, or are a window alone."""
        keep = np.isin(symbols, self.alone) if len(self.alone) else np.zeros(len(symbols), bool)
        if len(symbols) > 1 and len(self.pairs):
            both = (symbols[:-1] > 0) & (symbols[1:] > 0) & (doc[:-1] == doc[1:])
            at = np.flatnonzero(both)
            pair = symbols[at] * self.size + symbols[at + 1]
            slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            at = at[self.pairs[slot] == pair]
            keep[at] = True
            keep[at + 1] = True
        return keep


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """By prefix doubling. Separators differ from each other, in text order, so a comparison ends at the run's end."""
    n = len(text)
    rank = text + n
    ends = np.flatnonzero(text < FIRST)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    rank = _ranks(rank[order], order)
    h = 1
    while True:
        # only suffixes whose rank is shared still need their place
        count = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(count[rank] > 1)
        if not len(open_):
            return np.argsort(rank, kind="stable")
        follow = np.where(open_ + h < n, rank[np.minimum(open_ + h, n - 1)], -1)
        key = rank[open_] * np.int64(n + 1) + follow + 1
        order = np.argsort(key, kind="stable")
        sorted_key, at = key[order], open_[order]
        new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        base = rank[at]
        first = np.maximum.accumulate(np.where(np.r_[True, base[1:] != base[:-1]], np.arange(len(at)), 0))
        place = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank[at] = base + place - first
        h *= 2


def _ranks(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    first = np.maximum.accumulate(np.where(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]], np.arange(len(order)), 0))
    rank = np.empty(len(order), np.int64)
    rank[order] = first
    return rank


class WaveletMatrix:
    """Rank and access over a sequence of symbols, for whole arrays of questions at once."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = ((values >> b) & 1).astype(bool)
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(at), at.copy()
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, bit = self.ones[k], ((symbol >> b) & 1).astype(bool)
            l1, h1 = ones[low], ones[high]
            low = np.where(bit, self.zeros[k] + l1, low - l1)
            high = np.where(bit, self.zeros[k] + h1, high - h1)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, its rank before the position) at each position."""
        symbol, low, pos = np.zeros_like(at), np.zeros_like(at), at.copy()
        for k in range(self.bits):
            ones = self.ones[k]
            o, l1 = ones[pos].astype(np.int64), ones[low].astype(np.int64)
            bit = (ones[pos + 1] - o).astype(bool)
            symbol = symbol * 2 + bit
            pos = np.where(bit, self.zeros[k] + o, pos - o)
            low = np.where(bit, self.zeros[k] + l1, low - l1)
        return symbol, pos - low


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        """text: symbols, closed by 0; runs are closed by SEP. Positions after a separator are sampled too, so that a
        walk never crosses one (separators are told apart by position only)."""
        sa = suffix_array(text, symbols)
        bwt = text[sa - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))]
        self.wavelet = WaveletMatrix(bwt, symbols)
        kept = (sa % sample == 0) | (bwt < FIRST)
        self.sampled = np.r_[0, np.cumsum(kept)]
        self.positions = sa[kept]
        self.length = len(text)

    def search(self, reversed_: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of rows of each phrase, all phrases a symbol a step."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.length, np.int64)
        for j in range(reversed_.shape[1]):
            live = np.flatnonzero((lengths > j) & (low < high))
            if not len(live):
                break
            c = reversed_[live, j]
            both = self.wavelet.rank(np.r_[c, c], np.r_[low[live], high[live]])
            low[live], high[live] = self.first[c] + both[: len(live)], self.first[c] + both[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.full(len(rows), -1, np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            known = self.sampled[rows + 1] > self.sampled[rows]
            out[todo[known]] = self.positions[self.sampled[rows[known]]] + steps
            todo, rows = todo[~known], rows[~known]
            symbol, rank = self.wavelet.access(rows)
            rows = self.first[symbol] + rank
            steps += 1
        return out


def occurrences(phrases: Phrases, symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, word position) of every occurrence in a shard. symbols: 0 for words out of the vocabulary."""
    none = np.zeros(0, np.int64)
    keep = np.flatnonzero(phrases.useful(symbols, doc))
    if not len(keep):
        return none, none
    cut = np.r_[True, (np.diff(keep) > 1) | (doc[keep[1:]] != doc[keep[:-1]])]
    # a separator before each run but the first, and the closing symbol
    place = np.arange(len(keep)) + np.cumsum(cut) - 1
    text = np.full(place[-1] + 2, SEP, np.int64)
    text[place] = symbols[keep]
    text[-1] = 0
    source = np.zeros(len(text), np.int64)
    source[place] = keep
    index = FMIndex(text, phrases.size)
    low, high = index.search(phrases.reversed, phrases.lengths)
    found = np.flatnonzero(low < high)
    n = high[found] - low[found]
    window = np.repeat(found, n)
    rows = np.repeat(low[found], n) + np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    return window, source[index.locate(rows)]


def _scan(phrases: Phrases, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[str], list[bytes] | None]]:
    """(words, merged word spans, items) of each text of a shard."""
    get = phrases.vocabulary.__getitem__
    counts, parts = [], []
    for text in texts:
        ids = np.fromiter(map(get, WORD.findall(text.lower())), np.int64)
        counts.append(len(ids))
        parts.append(ids)
    symbols = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    starts = np.r_[0, np.cumsum(counts)].astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    window, at = occurrences(phrases, symbols, doc)
    of = doc[at] if len(at) else at
    order = np.lexsort((at, of))
    window, at, of = window[order], at[order], of[order]
    edges = np.searchsorted(of, np.arange(len(counts) + 1))
    for i, n in enumerate(counts):
        s, e = edges[i], edges[i + 1]
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if s < e:
            for w in np.unique(window[s:e]):
                items.update(phrases.items[w])
            begin = at[s:e] - starts[i]
            end = np.maximum.accumulate(begin + phrases.lengths[window[s:e]])
            first = np.r_[True, begin[1:] > end[:-1]]
            spans = list(zip(begin[first].tolist(), end[np.r_[np.flatnonzero(first)[1:] - 1, len(end) - 1]].tolist()))
        yield n, spans, sorted(items)


HITS = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
    """(is the last, items) of blocks of about block_bytes of text; one block at a time is on the driver."""
    items = benchmark.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        yield b == n - 1, [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, shard_bytes: int = 4 << 20, block_bytes: int = 16 << 20, clean: bool = False) -> DataFrame:
    """docs' columns (text among them) and HITS: word spans inside occurrences, merged, and items found; with clean,
    docs' columns only and the spans cut out of the texts."""
    docs = without(docs, ("n_words", "spans", "items"))
    out, names = docs, docs.columns
    for k, (last, block) in enumerate(blocks_of(benchmark, block_bytes)):
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(block, n))
        schema = docs.schema if clean and last else T.StructType([*docs.schema.fields, *T._parse_datatype_string(HITS).fields])

        def scan(batches: Iterable[pa.RecordBatch], phrases=phrases, k=k, cut_out=clean and last) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 20_000, shard_bytes):
                texts = [(t or "").encode() for t in batch["text"].to_pylist()]
                words, spans, items = [], [], []
                for i, (n_words, s, found) in enumerate(_scan(phrases.value, texts)):
                    if k:  # what earlier blocks have found
                        s = _merge(s + [(x["start"], x["end"]) for x in batch["spans"][i].as_py()])
                        found = sorted({*found, *batch["items"][i].as_py()})
                    words.append(n_words)
                    spans.append([{"start": a, "end": b} for a, b in s])
                    items.append(found)
                kept = [batch[c] for c in names]
                if cut_out:
                    yield pa.RecordBatch.from_arrays(_cleaned(kept, names.index("text"), spans), names=names)
                    continue
                types = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, t) for v, t in zip((words, spans, items), types))], names=[*names, "n_words", "spans", "items"])

        out = out.mapInArrow(scan, schema)
    return out


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    raw = text.encode()
    words = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : words[s][0]])
        at = words[e - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode()


def _cleaned(columns: list[pa.Array], at: int, spans: list[list[dict]]) -> list[pa.Array]:
    """The columns, the texts (in column at) without their spans."""
    hit = [i for i, s in enumerate(spans) if s]
    if hit:
        texts = columns[at].to_pylist()
        for i in hit:
            texts[i] = remove_spans(texts[i], [(s["start"], s["end"]) for s in spans[i]])
        columns[at] = pa.array(texts, columns[at].type)
    return columns


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs with the contaminated spans cut out of the texts; no row goes."""
    docs, back = shielded(docs, ("n_words", "spans", "items"))
    return find_hits(docs, benchmark, clean=True, **parameters).select(*back)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_hits(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS g FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) WHERE len(ws) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(ws) - n + 2)) t(i)),
found AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found), unnest(range(i, i + n)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {"op1_decontaminate": SQL}
