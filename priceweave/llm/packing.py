"""Packing of token sequences by non-negative least squares over length combinations.

A document's ids are cut at multiples of the window, so only what is left over needs company. The histogram of lengths
(one count for each length up to the window, whatever the input's size) is all that the driver sees: it enumerates the
combinations of up to three lengths that fill a window, solves for their repeat counts by non-negative least squares,
rounds down, and packs what remains greedily, best fit first. The plan is a bounded table; pieces find their place in
it by their rank among the pieces of their length, which is computed from counts per bucket, so that a length that many
pieces share is never ranked in one task.

Defined results
- null or empty text: the closing id alone. Null doc_id: a document like any other.
- repeated rows: each is packed by itself. An empty table gives no pieces. Extra columns are ignored.
- ties: pieces of a length are ranked by doc_id, start, digest; equal pieces may take each other's place.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back, read, slices, utf8

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
VOCABULARY = "byte_bpe_50k.json"
#: Chunks of text whose ids a task keeps at most, and the code points of the longest kept.
CACHE_CHUNKS, LONGEST = 600_000, 64
#: How a byte-level vocabulary writes a space, and the end of the letters that every version of Unicode's tables has.
SPACE, LETTERS_END = "\u0120", "\u0530"
#: Pieces that one ranking group of a length has on average at most.
BUCKET_PIECES = 50_000

#: What a byte is: the start of a character that is no white space for certain; a whole one; a letter or digit; a mark that
#: ends a run of those.
START, PRINT, WORD, MARK = 1, 2, 4, 8
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] |= START | PRINT
KINDS[0xC3:0xE0] |= START
KINDS[0xE4:0xF5] |= START
KINDS[[c for c in range(0x21, 0x7F) if chr(c).isalnum()]] |= WORD
KINDS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] |= MARK

_loaded: dict = {}


def chunk_offsets(raw: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where chunks of the texts (bytes and offsets) start, and the end: only at places where the vocabulary's splitting
    pattern splits whatever else the text holds, but not at all of them. Texts that are marked as whole are one chunk.

    These are a space before a character; a mark behind a letter or digit; an end of line behind a character, and what
    follows it unless that may be white space."""
    kinds = KINDS[raw]
    start, printed, blank, line = (kinds & START) != 0, (kinds & PRINT) != 0, raw == 32, raw == 10
    cuts = np.zeros(len(raw) + 1, bool)
    cuts[: len(raw) - 1] = blank[:-1] & start[1:]
    cuts[1:-1] |= ((kinds[1:] & MARK) != 0) & ((kinds[:-1] & WORD) != 0) | line[1:] & printed[:-1]
    cuts[2:-1] |= line[1:-1] & printed[:-2] & start[2:]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    # a text's last space has no character behind it
    cuts[last[blank[last]]] = False
    for i in np.flatnonzero(whole).tolist():
        cuts[offsets[i] : offsets[i + 1]] = False
    cuts[offsets] = True
    return np.flatnonzero(cuts)


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit numbers, by a cache of the ids of chunks.

    The vocabulary's splitting pattern separates words before any merge, so ids of a text are those of its words in
    order, and chunks are whole words; texts that hold a special token go through the tokenizer whole. The cache has two
    generations: what is used again while the later one fills is kept.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer_path, self.pattern = path, pattern
        self.words = regex.compile(pattern).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.starts[[i for t, i in vocabulary.items() if t[0] == SPACE]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new chunks. Words of a space and letters are encoded as one text: each starts with its only token that
        begins with a space. Long chunks are taken by their words."""
        learnt: dict[str, bytes] = {}
        plain = [w for w in chunks if w[0] == " " and w[1:].isalpha() and (w.isascii() or max(w) < LETTERS_END)]
        for i in range(0, len(plain), 5_000):
            part = plain[i : i + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            first = np.flatnonzero(self.starts[ids])
            if len(first) == len(part) and first[0] == 0:
                data, at = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
                learnt.update(zip(part, [data[a:b] for a, b in zip(at, at[1:])]))
        rest = [w for w in chunks if w not in learnt]
        long = {w: self.words(w) for w in rest if len(w) > LONGEST and not any(s in w for s in self.special)}
        long = {w: words for w, words in long.items() if len(words) > 1}
        if long:
            words = list(set().union(*long.values()))
            get = dict(zip(words, self._of_chunks(words))).__getitem__
            learnt.update((w, b"".join(map(get, words))) for w, words in long.items())
            rest = [w for w in rest if w not in long]
        for i in range(0, len(rest), 50_000):
            part = rest[i : i + 50_000]
            learnt.update(zip(part, self._ids(part)))
        return learnt

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks."""
        ids = list(map(self.cache.get, chunks))
        again = [c for c, x in zip(chunks, ids) if x is None]
        new = {c: self.before[c] for c in again if c in self.before}
        new |= self._learn([c for c in again if c not in new])
        self.cache.update((c, x) for c, x in new.items() if len(c) <= LONGEST)
        if len(self.cache) > CACHE_CHUNKS // 2:
            self.before, self.cache = self.cache, {}
        return [new[c] if x is None else x for c, x in zip(chunks, ids)]

    def forget(self) -> None:
        self.cache, self.before = {}, {}

    def encode_column(self, column: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The ids of all texts of an Arrow column (null: empty), and the bytes where each text's start, with the end."""
        raw, offsets = utf8(column)
        whole = np.zeros(len(column), bool)
        for s in self.special:
            whole |= pc.match_substring(column, s).fill_null(False).to_numpy(zero_copy_only=False)
        at = chunk_offsets(raw, offsets, whole)
        if len(at) < 2:
            return memoryview(b""), np.zeros(len(offsets), np.int64)
        chunks = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        ids = pa.array(self._of_chunks(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(chunks.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(at)]
        return memoryview(ids.buffers()[2]).cast("B"), ends[np.searchsorted(at, offsets)]

    def encode(self, texts: list[str]) -> list[bytes]:
        data, at = self.encode_column(pa.array(texts, pa.large_string()))
        return [bytes(data[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]


def encoder(path: str | None) -> Encoder:
    """The worker's encoder; path: a tokenizer file that every worker has, by default the installed vocabulary."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _loaded:
        _loaded[path] = Encoder(path, public_tokenizers.PATTERN)
    return _loaded[path]


def cut_pieces(docs: DataFrame, window: int = 1024, close: int = 0, path: str | None = None) -> DataFrame:
    """PIECES of all documents: cuts at multiples of the window."""

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path)
        end = np.array([close], "<u4").tobytes()
        for batch in slices(batches, 10_000, 8 << 20):
            data, at = ids_of.encode_column(batch["text"])
            tokens = np.diff(at) // 4 + 1
            count = -(-tokens // window)
            doc = np.repeat(np.arange(len(tokens)), count)
            start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
            length = np.minimum(tokens[doc] - start, window)
            first = at[doc] + 4 * start
            # the closing id is not among the data
            closed = start + length == tokens[doc]
            last = first + 4 * (length - closed)
            crcs = [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), last.tolist())]
            crcs = [zlib.crc32(end, x) if c else x for x, c in zip(crcs, closed.tolist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crcs, tokens[doc]))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        # workers are kept for other stages
        ids_of.forget()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def combinations(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """Pairs and triples of the lengths that fill the window exactly, longest member first."""
    there = set(lengths)
    pairs = [(a, window - a) for a in lengths if 2 * a >= window and window - a in there]
    triples = [(a, b, window - a - b) for a in lengths for b in lengths if a >= b >= window - a - b > 0 and window - a - b in there]
    return sorted(pairs, reverse=True) + sorted(triples, reverse=True)


def solve(counts: dict[int, int], combos: list[tuple[int, ...]], sweeps: int = 6) -> list[float]:
    """x >= 0 that brings the combinations' total use of each length near its count, by coordinate descent."""
    left = {k: float(v) for k, v in counts.items()}
    uses = [[(k, c.count(k)) for k in set(c)] for c in combos]
    norms = [sum(m * m for _, m in u) for u in uses]
    x = [0.0] * len(combos)
    for _ in range(sweeps):
        for j, use in enumerate(uses):
            step = 0.0
            for k, m in use:
                step += m * left[k]
            step = max(-x[j], step / norms[j])
            if step:
                x[j] += step
                for k, m in use:
                    left[k] -= m * step
    return x


def make_plan(counts: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that use each length as often as counts says."""
    left = dict(counts)
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        if times > 0:
            plan.append((pattern, times))
            for k in pattern:
                left[k] -= times

    take((window,), left.get(window, 0))
    open_ = {k: v for k, v in left.items() if k < window}
    combos = combinations(sorted(open_), window)
    x = solve(open_, combos)
    for j in sorted(range(len(combos)), key=lambda j: -x[j]):
        if x[j] < 1:
            break
        take(combos[j], min(int(x[j]), *(left[k] // combos[j].count(k) for k in combos[j])))
    there = sorted(k for k, v in left.items() if v > 0)
    while there:
        pattern, room, used = [], window, {}
        for k in reversed(there):
            while k <= room and used.get(k, 0) < left[k]:
                pattern.append(k)
                room -= k
                used[k] = used.get(k, 0) + 1
        take(tuple(pattern), min(left[k] // m for k, m in used.items()))
        there = [k for k in there if left[k] > 0]
    return plan


def pack(pieces: DataFrame, window: int = 1024) -> DataFrame:
    """pieces (all with a length up to window) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row a length
    slots, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, times in make_plan(counts, window):
        offset = 0
        for k in pattern:
            slots.append((k, taken[k], taken[k] + times, sequence, offset))
            taken[k] += times
            offset += k
        sequence += times
    plan = spark.createDataFrame(slots, "length long, low long, high long, sequence long, offset long")
    buckets = max(64, sum(counts.values()) // BUCKET_PIECES)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(per_bucket, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inside"))
    # the plan has a row for each member of each pattern: bounded by the window, not by the input
    return ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (ranked["rank"] >= plan["low"]) & (ranked["rank"] < plan["high"])).select(*[ranked[c] for c in pieces.columns], (plan["sequence"] + ranked["rank"] - plan["low"]).alias("sequence_id"), plan["offset"])


def pack_documents(docs: DataFrame, window: int = 1024, path: str | None = None) -> DataFrame:
    # ids are made once: the cut table serves the histogram, the buckets and the ranks
    return pack(cut(cut_pieces(docs, window, path=path)), window)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
