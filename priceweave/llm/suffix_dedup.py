"""Removal of byte strings that occur before, by a column-wise multi-document Burrows-Wheeler construction.

A string of `length` bytes that also starts earlier in the collection is removed wherever it starts later. Its place
is told by content alone: each window of that length has its smallest hashed k-gram, the leftmost one, as its anchor,
and windows of one anchor make a segment, so equal windows lie in segments of equal anchors. Anchors that occur once
in the collection end here. Equal segments are one string of the collection, with its first place; what segments of
different text and equal anchor share is found by the construction: a collection of bounded size grows by one symbol
for each string a round, from the last to the first, and each round merges the new suffixes into the transform, and
their common prefixes with their neighbours into that list, in one sequential pass over what was there; common prefixes
follow from those of the round before. Rows whose common prefix reaches `length` are equal windows; the first of each
such run stays.

Anchors with very many different segments are dealt into several collections; the runs' first windows then meet, by
their bytes, in a grouped minimum.

Defined results
- null or empty text: no bytes, nothing removed. Texts under `length` bytes: nothing removed.
- order is (doc_id, start); null ids come first, told apart and ordered by 60 bits of a hash of their texts (ids under
  NULL_ID + NULL_TEXTS stand among them). Different texts of one id, 2^22 at most, follow each other by a hash as parts of
  one document. Rows of one id and text are one place, so none removes the other.
- empty tables: no rows. Extra columns are ignored. Segments of one anchor are told apart by 64-bit hashes under a key
  that each run draws; anchors may share a hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, read, slices, table, utf8
from .hashing import Rolling, draw, mix, span_hashes

LENGTH, GRAM = 100, 32
#: Windows that are looked at together.
PIECE = 1 << 21
#: Strings that a collection is closed at, and different segments of an anchor that one may hold: beyond, the anchor is
#: dealt into several. The second is a bound of memory, some 200 MB at these lengths.
COLLECTION, WIDE = 1024, 32_768
#: Anchors, segments and documents up to which a sorted list of them is sent to every task; beyond, a shuffle joins them.
BROADCAST_ROWS = 3_000_000
#: Low bits of a segment's place that hold its number of windows; the rest is its start.
PLACE_BITS = 10
NULL_ID = -(1 << 63)
#: Keys that texts without an id have, from NULL_ID on.
NULL_TEXTS = 1 << 60
#: Bits of a start in its text; those above number the different texts of one id.
START_BITS = 31


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row, by blocks of w."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


class Segments:
    """The segments of some texts: text, start (in the text), windows, anchor (hash of the k-gram), content (hash).

    Long texts are taken in pieces of PIECE windows; a segment that a piece's end cuts is two segments of its anchor."""

    def __init__(self, column: pa.Array, length: int = LENGTH, gram: int = GRAM, key: int = 0):
        raw, offsets = utf8(column)
        found = []
        for low in range(0, max(len(raw) - length + 1, 0), PIECE):
            high = min(low + PIECE + length - 1, len(raw))
            first, last = np.searchsorted(offsets, low, side="right") - 1, np.searchsorted(offsets, high)
            found.append(self._of(raw[low:high], np.clip(offsets[first : last + 1] - low, 0, high - low), length, gram, key))
            text, start = found[-1][:2]
            text += first
            start += np.maximum(low - offsets[text], 0)
        columns = zip(*found) if found else [[np.zeros(0, np.int64)]] * 5
        self.text, self.start, self.windows, self.anchor, self.content = (np.concatenate(c) for c in columns)

    @staticmethod
    def _of(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int, key: int) -> list[np.ndarray]:
        counts = np.maximum(np.diff(offsets) - length + 1, 0)
        if not counts.any():
            return [np.zeros(0, np.int64) for _ in range(5)]
        rolling = Rolling(raw)
        grams = mix(rolling.windows(gram))
        bits = np.uint64(int(PIECE + length).bit_length())
        # the leftmost of the smallest: the place is part of what is compared
        packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_minimum(packed, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        text = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        window = offsets[text] + place
        anchor = at[window]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        windows = np.diff(np.r_[first, len(text)])
        begin = window[first]
        content = span_hashes(raw, begin, begin + windows + length - 1, key)[0]
        return [text[first], place[first], windows, grams[anchor[first]].view(np.int64), content.view(np.int64)]


class Collection:
    """The transform of a growing collection of strings and the common prefixes of its neighbouring suffixes.

    Rows are suffixes in order. A row is one number of three fields: symbol (the byte before the suffix, 0 before a whole
    string), common (the length of its common prefix with the row before, counted up to a limit) and code (its string
    and size)."""

    SYMBOL, COMMON, CODE = 0, 1, 1  # places of the fields in views of 16, 16 and 32 bits

    def __init__(self, strings: list[bytes], limit: int):
        self.limit = limit
        self.sizes = np.array([len(s) for s in strings], np.int64)
        flat = np.frombuffer(b"".join(strings), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        codes = np.unique(flat)
        table = np.zeros(256, np.uint64)
        table[codes] = np.arange(1, len(codes) + 1)
        self.flat = table[flat]
        self.narrow = np.uint8 if len(codes) < 256 else np.uint16
        self.step = int(self.sizes.max(initial=0)) + 1
        if limit >= 1 << 16 or len(strings) * self.step >= 1 << 32:
            raise ValueError("a collection of too many or too long strings")

    def build(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, size, common) of all rows.

        A round puts one symbol before the newest suffix of each string that is not used up, and rewrites the list in one
        pass. After it, the rows behind the empty suffixes are, in order, the symbols of the transform before it, sorted:
        rows of one symbol follow in the order of the suffixes behind it. So a new row's common prefix with its neighbour
        of the same symbol is one more than the least common prefix between the two suffixes behind them."""
        n = len(self.sizes)
        ends = self.starts + self.sizes
        first = np.where(self.sizes > 0, self.flat[np.maximum(ends - 1, 0)] if len(self.flat) else 0, 0).astype(np.uint64)
        rows = first | (np.arange(n, dtype=np.uint64) * np.uint64(self.step)) << np.uint64(32)
        newest = self.sizes > 0  # the rows of the strings' newest suffixes
        for round_ in range(1, self.step):
            fields = rows.view(np.uint16)
            symbol, common = fields[self.SYMBOL :: 4].astype(self.narrow), fields[self.COMMON :: 4]
            # the places of all symbols, by symbol and place: a sort of small numbers, linear in the rows
            order = np.argsort(symbol, kind="stable")
            order = order[len(symbol) - np.count_nonzero(symbol) :]
            at = np.flatnonzero(newest[order])
            owner = (rows[order[at]] >> np.uint64(32)).astype(np.int64) // self.step
            # what is compared anew: each new row with the one before it, and the one after it with it
            changed = np.unique(np.concatenate([at, at[at + 1 < len(order)] + 1]))
            fresh = self._common(symbol, common, order, changed)
            row = n + at
            going = self.sizes[owner] > round_
            before = np.where(going, self.flat[np.maximum(ends[owner] - round_ - 1, 0)], np.uint64(0))
            made = before | (owner * self.step + round_).astype(np.uint64) << np.uint64(32)
            old = np.ones(len(rows) + len(row), bool)
            old[row] = False
            merged = np.empty(len(old), np.uint64)
            merged[old], merged[row] = rows, made
            merged.view(np.uint16)[self.COMMON :: 4][n + changed] = fresh
            newest = np.zeros(len(old), bool)
            newest[row[going]] = True
            rows = merged
        string, size = np.divmod((rows >> np.uint64(32)).astype(np.int64), self.step)
        return string, size, rows.view(np.uint16)[self.COMMON :: 4].astype(np.int64)

    def _common(self, symbol: np.ndarray, common: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The common prefixes of the rows of these ranks with the rows before them."""
        out = np.zeros(len(rank), np.uint16)
        # a row's suffix behind its symbol stands at order[rank], its neighbour's at the place of the same symbol before
        high = order[rank]
        low = order[np.maximum(rank - 1, 0)]
        have = np.flatnonzero((symbol[low] == symbol[high]) & (rank > 0))
        if len(have):
            # by place, so that next to nothing but what lies between two places is looked at
            have = have[np.argsort(low[have])]
            bounds = np.stack([low[have] + 1, high[have] + 1], axis=1).ravel()
            least = np.minimum.reduceat(np.append(common, np.uint16(0)), bounds)[::2]
            out[have] = np.minimum(least + np.uint16(1), self.limit)
        return out


def repeated_windows(strings: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of all windows of the strings, each at doc, start + its place: (doc, start, string, is the first of its text)."""
    c = Collection(strings, length)
    string, size, common = c.build()
    rows = np.flatnonzero(size >= length)
    string, size, common = string[rows], size[rows].astype(np.int64), common[rows]
    # suffixes that reach the limit stand together, as no shorter one can come between them
    group = np.cumsum(common < length) - 1
    place = start[string] + c.sizes[string] - size
    of = doc[string]
    order = np.lexsort((place, of, group))
    first = np.zeros(len(group), bool)
    if len(group):
        first[order[np.r_[True, group[order][1:] != group[order][:-1]]]] = True
    return of, place, string, first


def _runs(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of windows at these places, windows in a row as one."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else np.zeros(0, np.int64)
    tail = np.r_[head[1:] - 1, len(doc) - 1] if len(doc) else head
    return doc[head], start[head], start[tail] + length


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _member(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, start, end (bytes) of what goes; spans can touch or overlap. docs: doc, number (of the text), text; starts and
    ends have the number in their high bits."""
    if not gram <= length <= gram + (1 << PLACE_BITS) - 2:
        raise ValueError("length must be from gram to gram + 1022")
    context, key = docs.sparkSession.sparkContext, draw()

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000, SLICE_BYTES):
            s = Segments(batch["text"], length, gram, key)
            if not len(s.anchor):
                continue
            # one row for each anchor and text of this slice
            order = np.lexsort((s.content, s.anchor))
            anchor, content = s.anchor[order], s.content[order]
            head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
            yield _batch("anchor content n", anchor[head], content[head], np.diff(np.r_[head, len(anchor)]))

    counted = docs.mapInArrow(anchors, "anchor long, content long, n long").groupBy("anchor").agg(F.sum("n").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    repeated = cut(counted.where(F.col("n") > 1).select("anchor", (F.col("low") != F.col("high")).alias("mixed")))
    few = repeated.count() <= BROADCAST_ROWS
    sent = context.broadcast(np.sort(repeated.select("anchor").toArrow()["anchor"].to_numpy())) if few else None  # a checked number

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000, SLICE_BYTES):
            s = Segments(batch["text"], length, gram, key)
            keep = np.flatnonzero(_member(sent.value, s.anchor)) if sent is not None else np.arange(len(s.anchor))
            doc = batch["doc"].to_numpy()[s.text[keep]]
            begin = batch["number"].to_numpy()[s.text[keep]] << START_BITS | s.start[keep]
            yield _batch("anchor content doc place", s.anchor[keep], s.content[keep], doc, begin << PLACE_BITS | s.windows[keep])

    found = docs.mapInArrow(segments, "anchor long, content long, doc long, place long")
    found = table(found if few else found.join(repeated.select("anchor"), "anchor"))
    firsts = cut(found.groupBy("anchor", "content").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n")))
    start, windows = lambda c: F.shiftright(c, PLACE_BITS), lambda c: c.bitwiseAND((1 << PLACE_BITS) - 1)

    # later copies of equal segments
    copies = found.join(firsts.where(F.col("n") > 1).select("anchor", "content", "first"), ["anchor", "content"]).where((F.col("doc") != F.col("first.doc")) | (F.col("place") != F.col("first.place")))
    copies = copies.select("doc", start(F.col("place")).alias("start"), (start(F.col("place")) + windows(F.col("place")) + (length - 1)).alias("end"))

    # the collections: different segments of equal anchors
    mixed = firsts.join(repeated.where("mixed").select("anchor"), "anchor").select("anchor", F.col("first.doc").alias("doc"), start(F.col("first.place")).alias("start"), windows(F.col("first.place")).alias("windows"))
    spread = mixed.groupBy("anchor").agg(F.count("*").alias("strings"))
    mixed = mixed.join(spread, "anchor").withColumn("deal", F.when(F.col("strings") > WIDE, F.pmod(F.xxhash64("doc", "start"), F.ceil(F.col("strings") / COLLECTION))).otherwise(F.lit(0)))
    mixed = cut(mixed.select("anchor", "deal", (F.col("strings") > WIDE).alias("wide"), "doc", "start", "windows"))
    strings = _strings(docs, mixed, length).repartition(F.col("anchor"), F.col("deal")).sortWithinPartitions("anchor", "deal")

    def construct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def collection():
            doc, start = (np.array([h[k] for h in held], np.int64) for k in (3, 4))
            of, place, string, first = repeated_windows([h[5] for h in held], doc, start, length)
            d, s, e = _runs(of[~first], place[~first], length)
            yield _batch("doc start end window", d, s, e, pa.nulls(len(d), pa.binary()))
            # the first windows of anchors with several collections meet those of the others
            keep = np.flatnonzero(first & np.array([h[2] for h in held])[string])
            if len(keep):
                at = place[keep] - start[string[keep]]
                bytes_ = [held[k][5][p : p + length] for k, p in zip(string[keep].tolist(), at.tolist())]
                yield _batch("doc start end window", of[keep], place[keep], np.full(len(keep), -1, np.int64), pa.array(bytes_, pa.binary()))

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("anchor", "deal", "wide", "doc", "start", "bytes"))):
                if len(held) >= COLLECTION and row[:2] != held[-1][:2] or len(held) >= 2 * WIDE:
                    yield from collection()
                    held = []
                held.append(row)
        if held:
            yield from collection()

    built = cut(strings.mapInArrow(construct, "doc long, start long, end long, window binary"))
    wide = built.where(F.col("end") == -1)
    least = wide.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    later = wide.join(least.select("window", "first"), "window").where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    later = later.select("doc", "start", (F.col("start") + length).alias("end"))
    return copies.unionByName(built.where(F.col("end") != -1).select("doc", "start", "end")).unionByName(later)


def _strings(docs: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """mixed with the bytes of each segment."""
    schema = "anchor long, deal long, wide boolean, doc long, start long, bytes binary"

    def rows(texts, doc_rows, anchor, deal, wide, doc, start, windows):
        parts = [texts[r][s : s + w + length - 1] for r, s, w in zip(doc_rows, (start & ((1 << START_BITS) - 1)).tolist(), windows.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(deal.astype(np.int64)), pa.array(wide), pa.array(doc), pa.array(start.astype(np.int64)), pa.array(parts, pa.binary())], names=["anchor", "deal", "wide", "doc", "start", "bytes"])

    if mixed.count() <= BROADCAST_ROWS:
        rows_ = mixed.toArrow()  # a checked number
        order = np.argsort(rows_["doc"].to_numpy(), kind="stable")
        kinds = {"anchor": np.int64, "deal": np.int32, "wide": bool, "doc": np.int64, "start": np.int64, "windows": np.int16}
        sent = docs.sparkSession.sparkContext.broadcast([rows_[c].to_numpy()[order].astype(k) for c, k in kinds.items()])
        del rows_

        def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns = sent.value
            for batch in slices(batches, 4000, SLICE_BYTES):
                doc = batch["doc"].to_numpy()
                low, high = np.searchsorted(columns[3], doc), np.searchsorted(columns[3], doc, side="right")
                hit = np.flatnonzero(low < high)
                if len(hit):
                    texts = {int(i): (batch["text"][int(i)].as_py() or "").encode() for i in hit}
                    of = np.repeat(hit, (high - low)[hit])
                    at = np.concatenate([np.arange(low[i], high[i]) for i in hit])
                    right = columns[4][at] >> START_BITS == batch["number"].to_numpy()[of]
                    of, at = of[right], at[right]
                    yield rows(texts, of.tolist(), *(c[at] for c in columns))

        return docs.mapInArrow(pick, schema)

    number = F.shiftright("start", START_BITS).alias("number")
    joined = docs.join(mixed.groupBy("doc", number).agg(F.collect_list(F.struct("anchor", "deal", "wide", "start", "windows")).alias("found")), ["doc", "number"])
    piece = F.expr(f"substring(encode(text, 'UTF-8'), int(x.start % {1 << START_BITS} + 1), int(x.windows + {length - 1}))")
    return joined.select("doc", "text", F.explode("found").alias("x")).select("x.anchor", "x.deal", "x.wide", "doc", "x.start", piece.alias("bytes"))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, doc, text) with a number for each different text of a doc, by a hash; 0 where there is one."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = docs.select("doc", mark.alias("mark"))
    several = marked.groupBy("doc").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where(F.col("low") != F.col("high")).select("doc")
    several = cut(several)
    many = several.count()
    if not many:
        return docs.withColumn("number", F.lit(0).cast("long"))
    # only ids of several texts, and no texts
    named = marked.join(F.broadcast(several) if many <= BROADCAST_ROWS // 10 else several, "doc").distinct()
    number = F.row_number().over(Window.partitionBy("doc").orderBy("mark")).cast("long") - 1
    number = F.when(number < 1 << 22, number).otherwise(F.raise_error(F.lit("an id has over 2^22 different texts")).cast("long"))
    named = cut(named.select("doc", "mark", number.alias("number")))
    if named.count() <= BROADCAST_ROWS // 10:
        named = F.broadcast(named)
    return docs.withColumn("mark", mark).join(named, ["doc", "mark"], "left").select("doc_id", "doc", "text", F.coalesce("number", F.lit(0)).cast("long").alias("number"))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, removed (array of merged spans, bytes), kept (binary) of each row of docs."""
    unnamed = F.lit(NULL_ID) + F.pmod(F.xxhash64("text"), F.lit(NULL_TEXTS))
    docs = _numbered(docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("doc"), "text"))
    spans = removed_spans(docs.select("doc", "number", "text"), length, gram)
    base = F.col("start") - F.col("start") % (1 << START_BITS)
    local = F.struct((F.col("start") - base).alias("start"), (F.col("end") - base).alias("end"))
    per_doc = cut(spans.groupBy("doc", F.shiftright("start", START_BITS).alias("number")).agg(F.array_sort(F.collect_set(local)).alias("spans")))
    names = "doc_id n_bytes removed kept".split()
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def keep(batches: Iterable[pa.RecordBatch], ids=None, hit: bool = True) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000, 4 << 20):
            if ids is not None:
                there = _member(ids.value, batch["doc"].to_numpy())
                batch = batch.filter(pa.array(there == hit))
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            spans = batch["spans"].to_pylist() if "spans" in batch.schema.names else [None] * len(texts)
            removed, kept = [], []
            for t, s in zip(texts, spans):
                merged: list[dict] = []
                for x in s or ():
                    if merged and x["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], x["end"])
                    else:
                        merged.append(dict(x))
                out, at = [], 0
                for x in merged:
                    out.append(t[at : x["start"]])
                    at = x["end"]
                out.append(t[at:])
                removed.append(merged)
                kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, span_type), pa.array(kept, pa.binary())], names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    if per_doc.count() <= BROADCAST_ROWS:
        # only documents that lose something are shuffled
        ids = docs.sparkSession.sparkContext.broadcast(np.sort(per_doc.select("doc").toArrow()["doc"].to_numpy()))

        def chosen(batches):
            for batch in batches:
                yield batch.filter(pa.array(_member(ids.value, batch["doc"].to_numpy())))

        hit = docs.mapInArrow(chosen, docs.schema).join(per_doc, ["doc", "number"], "left").mapInArrow(keep, schema)
        return hit.unionByName(docs.mapInArrow(lambda b: keep(b, ids, False), schema))
    return docs.join(per_doc, ["doc", "number"], "left").mapInArrow(keep, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM h, unnest(range(0, n - 99)) t(p) WHERE n >= 100),
f AS (SELECT s, min({'d': doc_id, 'p': p}) AS first FROM w GROUP BY s HAVING count(*) > 1),
later AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE w.doc_id <> f.first.d OR w.p <> f.first.p),
marked AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS head FROM later),
runs AS (SELECT doc_id, p, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, run, min(p) AS s, max(p) + 100 AS e FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, run AS k, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY run), 0) AS s, s AS e FROM spans
  UNION ALL SELECT h.doc_id, 1000000000, coalesce(max(x.e), 0), h.n FROM h LEFT JOIN spans x USING (doc_id) GROUP BY h.doc_id, h.n),
kept AS (SELECT doc_id, string_agg(substr(h.h, 2 * g.s + 1, 2 * (g.e - g.s)), '' ORDER BY k) AS kept FROM gaps g JOIN h USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT h.doc_id, CAST(h.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM h JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES = {"op2_suffix_dedup": SQL}
