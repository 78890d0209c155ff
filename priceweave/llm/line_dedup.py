"""Line dedup by a segment-partition edit join.

Lines of min_chars code points or more whose edit distance is at most the threshold t belong to one class, and so do
chains of such lines. Of each class the first line, by doc_id and line number, stays in its document. A line is split
into t + 1 segments; a line within t edits of it holds one of them unchanged, at a place that the lengths allow. The
segments are the index, the allowed substrings of lines of the same or a slightly greater length are the probes (a
line's own segments are probes too). Entries of one key meet in two steps: first each with the key's lead, its smallest
index entry; parity signatures of the letters drop hopeless pairs and banded bit-parallel edit distance verifies the
others. Then, for keys that have several index entries, entries of different components meet, so the pairs of a group of
near copies are never listed.

A segment that many different lines share (boilerplate) would have them all meet: keys of over CROWD entries make none.
Keys of over MEET entries, as those of many near copies of one line, that share all but one word each: there t + 1 pieces
of a line that do not overlap are its index entries, the rarest ones by a table of counts, and all pieces of the others
are the probes. Any such pieces do, as t edits leave one unchanged and move it by t at most; rare ones meet few.
Lines that are crowded even there have finer keys: of t + 2 segments two are unchanged at least, of t + 3 three, so two or three segments
together are the key of the next levels, and lines that share one segment and little else no longer meet. Only what is
crowded on the last level, lines that share more than half of their text in the same places, meets as before.

Only hashes of lines and segments are shuffled for this. Equal lines are one line from the start.

Defined results
- null or empty text: no lines; kept as it is. Lines shorter than min_chars have no near ones; equal ones go from
  exact_chars on, which is 1 in the query and in clean_lines: all but empty lines.
- a document that loses lines keeps the others, joined by \\n; one that loses all has the empty text.
- repeated rows and ties: rows of one doc_id are one place, so an equal line at the same number stays in all of them;
  null ids are one place before all others. Extra columns are kept; in dedup_lines
  those with a result's name give way. Empty tables: no rows.
- lines are told apart by 128-bit hashes under a key that each run draws.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import SLICE_BYTES, cut, read, shielded, slices, table, utf8, without
from .hashing import Rolling, draw, mix, span_hashes

THRESHOLD, MIN_CHARS = 2, 20
#: Candidate lines up to which their ids are sent to every task to pick their texts; beyond, texts are joined by a shuffle.
BROADCAST_LINES = 400_000
#: Repeated lines that a task remembers, to give their entries once.
REMEMBERED = 1_000_000
#: Lines that are joined to their places apart, at most: those that hold more than this part of the repeated places.
HOT_LINES = 1000
#: Entries of a key from which its lines have finer keys instead (some hundred a line: fewer entries meet at less cost), and
#: how many segments these have together at most.
CROWD, LEVELS = 4000, 3
#: Entries of a key from which its lines have their rarest pieces as keys, the pieces' lengths (short ones count with their
#: place), and the size of the table of counts that tells rare ones.
MEET, PIECES, SKETCH = 100, (2, 6), 1 << 20
NULL_ID = -(1 << 63)


class Lines:
    """The lines of some texts (an Arrow column), with an end of line behind each text; short ones left out."""

    def __init__(self, column: pa.Array, min_chars: int, key: int = 0):
        raw, offsets = utf8(column)
        n = len(offsets) - 1
        self.raw = np.full(len(raw) + n, 10, np.uint8)
        self.text_end = offsets[1:] + np.arange(n)
        inside = np.ones(len(self.raw), bool)
        inside[self.text_end] = False
        self.raw[inside] = raw
        self.before = None
        end = np.flatnonzero(self.raw == 10)
        start = np.r_[0, end[:-1] + 1] if n else end
        text = np.searchsorted(self.text_end, end)
        number = np.arange(len(end)) - np.searchsorted(text, text)
        if min_chars > 1:
            before = self.code_points()
            keep = np.flatnonzero(before[end] - before[start] >= min_chars)
        else:
            keep = np.flatnonzero(end > start)
        self.text, self.number, self.first_byte, self.end_byte = text[keep], number[keep], start[keep], end[keep]
        self.key = key
        self.id = span_hashes(self.raw, self.first_byte, self.end_byte, key)[0]

    def __len__(self) -> int:
        return len(self.id)

    def code_points(self) -> np.ndarray:
        """How many start before each byte: all bytes but those that continue one."""
        if self.before is None:
            self.before = np.zeros(len(self.raw) + 1, np.int64)
            np.cumsum((self.raw & 0xC0) != 0x80, out=self.before[1:])
        return self.before

    def pick(self, rows: np.ndarray) -> None:
        for name in ("text", "number", "first_byte", "end_byte", "id"):
            setattr(self, name, getattr(self, name)[rows])

    def once(self) -> None:
        """Each line once."""
        self.pick(np.unique(self.id, return_index=True)[1])

    def names(self) -> pa.Array:
        """128 bits that tell each line."""
        both = self.names_of(np.arange(len(self.id))).tobytes()
        return pa.Array.from_buffers(pa.binary(16), len(self.id), [None, pa.py_buffer(both)]).cast(pa.binary())

    def names_of(self, rows: np.ndarray) -> np.ndarray:
        """The same of some lines, as two numbers each."""
        check = span_hashes(self.raw, self.first_byte[rows], self.end_byte[rows], self.key, first_stream=1)[0]
        return np.stack([self.id[rows], check], axis=1).astype(">u8")

    def without(self, rows: np.ndarray) -> pa.Array:
        """The texts without these lines, the others joined by an end of line."""
        step = np.zeros(len(self.raw) + 1, np.int8)
        step[self.first_byte[rows]] += 1
        step[self.end_byte[rows] + 1] -= 1
        stay = np.cumsum(step[:-1], dtype=np.int8) == 0
        kept = np.flatnonzero(stay)
        upto = np.searchsorted(kept, self.text_end, "right")
        some = np.diff(upto, prepend=0) > 0
        # the end behind the last line that stays
        stay[kept[upto[some] - 1]] = False
        offsets = np.zeros(len(upto) + 1, np.int64)
        np.cumsum(np.diff(upto, prepend=0) - some, out=offsets[1:])
        return pa.Array.from_buffers(pa.large_string(), len(upto), [None, pa.py_buffer(offsets), pa.py_buffer(self.raw[stay])])

    def content(self) -> list[str]:
        data = self.raw.tobytes()
        return [data[s:e].decode("utf-8", "replace") for s, e in zip(self.first_byte.tolist(), self.end_byte.tolist())]

    def spread(self) -> None:
        """The code points, where each line starts and ends among them, and rolling hashes."""
        self.points = np.frombuffer(self.raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        before = self.code_points()
        self.start, self.end = before[self.first_byte], before[self.end_byte]
        self.before = None
        self.rolling = Rolling(self.points)

    def signature(self) -> np.ndarray:
        """A bit for the parity of the count of each of 64 classes of code points: an edit changes two at most."""
        bits = np.uint64(1) << (mix(self.points.astype(np.uint64)) & np.uint64(63))
        prefix = np.r_[np.uint64(0), np.bitwise_xor.accumulate(bits)]
        return (prefix[self.end] ^ prefix[self.start]).view(np.int64)


def among(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the ids are known, a sorted array."""
    if not len(known):
        return np.zeros(len(ids), bool)
    return known[np.minimum(np.searchsorted(known, ids), len(known) - 1)] == ids


def segments(length: np.ndarray, t: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of each of the t + 1 segments of lines of these lengths, the longer ones last."""
    size, longer = length // (t + 1), length % (t + 1)
    out, at = [], np.zeros_like(length)
    for i in range(t + 1):
        n = size + (i >= t + 1 - longer)
        out.append((at, n))
        at = at + n
    return out


def _key(hashes: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    return mix(hashes + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)).view(np.int64)


def keys(lines: Lines, t: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(is in the index, lines, keys) of all entries.

    A probe of a line looks for partners of its length or up to t less. Segment i of a partner can have moved by i at
    most when i edits at most come before it, and by the rest when they come behind it. The probe of a line's own length
    and no move is its entry in the index. Up to t = 3, lines of one length have an insertion and a deletion at most, so
    segments of the one move forward only and those of the other back only; one of each line's is unchanged, and the
    probes that look back find it."""
    length = lines.end - lines.start
    for less in range(t + 1):
        other = length - less
        for i, (at, n) in enumerate(segments(other, t)):
            for move in range(max(-i, less - (t - i)), min(i, less + (t - i), 0 if less == 0 and t < 4 else i) + 1):
                begin = at + move
                ok = np.flatnonzero((begin >= 0) & (begin + n <= length) & (other > 0))
                s = lines.start[ok] + begin[ok]
                yield less == move == 0, ok, _key(lines.rolling.of(s, s + n[ok]), other[ok], i)


def moves(t: int, less: int, together: int) -> list[tuple[int, ...]]:
    """How far segments that stand behind each other can have moved: each change from one to the next is an edit, and the
    last one ends up with the difference of the lengths."""
    cost = lambda m: sum(abs(x - y) for x, y in zip((0, *m), (*m, less)))
    return [m for m in product(range(-t, t + 1), repeat=together) if cost(m) <= t]


def finer_keys(lines: Lines, t: int, together: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Like keys, of as many segments together, out of t more than that: t edits leave so many unchanged."""
    length = lines.end - lines.start
    for less in range(t + 1):
        other = length - less
        parts = segments(other, t + together - 1)
        for chosen in combinations(range(len(parts)), together):
            for move in moves(t, less, together):
                begins = [parts[i][0] + m for i, m in zip(chosen, move)]
                fits = [(b >= 0) & (b + parts[i][1] <= length) for i, b in zip(chosen, begins)]
                ok = np.flatnonzero(np.logical_and.reduce(fits) & (other > 0))
                joint = np.zeros(len(ok), np.uint64)
                for i, b in zip(chosen, begins):
                    s = lines.start[ok] + b[ok]
                    joint = mix(joint + lines.rolling.of(s, s + parts[i][1][ok]) + np.uint64(i + 1))
                yield less == 0 and not any(move), ok, _key(joint, other[ok], 16 * together)


def _windows(lines: Lines, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, hash) of all pieces of this width."""
    count = np.maximum(lines.end - lines.start - width + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = lines.start[row] + place
    return row, place, lines.rolling.of(first, first + width)


def _piece_keys(width: int, place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return _key(hashes, place if width == PIECES[0] else np.zeros_like(place), 100 + width)


def piece_counts(lines: Lines) -> np.ndarray:
    """How often each cell of the table has a piece."""
    counts = np.zeros(SKETCH, np.int64)
    for width in PIECES:
        _, place, hashes = _windows(lines, width)
        counts += np.bincount(_piece_keys(width, place, hashes) & (SKETCH - 1), minlength=SKETCH)
    return counts


def piece_keys(lines: Lines, t: int, counts: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Like keys: t + 1 disjoint pieces of a line, the rarest first, are in the index, its pieces at all places that t edits
    allow are probes. Lines have 7t + 2 code points at least, so there is room for them."""
    often, own = [], []
    for width in PIECES:
        row, place, hashes = _windows(lines, width)
        total = np.zeros(len(row), np.int64)
        for move in range(-t, t + 1) if width == PIECES[0] else (0,):
            key = _piece_keys(width, place + move, hashes)
            total += counts[key & (SKETCH - 1)]
            if move:
                yield False, row, key
        often.append((total, np.searchsorted(row, np.arange(len(lines) + 1))))
        own.append((row, key if width != PIECES[0] else _piece_keys(width, place, hashes)))
    chosen = [np.zeros(len(row), bool) for row, _ in own]
    for i, n in enumerate((lines.end - lines.start).tolist()):
        for first, k in rarest([total[at[i] : at[i + 1]] for total, at in often], n, t + 1):
            chosen[k][often[k][1][i] + first] = True
    for (row, key), there in zip(own, chosen):
        yield True, row[there], key[there]
        yield False, row[~there], key[~there]


def rarest(costs: list[np.ndarray], n: int, pieces: int) -> list[tuple[int, int]]:
    """(place, which width) of so many disjoint pieces of a line of n that cost the least together. costs: by width and place."""
    least, steps = np.zeros(n + 1), []
    for _ in range(pieces):
        ending, which = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for k, (width, cost) in enumerate(zip(PIECES, costs)):
            if n >= width:
                new = least[: n - width + 1] + cost
                better = new < ending[width:]
                ending[width:][better], which[width:][better] = new[better], k
        steps.append((ending, which))
        least = np.minimum.accumulate(ending)
    out, end = [], n
    for ending, which in reversed(steps):
        at = int(np.argmin(ending[: end + 1]))
        k = int(which[at])
        end = at - PIECES[k]
        out.append((end, k))
    return out


def within(a: str, b: str, t: int) -> bool:
    """Whether the edit distance is at most t: bit k of a state stands for the k-th diagonal of the band."""
    if abs(len(a) - len(b)) > t:
        return False
    s = 0
    shorter = min(len(a), len(b))
    while s < shorter and a[s] == b[s]:
        s += 1
    e = 0
    while e < shorter - s and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[s : len(a) - e], b[s : len(b) - e]
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    band = (1 << (2 * t + 1)) - 1
    state = [1 << t]
    for _ in range(t):
        state.append((state[-1] | state[-1] << 1) & band)
    for j, c in enumerate(b):
        found = where.get(c, 0)
        match = (found >> (j - t) if j >= t else found << (t - j)) & band
        new = [state[0] & match]
        for d in range(1, t + 1):
            new.append(((state[d] & match) | state[d - 1] | state[d - 1] >> 1 | new[-1] << 1) & band)
        state = new
        if not state[t]:
            return False
    return bool(state[t] >> (len(a) - len(b) + t) & 1)


def _line_pass(docs: DataFrame, make, schema: str, min_chars: int, key: int) -> DataFrame:
    """What make, called for each task, makes of the batches' lines."""
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [(f.name, kinds[f.dataType.simpleString()]) for f in T._parse_datatype_string(schema)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        for batch in slices(batches, 4000, SLICE_BYTES):
            for columns in made(batch, Lines(batch["text"], min_chars, key)):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, types)], names=[n for n, _ in types])

    return docs.mapInArrow(run, schema)


def places(docs: DataFrame, min_chars: int, key: int) -> DataFrame:
    """line, doc, number of every line that may go."""

    def make():
        def places_of(batch, lines):
            yield lines.names(), batch["doc"].to_numpy()[lines.text], lines.number

        return places_of

    return _line_pass(docs, make, "line binary, doc long, number long", min_chars, key)


def entries(docs: DataFrame, t: int, min_chars: int, key: int) -> DataFrame:
    """key, id, own: the entries of all lines; own ones are the index. A line that a task met repeatedly gives its
    entries once from then on."""

    def make():
        met = np.zeros(0, np.uint64)

        def entries_of(batch, lines):
            nonlocal met
            ids, counts = np.unique(lines.id, return_counts=True)
            lines.once()
            if len(met):
                lines.pick(np.flatnonzero(~among(lines.id, met)))
            if len(met) < REMEMBERED:
                met = np.union1d(met, ids[counts > 1])
            lines.spread()
            id_ = lines.id.view(np.int64)
            for own, rows, of_rows in keys(lines, t):
                yield of_rows, id_[rows], np.full(len(rows), own)

        return entries_of

    return _line_pass(docs, make, "key long, id long, own boolean", min_chars, key)


def _texts(docs: DataFrame, wanted: DataFrame, min_chars: int, key: int) -> DataFrame:
    """id, line, line_text, sign of the lines with the ids wanted."""
    schema = "id long, line binary, line_text string, sign long"
    sent = None
    if wanted.count() <= BROADCAST_LINES:
        # a checked number of ids
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["id"].to_numpy().view(np.uint64)))

    def make():
        def texts_of(batch, lines):
            if sent is not None:
                lines.pick(np.flatnonzero(among(lines.id, sent.value)))
            lines.once()
            # the few lines that are wanted are spread, not the texts around them
            content = lines.content()
            few = Lines(pa.array(content, pa.string()), 1, key)
            few.spread()
            yield lines.id.view(np.int64), lines.names(), content, few.signature()

        return texts_of

    found = _line_pass(docs, make, schema, min_chars, key)
    found = found if sent is not None else found.join(wanted, "id", "left_semi")
    return found.groupBy("id", "line").agg(F.min("line_text").alias("line_text"), F.min("sign").alias("sign"))


def _alike(a: str, b: str, t: int):
    """Whether signatures allow t edits."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2 * t


def _verified(pairs: DataFrame, texts: DataFrame, t: int) -> DataFrame:
    """a, b (lines) of the pairs (a, b: ids) within t edits."""
    both = pairs.join(texts.toDF("a", "line_a", "text_a", "sign_a"), "a").join(texts.toDF("b", "line_b", "text_b", "sign_b"), "b").where(_alike("sign_a", "sign_b", t))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [within(x, y, t) for x, y in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist())]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept["line_a"], kept["line_b"]], names=["a", "b"])

    return both.select("line_a", "line_b", "text_a", "text_b").mapInArrow(verify, "a binary, b binary")


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _finer(texts: DataFrame, t: int, together: int, key: int) -> DataFrame:
    """key, id, own of finer_keys of the lines."""

    def make():
        def finer_of(batch, lines):
            lines.spread()
            id_ = lines.id.view(np.int64)
            for own, rows, of_rows in finer_keys(lines, t, together):
                yield of_rows, id_[rows], np.full(len(rows), own)

        return finer_of

    return _line_pass(texts.select(F.col("line_text").alias("text")), make, "key long, id long, own boolean", 1, key)


def _rare(texts: DataFrame, t: int, key: int) -> DataFrame:
    """key, id, own of piece_keys of the lines."""
    texts = texts.select(F.col("line_text").alias("text"))

    def count():
        def cells(batch, lines):
            lines.spread()
            counts = piece_counts(lines)
            at = np.flatnonzero(counts)
            yield at, counts[at]

        return cells

    # a table of a fixed size
    found = _line_pass(texts, count, "cell long, n long", 1, key).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SKETCH, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def make():
        def rare_of(batch, lines):
            lines.spread()
            id_ = lines.id.view(np.int64)
            for own, rows, of_rows in piece_keys(lines, t, sent.value):
                yield of_rows, id_[rows], np.full(len(rows), own)

        return rare_of

    return _line_pass(texts, make, "key long, id long, own boolean", 1, key)


def near_links(docs: DataFrame, t: int = THRESHOLD, min_chars: int = MIN_CHARS, key: int | None = None) -> DataFrame:
    """a, b (lines): links within t edits that connect what all such links connect."""
    key = draw() if key is None else key
    pieces = min_chars >= (PIECES[-1] + 1) * t + PIECES[0]
    of_key = Window.partitionBy("key")
    own = F.when(F.col("own"), F.col("id"))
    dealt, links, texts = entries(docs, t, min_chars, key), None, None
    for together in range(1, LEVELS + 1):
        dealt = dealt.repartition(F.col("key")).withColumn("lead", F.min(own).over(of_key)).withColumn("last", F.max(own).over(of_key))
        many, led = F.col("lead") != F.col("last"), F.col("id") != F.col("lead")
        met = table(dealt.where(many | led).select("key", "id", "own", "lead", many.alias("many"), led.alias("led")))
        rest = met.where("many").select("key", "id", "own").distinct()
        pairs = cut(_pairs(met.where("led"), "id", "lead"))
        if texts is None:
            wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(rest.select("id")).distinct()
            texts = cut(_texts(docs, cut(wanted), min_chars, key))
        found = cut(_verified(pairs, texts, t))
        links = found if links is None else links.unionByName(found)
        # keys of several index entries that are of several components still
        classes = components(links)
        named = texts.join(classes.withColumnRenamed("node", "line"), "line", "left").groupBy("id").agg(F.min(F.coalesce("component", "line")).alias("class"), F.min("sign").alias("sign"))
        rest = rest.join(named, "id")
        open_ = rest.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("entries")).where("low <> high").select("key", (F.col("entries") > (min(MEET, CROWD) if together == 1 and pieces else CROWD)).alias("crowded"))
        rest = cut(rest.join(open_, "key"))
        crowded = cut(rest.where("crowded").select("id").distinct()) if together < LEVELS else None
        more = crowded is not None and crowded.limit(1).count() > 0
        rest = rest.where("not crowded") if more else rest
        x, y = rest.where("own").toDF(*[f"{c}_a" for c in rest.columns]), rest.toDF(*[f"{c}_b" for c in rest.columns])
        others = x.join(y, (F.col("key_a") == F.col("key_b")) & (F.col("class_a") != F.col("class_b")) & _alike("sign_a", "sign_b", t))
        links = cut(links.unionByName(_verified(cut(_pairs(others, "id_a", "id_b")), texts, t)))
        if not more:
            return links
        lines = texts.join(crowded, "id", "left_semi")
        dealt = _rare(cut(lines), t, key) if together == 1 and pieces else _finer(lines, t, together + 1, key)
    return links


def dedup_lines(docs: DataFrame, t: int = THRESHOLD, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """docs with the repeated lines gone, and n_lines, n_removed. exact_chars: from this length on lines go that equal a
    line before; min_chars if not given."""
    exact_chars = min_chars if exact_chars is None else exact_chars
    key = draw()
    docs = without(docs, ("n_lines", "n_removed"))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), "text")
    # read twice below, so the texts are not
    where = table(places(keyed, min(exact_chars, min_chars), key))
    # counts have partial sums, and no order, so a hot line is a few rows of each task
    repeated = cut(where.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    classes = cut(components(near_links(keyed, t, min_chars, key)))
    judged = cut(repeated.join(classes.toDF("line", "class"), "line", "full").select("line", F.coalesce("class", "line").alias("class"), F.coalesce("n", F.lit(1)).alias("n")))
    # lines that more than one of HOT_LINES places hold are few, so they travel to the places; the others meet by a shuffle
    hot = judged.where(F.col("n") * HOT_LINES > judged.agg(F.sum("n")).first()[0]).select("line", "class")
    hot = F.broadcast(cut(hot))
    found = [where.join(hot, "line"), where.join(hot, "line", "left_anti").join(judged.select("line", "class"), "line")]
    first = cut(found[0].unionByName(found[1]).groupBy("class").agg(F.min(F.struct("doc", "number")).alias("first")))
    known = [F.broadcast(first.join(hot.select("class").distinct(), "class", "left_semi")), first]
    gone = None
    for part, of_class in zip(found, known):
        later = part.join(of_class, "class").where((F.col("first.doc") != F.col("doc")) | (F.col("first.number") != F.col("number"))).select("doc", "number", "line")
        gone = later if gone is None else gone.unionByName(later)
    gone = gone.distinct().groupBy("doc").agg(F.collect_list(F.struct("number", "line")).alias("gone"))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    joined = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc")).join(gone, "doc", "left").select("row.*", F.col("gone").alias("__gone"))
    names = docs.columns
    at = names.index("text")

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000, 8 << 20):
            texts, gone = batch["text"], batch["__gone"]
            length = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            total = np.where(length > 0, pc.count_substring(texts, "\n").fill_null(0).to_numpy(zero_copy_only=False) + 1, 0)
            removed = np.zeros(len(texts), np.int64)
            columns = [batch[c] for c in names]
            hit = np.flatnonzero((length > 0) & (pc.list_value_length(gone).fill_null(0).to_numpy(zero_copy_only=False) > 0))
            if len(hit):
                there = Lines(texts.take(pa.array(hit)), min(exact_chars, min_chars), key)
                of_hit = gone.take(pa.array(hit))
                items, of_text = of_hit.flatten(), pc.list_parent_indices(of_hit).to_numpy()
                number, line = items.field("number").to_numpy(), utf8(items.field("line"))[0].reshape(-1, 16)
                # lines are in the order of texts and numbers; rows of one id hold different texts, so names are compared
                span = max(int(there.number.max(initial=0)), int(number.max())) + 1
                place, wanted = there.text * span + there.number, of_text * span + number
                found = np.flatnonzero(among(wanted, place))
                rows = np.searchsorted(place, wanted[found])
                same = (there.names_of(rows) == line[found].copy().view(">u8")).all(axis=1)
                rows = rows[same]
                removed[hit] = np.bincount(there.text[rows], minlength=len(hit))
                order = np.arange(len(texts))
                order[hit] = len(texts) + np.arange(len(hit))
                columns[at] = pa.concat_arrays([texts, there.without(rows).cast(texts.type)]).take(pa.array(order))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(rebuild, schema)


def clean_lines(docs: DataFrame) -> DataFrame:
    """docs without repeated lines, and without the rows that keep blank lines only."""
    docs, back = shielded(docs, ("n_lines", "n_removed"))
    out = dedup_lines(docs, exact_chars=1)
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"(?U)\S")).select(*back)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=1)
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES: dict[str, str] = {}
