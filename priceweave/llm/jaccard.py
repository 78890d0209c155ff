"""N-gram Jaccard join by signature trees.

Documents link when their sets of word n-grams have a Jaccard similarity of at least percent / 100. Equal sets are one
set from the start. Sets that could link meet by exact keys: the tokens are dealt into parts, more than two linked sets
can differ by, so some parts at least are equal; a part is a key if it holds a token that is not hot, that is, one whose
cell of a sketch over all documents counts few of them, so no such key joins more sets than that. A set with too many
parts that are no keys (long hot passages, few tokens) has its rarest tokens as keys besides, as many as one of two
linked sets must share. The smallest set of a key is its centre; a bucket is a centre and the sets that met it, dealt
into cells of a bounded size that all hold the centre. In a cell, a signature tree holds in each node the OR (and the
AND) of its sets' token bitmaps and the range of their sizes; a dual traversal drops pairs of nodes whose greatest
possible overlap is too small, or whose sets are one component already, and verifies the pairs of sets that are left.

Each set first goes to its smallest centre only. Keys whose sets are then of one component are done; the others go to
all their centres; what is still of several components in a bucket of several cells is dealt by component, and the
cells' different components meet.

Defined results
- null or empty text, and texts without words: no shingles, component of their own.
- fewer than n words: the whole sequence is the only shingle.
- repeated rows: each has a row of the result; rows of one id with different texts are judged each by its own text.
  Null doc_id: a row with a null component, linked with nothing. Extra columns are ignored. Empty tables: no rows.
- words, shingles and sets are told apart by 64-bit hashes under a key that each run draws.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import SLICE_BYTES, cut, read, slices, table, utf8
from .hashing import draw, mix, span_hashes

#: Shingles that a cell holds (a single larger set is a cell of its own with its centre).
CHUNK_SHINGLES = 250_000
#: Documents of candidate buckets up to which their ids are sent to every task; beyond, their texts are joined by a shuffle.
BROADCAST_DOCS = 1_000_000
BITS = 1024
#: Cells of the sketch that counts the documents of tokens, a power of two, and how many of them travel in one row. The
#: cells' levels (a byte each) are sent to every task: 4 MB, whatever the input.
CELL_BITS, CELL_ROWS = 22, 64
#: A token is hot if its cell counts over so many documents, plus so many times the mean count.
HOT_DOCS, HOT_MEANS = 64, 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def words_of(column: pa.Array, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, the text that it is in) of lower-cased texts split at ASCII white space."""
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    # a space after each text keeps words apart
    gap = np.full(len(raw) + n, 32, np.uint8)
    gap[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))] = _LOWER[raw]
    inside = ~_SPACE[gap]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(offsets[1:] + np.arange(1, n + 1), start, side="right")
    return span_hashes(gap, start, end, key)[0], text


def shingle_sets(column: pa.Array, n: int, key: int = 0) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    words, text = words_of(column, key)
    edges = np.searchsorted(text, np.arange(len(column) + 1))
    out = []
    full = np.zeros(0, np.uint64)
    if len(words) >= n:
        full = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            full += words[k : len(words) - n + 1 + k] * _MULTIPLIERS[k]
        full = mix(full)
    for i in range(len(column)):
        s, e = edges[i], edges[i + 1]
        if e - s >= n:
            out.append(np.unique(full[s : e - n + 1]))
        elif e > s:
            # fewer words than a shingle has: another multiplier tells their number
            weights = _MULTIPLIERS[: e - s] * np.uint64(2 * (e - s) + 1)
            out.append(mix((words[s:e] * weights).sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(full[:0])
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(s) for s in sets], np.int64)
    total = np.r_[np.uint64(0), np.cumsum(mix(np.concatenate(sets) if sets else np.zeros(0, np.uint64)), dtype=np.uint64)]
    ends = np.cumsum(sizes)
    return mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


class Heat:
    """How many documents a token's cell counts, as a level: levels rise by a quarter of a doubling."""

    def __init__(self, levels: np.ndarray, total: int):
        self.levels = levels
        self.hot = self.level(np.array([HOT_DOCS + HOT_MEANS * total / len(levels)]))[0]

    @staticmethod
    def level(counts: np.ndarray) -> np.ndarray:
        return np.minimum(4 * np.log2(1 + counts), 255).astype(np.uint8)

    @staticmethod
    def cell(tokens: np.ndarray) -> np.ndarray:
        return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        return self.levels[self.cell(tokens)]


class Levels:
    """Size levels and how many parts the sets of each are dealt into."""

    def __init__(self, percent: int, longest: int):
        self.percent = percent
        # the smallest set that links with an unequal one: percent * (size + 1) <= 100 * size
        self.least = -(-percent // (100 - percent)) if percent < 100 else longest + 1
        tops = [self.least - 1]
        while tops[-1] < longest:
            tops.append(int(tops[-1] * 1.4) + 2)
        self.tops = np.array(tops, np.int64)
        # two sets of a level differ by so many tokens at most, so one part more is equal; the spare ones may be no keys
        differ = 2 * self.tops * (100 - percent) // (100 + percent)
        self.spare = np.maximum(2, -(-15 * differ // 100))
        self.parts = differ + 1 + self.spare

    def of(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(sets, level) with keys to make: the own level, and the next if a partner can be in it."""
        rows = np.flatnonzero(sizes >= self.least)
        level = np.searchsorted(self.tops, sizes[rows])
        above = (100 * sizes[rows] >= self.percent * (self.tops[level] + 1)) & (level + 1 < len(self.tops))
        return [(rows, level), (rows[above], level[above] + 1)]


def part_keys(sets: list[np.ndarray], percent: int, heat: Heat) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sets, keys) such that any two sets that link, and are unequal, have a key in common.

    Of two linked sets of a level more parts are equal than are spare. If one of the two has no more useless parts than
    are spare, an equal part is a key of both; if both have more, both have rare tokens as keys."""
    sizes = np.array([len(s) for s in sets], np.int64)
    levels = Levels(percent, int(2 * sizes.max(initial=0) + 10))
    for rows, level in levels.of(sizes):
        if not len(rows):
            continue
        tokens = np.concatenate([sets[i] for i in rows])
        owner = np.repeat(np.arange(len(rows)), sizes[rows])
        parts = levels.parts[level]
        first = np.cumsum(parts) - parts
        # the bits that deal are not those that the sketch's cells have
        slot = first[owner] + ((tokens & np.uint64(0x7FFFFFFF)) % parts[owner].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(parts.sum(), np.uint64)
        np.add.at(sums, slot, mix(tokens ^ np.uint64(0x5DEECE66D)))
        warm = heat.of(tokens)
        useful = np.bincount(slot, warm <= heat.hot, len(sums)) > 0
        of = np.repeat(np.arange(len(rows)), parts)
        number = np.arange(len(sums)) - first[of]
        keep = np.flatnonzero(useful)
        tag = (level[of[keep]] * 1_000_003 + number[keep]).astype(np.uint64)
        yield rows[of[keep]], mix(sums[keep] + tag * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        useless = np.bincount(of, ~useful, len(rows)).astype(np.int64)
        weak = np.flatnonzero(useless > levels.spare[level])
        if len(weak):
            chosen = np.isin(owner, weak)
            token, whose, warmth = tokens[chosen], owner[chosen], warm[chosen]
            order = np.lexsort((token, warmth, whose))
            token, whose = token[order], whose[order]
            size = sizes[rows][whose]
            start = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
            rank = np.arange(len(whose)) - np.repeat(start, np.diff(np.r_[start, len(whose)]))
            # linked sets share percent% of either, so one of these tokens is in both
            rare = rank <= size - -(-percent * size // 100)
            tag = level[whose[rare]].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
            yield rows[whose[rare]], mix(token[rare] ^ mix(tag)).view(np.int64)


class SignatureTree:
    """Binary tree over sets in an order that brings similar ones together."""

    def __init__(self, sets: list[np.ndarray], classes: list[int], percent: int):
        self.percent = percent
        self.order = sorted(range(len(sets)), key=lambda i: (classes[i], int(sets[i][0]), len(sets[i])))
        self.sets = sets
        self.parent = list(range(len(sets)))
        by_class: dict[int, int] = {}
        for i, c in enumerate(classes):
            self.parent[i] = by_class.setdefault(c, i)
        bitmaps = []
        for s in sets:
            bits = np.zeros(BITS, bool)
            bits[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
            bitmaps.append(int.from_bytes(np.packbits(bits).tobytes(), "big"))
        # node: [from, to, OR, AND, least size, greatest size, left, right, one component]
        self.nodes: list[list] = []
        self.links: list[tuple[int, int]] = []

        def build(lo: int, hi: int) -> int:
            if hi - lo == 1:
                i = self.order[lo]
                self.nodes.append([lo, hi, bitmaps[i], bitmaps[i], len(sets[i]), len(sets[i]), -1, -1, True])
                return len(self.nodes) - 1
            mid = (lo + hi) // 2
            a, b = build(lo, mid), build(mid, hi)
            x, y = self.nodes[a], self.nodes[b]
            self.nodes.append([lo, hi, x[2] | y[2], x[3] & y[3], min(x[4], y[4]), max(x[5], y[5]), a, b, False])
            return len(self.nodes) - 1

        self.root = build(0, len(sets)) if sets else -1

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def united(self, node: list) -> bool:
        if not node[8]:
            first = self.find(self.order[node[0]])
            node[8] = all(self.find(self.order[k]) == first for k in range(node[0] + 1, node[1]))
        return node[8]

    def hopeless(self, a: list, b: list) -> bool:
        """Whether no set of a can link with one of b: even the greatest overlap is too small."""
        most = min(a[5] - (a[3] & ~b[2]).bit_count(), b[5] - (b[3] & ~a[2]).bit_count())
        # overlap >= percent% of the union, and the union is both sizes less the overlap
        return most * (100 + self.percent) < self.percent * (a[4] + b[4])

    def join(self) -> list[tuple[int, int]]:
        """Links that connect what links connect: pairs within one component are not looked at again."""
        if self.root < 0:
            return []
        todo = [(self.root, self.root)]
        while todo:
            x, y = todo.pop()
            a, b = self.nodes[x], self.nodes[y]
            if x == y:
                if not self.united(a):
                    todo += [(a[6], a[7]), (a[7], a[7]), (a[6], a[6])]
                continue
            if self.united(a) and self.united(b) and self.find(self.order[a[0]]) == self.find(self.order[b[0]]):
                continue
            if self.hopeless(a, b):
                continue
            if a[6] < 0 and b[6] < 0:
                self.verify(self.order[a[0]], self.order[b[0]])
            elif b[6] < 0 or a[6] >= 0 and a[1] - a[0] >= b[1] - b[0]:
                todo += [(a[7], y), (a[6], y)]
            else:
                todo += [(x, b[7]), (x, b[6])]
        return self.links

    def verify(self, i: int, j: int) -> None:
        s, t = self.sets[i], self.sets[j]
        if len(s) > len(t):
            s, t = t, s
        at = np.minimum(np.searchsorted(t, s), len(t) - 1)
        both = int((t[at] == s).sum())
        if 100 * both >= self.percent * (len(s) + len(t) - both):
            self.links.append((i, j))
            self.parent[self.find(i)] = self.find(j)


def tree_links(cells: DataFrame, docs: DataFrame, n: int, percent: int, key: int) -> DataFrame:
    """a, b (prints) of the links that the trees of cells (cell, doc, print, class) find. The sets are made from the
    texts where these are read, and shuffled once, to their cells."""
    there = _sets(docs, cells, n, key).repartition(F.col("cell")).sortWithinPartitions("cell", "print")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, prints, classes, held = None, [], [], []
        found: list[tuple[int, int]] = []

        def close():
            if len(prints) > 1:
                for i, j in SignatureTree(held, classes, percent).join():
                    found.append((prints[i], prints[j]))

        def links():
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in slices(batches, 2000):
            values = batch["shingles"]
            flat = values.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            edges = np.r_[0, np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))]
            for k, (cell, print_, cls) in enumerate(zip(batch["cell"].to_pylist(), batch["print"].to_pylist(), batch["class"].to_pylist())):
                if cell != current:
                    close()
                    current, prints, classes, held = cell, [], [], []
                if prints and prints[-1] == print_:
                    continue  # a repeated row
                prints.append(print_)
                classes.append(cls)
                held.append(flat[edges[k] : edges[k + 1]].copy())
            if len(found) > 10_000:
                yield links()
                found = []
        close()
        yield links()

    return there.mapInArrow(run, "a long, b long")


def _sizes(docs: DataFrame, n: int, key: int) -> DataFrame:
    """doc_id, mark, print, n_shingles of each row of docs (doc_id, text, mark); besides, for each task, rows of its
    sketch: part, cells (compressed counts of documents)."""
    names = ["doc_id", "mark", "print", "n_shingles", "part", "cells"]
    schema = "doc_id long, mark long, print long, n_shingles long, part int, cells binary"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in slices(batches, 4000, SLICE_BYTES):
            sets = shingle_sets(batch["text"], n, key)
            if sets:
                np.add.at(counts, Heat.cell(np.concatenate(sets)), np.uint32(1))
            nothing = [pa.nulls(batch.num_rows, t) for t in types[4:]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(fingerprints(sets)), pa.array([len(s) for s in sets], pa.int64()), *nothing], names=names)
        rows = [(k, pa.compress(c.tobytes(), "zstd", asbytes=True)) for k, c in enumerate(np.split(counts, CELL_ROWS)) if c.any()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in types[:4]), *(pa.array([r[k] for r in rows], types[4 + k]) for k in (0, 1))], names=names)

    return docs.mapInArrow(run, schema)


def _heat(rows: DataFrame) -> Heat:
    """The sketches of all tasks as one: tasks add the counts up and give a level for each cell back, 4 MB in all."""
    width = (1 << CELL_BITS) // CELL_ROWS

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches, 64):
            for part, cells in zip(batch["part"].to_pylist(), batch["cells"].to_pylist()):
                counts = np.frombuffer(pa.decompress(cells, 4 * width, "zstd", asbytes=True), np.uint32)
                sums[part] = sums.get(part, 0) + counts.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([int(c.sum()) for c in sums.values()], pa.int64()), pa.array([Heat.level(c).tobytes() for c in sums.values()], pa.binary())], names=["part", "total", "levels"])

    levels, total = np.zeros((CELL_ROWS, width), np.uint8), 0
    added = rows.where(F.col("part").isNotNull()).select("part", "cells").repartition(F.col("part")).mapInArrow(add, "part int, total long, levels binary")
    for r in added.collect():  # CELL_ROWS rows at most
        levels[r["part"]] = np.frombuffer(r["levels"], np.uint8)
        total += r["total"]
    return Heat(levels.ravel(), total)


def _meetings(docs: DataFrame, n: int, percent: int, heat: Heat, key: int) -> DataFrame:
    """key, center, print: the sets that share a key with a smaller one, and the smallest one of the key."""
    sent = docs.sparkSession.sparkContext.broadcast(heat)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000, SLICE_BYTES):
            sets = shingle_sets(batch["text"], n, key)
            prints, first = np.unique(fingerprints(sets), return_index=True)
            for rows, keys_ in part_keys([sets[i] for i in first], percent, sent.value):
                yield pa.RecordBatch.from_arrays([pa.array(keys_), pa.array(prints[rows])], names=["key", "print"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_center = last_print = None
        for batch in batches:
            key, print_ = batch["key"].to_numpy(), batch["print"].to_numpy()
            if not len(key):
                continue
            new = np.r_[last_key is None or key[0] != last_key, key[1:] != key[:-1]]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            center = np.where(lead >= 0, print_[np.maximum(lead, 0)], 0 if last_center is None else last_center)
            again = np.r_[not new[0] and print_[0] == last_print, ~new[1:] & (print_[1:] == print_[:-1])]
            last_key, last_center, last_print = key[-1], center[-1], print_[-1]
            keep = (center != print_) & ~again
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, center, print_)], names=["key", "center", "print"])

    # sets of equal keys follow each other in a partition, so a group of any size streams through
    return docs.mapInArrow(keys, "key long, print long").repartition(F.col("key")).sortWithinPartitions("key", "print").mapInArrow(meet, "key long, center long, print long")


def _buckets(pairs: DataFrame, lead: DataFrame) -> DataFrame:
    """cell, bucket, cells, doc, print, class of pairs (center, print): a center is in each of its bucket's cells."""
    size = lead.select("print", "doc", "size")
    members = pairs.distinct().join(size, "print")
    total = members.groupBy("center").agg(F.sum(F.col("size") + 1).alias("total"))
    cells = F.ceil(F.col("total") / CHUNK_SHINGLES).cast("int").alias("cells")
    total = cut(total.select("center", cells))
    dealt = members.join(total, "center").select("center", "cells", F.pmod(F.xxhash64("print"), "cells").cast("int").alias("deal"), "doc", "print")
    own = total.join(size, total["center"] == size["print"]).select("center", "cells", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("deal"), "doc", "print")
    return dealt.unionByName(own).select(F.xxhash64("center", "deal").alias("cell"), F.col("center").alias("bucket"), "cells", "doc", "print", F.col("print").alias("class"))


def _classed(rows: DataFrame, classes: DataFrame, column: str, name: str) -> DataFrame:
    """rows and, as name, the component of the set in a column."""
    found = classes.select(F.col("node").alias(f"__{name}"), F.col("component").alias(name))
    return rows.join(found, rows[column] == found[f"__{name}"], "left").drop(f"__{name}").withColumn(name, F.coalesce(name, column))


def _mixed(met: DataFrame, classes: DataFrame) -> DataFrame:
    """met's rows of the keys whose sets are of several components, with the components (class)."""
    rows = _classed(_classed(met, classes, "print", "class"), classes, "center", "of_center")
    open_ = rows.where(F.col("class") != F.col("of_center")).select("key").distinct()
    return rows.join(open_, "key", "left_semi")


def jaccard_links(docs: DataFrame, lead: DataFrame, heat: Heat, n: int, percent: int, key: int) -> DataFrame:
    """a, b (prints): links that connect what links connect. docs: doc_id, text, without null ids; lead: print, doc, size."""
    met = table(_meetings(docs, n, percent, heat, key))
    # each set with its smallest center
    first = cut(_buckets(met.groupBy("print").agg(F.min("center").alias("center")), lead))
    links = cut(tree_links(first, docs, n, percent, key))
    # keys that are not done: of several components, and not all of their sets with this center in its only cell
    with_center = first.where(F.col("cells") == 1).select(F.col("bucket").alias("center"), "print").distinct().withColumn("there", F.lit(True))
    mixed = _mixed(met, components(links)).join(with_center, ["center", "print"], "left")
    undone = mixed.where(F.col("there").isNull()).select("key").distinct()
    mixed = cut(mixed.join(undone, "key", "left_semi").select("key", "center", "print"))
    if not mixed.limit(1).count():
        return links
    second = cut(_buckets(mixed.select("center", "print"), lead))
    links = cut(links.unionByName(tree_links(second, docs, n, percent, key)))
    # centers of several cells: what was dealt apart and is of different components still
    several = second.where(F.col("cells") > 1).select(F.col("bucket").alias("center")).distinct()
    apart = mixed.join(several, "center", "left_semi")
    if not apart.limit(1).count():
        return links
    apart = _mixed(apart, components(links)).select(F.col("center").alias("bucket"), "print", "class").distinct()
    apart = cut(_by_class(apart.join(lead, "print")))
    return links.unionByName(cut(tree_links(_chunk_pairs(apart), docs, n, percent, key)))


def _by_class(members: DataFrame) -> DataFrame:
    """members (bucket, print, class, doc, size) with their chunk: large classes have chunks of their own, the small ones
    of a bucket are dealt together."""
    classes = cut(members.groupBy("bucket", "class").agg(F.sum(F.col("size") + 1).alias("total")))
    large = F.col("total") > CHUNK_SHINGLES
    small = classes.where(~large).groupBy("bucket").agg(F.sum("total").alias("small"))
    classes = classes.join(small, "bucket", "left")
    of_class = F.when(large, F.xxhash64("class", F.pmod(F.xxhash64("print"), F.ceil(F.col("total") / CHUNK_SHINGLES)))).otherwise(F.pmod(F.xxhash64("class"), F.ceil(F.col("small") / CHUNK_SHINGLES)))
    return members.join(classes, ["bucket", "class"]).withColumn("chunk", of_class).select("bucket", "chunk", "doc", "print", "class")


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    return _components(docs, n, percent).drop("mark")


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """jaccard_components and mark, a hash of the row's text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    key = draw()
    made = cut(_sizes(docs, n, key))
    rows = made.where(F.col("part").isNull())
    known = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    lead = cut(known.groupBy("print").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("size")))
    links = jaccard_links(docs.where(F.col("doc_id").isNotNull()), lead, _heat(made), n, percent, key)
    classes = cut(components(links))
    least = classes.join(lead, classes["node"] == lead["print"]).groupBy("component").agg(F.min("doc").alias("component_id"))
    named = classes.join(least, "component").select("node", "component_id")
    of_print = lead.join(named, lead["print"] == named["node"], "left").select("print", F.coalesce("component_id", "doc").alias("component_id"))
    out = rows.join(of_print, "print", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), "mark")


def _chunk_pairs(dealt: DataFrame) -> DataFrame:
    """cell, doc, print, class: a cell for each two chunks of a bucket that do not hold one and the same class only."""
    chunks = dealt.groupBy("bucket", "chunk").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    a, b = chunks.toDF("bucket", "i", "low_i", "high_i"), chunks.toDF("bucket", "j", "low_j", "high_j")
    same = (F.col("low_i") == F.col("high_i")) & (F.col("low_i") == F.col("low_j")) & (F.col("low_j") == F.col("high_j"))
    pairs = a.join(b, "bucket").where((F.col("i") <= F.col("j")) & ~same).select("bucket", "i", "j", F.xxhash64("bucket", "i", "j").alias("cell"))
    sides = pairs.select("bucket", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"), "cell")
    return sides.join(dealt, ["bucket", "chunk"]).select("cell", "doc", "print", "class")


def _sets(docs: DataFrame, cells: DataFrame, n: int, key: int) -> DataFrame:
    """cells (cell, doc, print, class) with the shingles of each set."""
    cells = cut(cells.select("cell", "doc", "print", "class"))
    if cells.count() <= BROADCAST_DOCS:
        rows = cells.toArrow()  # a checked number
        order = np.argsort(rows["doc"].to_numpy(), kind="stable")
        sent = docs.sparkSession.sparkContext.broadcast([rows[c].to_numpy()[order] for c in ("doc", "cell", "print", "class")])
    else:
        dealt = cells.groupBy("doc").agg(F.collect_list(F.struct("cell", "print", "class")).alias("cells"))
        docs, sent = docs.join(dealt, docs["doc_id"] == dealt["doc"]).select("doc_id", "text", "cells"), None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4000, SLICE_BYTES):
            if sent is None:
                sizes = batch["cells"].value_lengths().to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(batch.num_rows), sizes)
                cell, print_, cls = (c.to_numpy() for c in batch["cells"].flatten().flatten())
            else:
                ids, *columns = sent.value
                doc = batch["doc_id"].to_numpy(zero_copy_only=False)
                low, high = np.searchsorted(ids, doc), np.searchsorted(ids, doc, side="right")
                batch = batch.filter(pa.array(high > low))
                low, sizes = low[high > low], (high - low)[high > low]
                at = np.repeat(np.arange(len(sizes)), sizes)
                place = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                cell, print_, cls = (c[place] for c in columns)
            sets = shingle_sets(batch["text"], n, key)
            # rows of one id can have different texts
            right = np.flatnonzero(fingerprints(sets)[at] == print_)
            shingles = pa.array([sets[i].view(np.int64) for i in at[right]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cell[right]), pa.array(print_[right]), pa.array(cls[right]), shingles], names=["cell", "print", "class", "shingles"])

    return docs.mapInArrow(run, "cell long, print long, class long, shingles array<long>")


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller id."""
    found = _components(docs, n, percent)
    later = cut(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__later"), F.col("mark").alias("__mark")).distinct())
    return docs.join(later, (docs["doc_id"] == later["__later"]) & (F.xxhash64(docs["text"]) == later["__mark"]), "left_anti")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS sh FROM w, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM w UNION SELECT r.node, l.y FROM reach r JOIN both_ways l ON l.x = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON c.node = w.doc_id
"""

QUERIES = {"op3_jaccard": op3_jaccard}
ORACLES = {"op3_jaccard": SQL}
