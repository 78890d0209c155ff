"""Lines that share a segment and nothing else do not all meet, and finer keys lose no link."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from priceweave.llm import line_dedup
from priceweave.operators.graph import components


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(r, line, n):
    for _ in range(n):
        at = r.randrange(len(line))
        line = r.choice([line[:at] + line[at + 1 :], line[:at] + r.choice("xyz") + line[at:], line[:at] + r.choice("xyz") + line[at + 1 :]])
    return line


@pytest.mark.parametrize("together", [1, 2, 3])
def test_lines_within_the_threshold_have_a_key_in_common(together):
    r = random.Random(together)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("abcdefgh") for _ in range(r.randint(20, 45)))
        pairs.append((a, changed(r, a, r.randint(0, 2))))
    lines = line_dedup.Lines(pa.array([x for p in pairs for x in p]), 1)
    lines.spread()
    index, probes = {}, {}
    for own, rows, key in line_dedup.keys(lines, 2) if together == 1 else line_dedup.finer_keys(lines, 2, together):
        for row, k in zip(rows.tolist(), key.tolist()):
            probes.setdefault(row, set()).add(k)
            if own:
                index.setdefault(row, set()).add(k)
    for i in range(len(pairs)):
        a, b = 2 * i, 2 * i + 1
        assert index[a] & probes[b] or index[b] & probes[a], pairs[i]


@pytest.mark.parametrize("crowd", [1, 3])
def test_links_with_crowded_keys_equal_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    head, half = word(14), word(24)
    lines = [head + word(28) for _ in range(25)] + [half + word(18) for _ in range(15)]
    lines += [changed(r, x, r.randint(1, 2)) for x in lines[::3]] + [changed(r, lines[0], 2) for _ in range(5)]
    lines = sorted({x for x in lines if len(x) >= 20})
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc long, text string")
    found = line_dedup.near_links(docs, 2, 20, key=5)
    names = dict(zip(line_dedup.Lines(pa.array(lines), 20, 5).names().to_pylist(), lines))
    classes = {}
    for row in components(found).collect():
        classes.setdefault(bytes(row["component"]), set()).add(names[bytes(row["node"])])
    want = {x: {x} for x in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2 and want[a] is not want[b]:
                want[a] |= want[b]
                for x in want[b]:
                    want[x] = want[a]
    assert {frozenset(v) for v in classes.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def test_boilerplate_is_no_square(spark, monkeypatch):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    head = word(15)
    lines = [head + word(30) for _ in range(5000)]
    compared = []
    verified = line_dedup._verified

    def counted(pairs, texts, t):
        compared.append(pairs.count())
        return verified(pairs, texts, t)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc long, text string").repartition(4)
    assert line_dedup.near_links(docs, 2, 20).agg(F.count("*")).first()[0] == 0
    assert sum(compared) <= 10 * len(lines)
