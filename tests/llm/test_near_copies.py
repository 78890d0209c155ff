"""Many near copies of one line do not all meet, and keys by rare pieces lose no link."""

import random

import numpy as np
import pyarrow as pa
import pytest

from priceweave.llm import line_dedup

from .test_crowded_lines import changed


def copies(r, n):
    line = "".join(r.choice("abcdefghij    ") for _ in range(300))
    out = set()
    while len(out) < n:
        at = r.randrange(len(line))
        out.add(line[:at] + "".join(r.choice("klmnopqrstuvwxyz") for _ in range(4)) + line[at:])
    return sorted(out)


@pytest.mark.parametrize("size", [20, 45, 300])
def test_lines_within_the_threshold_have_a_rare_piece_in_common(size):
    r = random.Random(size)
    base = "".join(r.choice("abcd") for _ in range(size))
    pairs = [(a, changed(r, a, r.randint(0, 2))) for a in (changed(r, base, 4) + "xy" for _ in range(200))]
    lines = line_dedup.Lines(pa.array([x for p in pairs for x in p]), 1)
    lines.spread()
    index, probes = {}, {}
    for own, rows, key in line_dedup.piece_keys(lines, 2, line_dedup.piece_counts(lines)):
        for row, k in zip(rows.tolist(), key.tolist()):
            probes.setdefault(row, set()).add(k)
            if own:
                index.setdefault(row, set()).add(k)
    assert all(len(index[i]) == 3 for i in range(len(lines)))
    assert all(index[i] & probes[i + 1] and index[i + 1] & probes[i] for i in range(0, len(lines), 2))


def test_the_rarest_disjoint_pieces_are_chosen():
    r = np.random.default_rng(1)
    for n in (16, 20):
        costs = [r.integers(0, 9, n - w + 1) for w in line_dedup.PIECES]
        got = line_dedup.rarest(costs, n, 2)
        spans = [(x, x + w, costs[k][x]) for k, w in enumerate(line_dedup.PIECES) for x in range(n - w + 1)]
        want = min(a[2] + b[2] for a in spans for b in spans if a[1] <= b[0])
        assert sum(costs[k][x] for x, k in got) == want
        (a, i), (b, _) = sorted(got)
        assert a + line_dedup.PIECES[i] <= b


def test_near_copies_of_a_line_are_no_square(spark, monkeypatch):
    lines, compared = copies(random.Random(5), 800), []
    verified = line_dedup._verified

    def counted(pairs, texts, t):
        compared.append(pairs.count())
        return verified(pairs, texts, t)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc long, text string").repartition(4)
    line_dedup.near_links(docs, 2, 20, key=3).count()
    assert sum(compared) <= 40 * len(lines)
