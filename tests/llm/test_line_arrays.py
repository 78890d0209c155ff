"""Lines of op9 as arrays: texts without some lines, ids among sorted ones, and as few entries as find all pairs."""

import random

import numpy as np
import pyarrow as pa

from priceweave.llm import line_dedup


def test_texts_without_some_lines():
    r = random.Random(3)
    for _ in range(300):
        texts = ["\n".join(r.choice(["", "a", "é漢", " b c "]) for _ in range(r.randint(1, 6))) or "x" for _ in range(5)]
        lines = line_dedup.Lines(pa.array(texts), 1)
        rows = np.flatnonzero([r.random() < 0.5 for _ in range(len(lines))])
        gone = set(zip(lines.text[rows].tolist(), lines.number[rows].tolist()))
        want = ["\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)]
        assert lines.without(rows).to_pylist() == want


def test_ids_among_sorted_ones():
    known = np.array([1, 5, 1 << 63], np.uint64)
    ids = np.array([0, 1, 5, 6, 1 << 63, (1 << 64) - 1], np.uint64)
    assert line_dedup.among(ids, known).tolist() == [False, True, True, False, True, False]
    assert not line_dedup.among(ids, known[:0]).any()


def edited(r: random.Random, line: str, t: int) -> str:
    x = list(line)
    for _ in range(t):
        at = r.randrange(len(x) + 1)
        kind = r.randrange(3)
        x[at : at + (kind > 0)] = [r.choice("ab")] if kind < 2 else []
    return "".join(x)


def test_eleven_entries_find_all_pairs():
    """Edits crowd about the segments' ends, where an insertion and a deletion leave least."""
    r = random.Random(4)
    for t in (1, 2, 3, 4):
        pairs = [(a, edited(r, a, t)) for a in ("".join(r.choice("ab") for _ in range(r.randint(6, 24))) for _ in range(1500))]
        lines = line_dedup.Lines(pa.array([x for p in pairs for x in p]), 1)
        lines.spread()
        own, all_, n = [set() for _ in range(len(lines))], [set() for _ in range(len(lines))], 0
        for is_own, rows, keys in line_dedup.keys(lines, t):
            n += len(keys)
            for i, k in zip(rows.tolist(), keys.tolist()):
                all_[i].add(k)
                if is_own:
                    own[i].add(k)
        for i in range(0, len(lines), 2):
            assert own[i] & all_[i + 1] or own[i + 1] & all_[i], (t, lines.content()[i : i + 2])
        assert t != 2 or n <= 11 * len(lines)


def test_rows_of_one_id_lose_their_own_lines(spark):
    rows = [(1, "one\ntwo"), (1, "one\nthree\n\n"), (2, "two\nthree\nfour"), (3, None), (4, ""), (5, "\nfour\n")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), exact_chars=1).collect()
    got = sorted((r["doc_id"], r["text"] or "", r["n_lines"], r["n_removed"]) for r in out)
    assert got == [(1, "one\nthree\n\n", 4, 0), (1, "one\ntwo", 2, 0), (2, "four", 3, 2), (3, "", 0, 0), (4, "", 0, 0), (5, "\n", 3, 1)]
    assert [r["text"] for r in out if r["doc_id"] == 3] == [None]
