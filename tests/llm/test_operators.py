"""Each operator against a plain version of the same contract, on awkward documents."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from priceweave.llm import chat_format, decontaminate, extract, hashing, jaccard, line_dedup, packing, pii, quality, suffix_dedup, topk

from .cases import SCHEMA, awkward, frame

LABELS = "doc_id long, quality int, toxic int"


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def plain_windows(items, n=10):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - n + 1)):
            if w[s : s + n] and i is not None:
                windows[tuple(w[s : s + n])].add(str(i))
    return words, windows


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_decontaminate_equals_scan(spark, block_bytes):
    rows = awkward()
    items = [(1, " ".join(rows[16][1].split()[20:45])), (2, "One TWO"), (3, None), (4, ""), (12, " ".join(rows[16][1].split()[25:40])), (5, "ab " * 11), (None, "one"), (6, "☃ é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_hits(frame(spark), bench, block_bytes=block_bytes).collect()}
    words, windows = plain_windows(items)
    for row in rows:
        w, hit, found = words(row[1]), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        spans = {k for s in got[row[0]]["spans"] for k in range(s["start"], s["end"])}
        assert (got[row[0]]["n_words"], spans, got[row[0]]["items"]) == (len(w), hit, sorted(found)), row[0]


def test_decontaminate_removes_and_keeps_columns(spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    out = decontaminate.decontaminate(frame(spark), bench)
    assert out.columns == frame(spark).columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[5] == "" and texts[4] == "one" and texts[0] is None
    assert decontaminate.find_hits(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(frame(spark), bench.limit(0)).count() == len(awkward())


def test_fm_index_finds_all():
    r = np.random.default_rng(1)
    text = np.r_[r.integers(2, 5, 400), 0]
    text[[50, 51, 200]] = 1
    index = decontaminate.FMIndex(text, 5)
    for n in (1, 2, 5):
        for s in range(0, 390, 7):
            pattern = text[s : s + n]
            if (pattern < 2).any():
                continue
            low, high = index.search(pattern[::-1][None, :], np.array([n]))
            want = [k for k in range(len(text) - n) if (text[k : k + n] == pattern).all()]
            assert sorted(index.locate(np.arange(low[0], high[0]))) == want


# 2


def plain_removal(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted((r[0], r[1]) for r in rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        out[i] = (len(b), bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("wide,collection,few", [(4096, 1024, True), (3, 2, True), (4096, 1024, False)])
def test_suffix_dedup_equals_scan(spark, monkeypatch, wide, collection, few):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)
    if not few:
        monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0)
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.dedup_substrings(frame(spark)).collect()}
    assert got == plain_removal(awkward())


def test_suffix_dedup_empty_and_repeated(spark):
    assert suffix_dedup.dedup_substrings(empty(spark)).count() == 0
    row = awkward()[6]
    rows = suffix_dedup.dedup_substrings(frame(spark, [row, row, (None, *row[1:])])).collect()
    assert sorted(len(r["kept"]) for r in rows) == [0, 0, len(row[1])]  # the null id comes first


@pytest.mark.parametrize("few", [True, False])
def test_suffix_dedup_null_ids(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0)
    r = np.random.default_rng(8)
    part = lambda: "".join(r.choice(list("abcdefgh "), 300))
    twice, other, shared = part(), part() + part() + part(), part()
    texts = [twice + "|" + twice, other, shared + "#" + part(), part() + "#" + part(), None, ""]
    rows = [(None, t, "en", "s", 0, "x", "y", "z", "w") for t in texts] + [(1, shared + "!", "en", "s", 0, "x", "y", "z", "w")]
    got = suffix_dedup.dedup_substrings(frame(spark, rows)).collect()
    assert sorted(bytes(x["kept"]).decode() for x in got if x["doc_id"] is None) == sorted([twice + "|", *texts[1:4], "", ""])
    assert [bytes(x["kept"]) for x in got if x["doc_id"] == 1] == [b"!"]


def test_collection_is_the_sorted_suffixes_and_their_common_prefixes():
    r = np.random.default_rng(2)
    for strings in ([b"banana", b"", b"bandana", b"ananas"], [bytes(r.choice([97, 98], n).astype(np.uint8)) for n in r.integers(0, 40, 30)]):
        for limit in (1, 3, 10):
            string, size, common = suffix_dedup.Collection(strings, limit).build()
            suffixes = [strings[s][len(strings[s]) - n :] for s, n in zip(string, size)]
            assert suffixes == sorted(suffixes) and len(suffixes) == sum(len(s) + 1 for s in strings)
            for a, b, c in zip(suffixes, suffixes[1:], common[1:]):
                assert c == min(limit, next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def test_suffix_dedup_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.dedup_substrings(frame(spark)).collect()}
    assert got == plain_removal(awkward())


def test_suffix_dedup_tells_texts_of_one_id_apart(spark):
    r = np.random.default_rng(4)
    text = lambda n: "".join(r.choice(list("abcdefghij"), n))
    shared, own = text(150), [text(400) for _ in range(5)]
    rows = [(7, own[0] + shared), (7, own[1] + shared), (7, own[1] + shared), (7, text(30)), (9, own[2] + shared), (None, own[3] + shared), (None, own[4] + shared), (9, None)]
    for limit in (suffix_dedup.BROADCAST_ROWS, 0):
        suffix_dedup_limit, suffix_dedup.BROADCAST_ROWS = suffix_dedup.BROADCAST_ROWS, limit
        try:
            got = [(x["doc_id"], bytes(x["kept"]).decode()) for x in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        finally:
            suffix_dedup.BROADCAST_ROWS = suffix_dedup_limit
        assert len(got) == len(rows)
        # unique bytes stay, and of the six places of the shared string one stays whole, the copy of a row keeps what it keeps
        for i, t in rows:
            kept = [k for j, k in got if j == i and (k[:300] == (t or "")[:300])]
            assert kept, (i, t)
        assert len({(j, k) for j, k in got if shared in k}) == 1 and any(j is None and shared in k for j, k in got)


# 3


def plain_components(rows, n, percent):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i, t, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    lead = {i: i for i in sets}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                lead[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n,percent,chunk,few", [(3, 90, 250_000, 1_000_000), (5, 80, 250_000, 0), (3, 90, 300, 1_000_000)])
def test_jaccard_equals_all_pairs(spark, monkeypatch, n, percent, chunk, few):
    monkeypatch.setattr(jaccard, "BROADCAST_DOCS", few)
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", chunk)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame(spark), n, percent).collect()}
    assert got == plain_components(awkward(), n, percent)


def test_jaccard_awkward_tables(spark):
    assert jaccard.jaccard_components(empty(spark)).count() == 0
    row = awkward()[6]
    out = jaccard.jaccard_components(frame(spark, [row, row, (None, *row[1:])])).collect()
    assert sorted(str(r["component_id"]) for r in out) == ["6", "6", "None"]
    kept = jaccard.keep_first(frame(spark))
    assert kept.columns == frame(spark).columns and 7 not in {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("percent,hot", [(80, 0.0), (80, 0.5), (80, 1.0), (90, 0.6), (95, 0.2)])
def test_linked_sets_share_a_key(percent, hot):
    """Also sets with many empty parts and sets of hot tokens only."""
    r = np.random.default_rng(percent)
    levels = np.zeros(1 << jaccard.CELL_BITS, np.uint8)
    tokens = r.integers(0, 1 << 64, 4000, np.uint64)
    levels[jaccard.Heat.cell(tokens[: int(hot * len(tokens))])] = 200
    heat = jaccard.Heat(levels, 0)
    for size in [*range(2, 40), 100, 317, 1500]:
        for _ in range(6):
            a = np.unique(r.choice(tokens, size, replace=False))
            change = int(len(a) * (100 - percent) / (100 + percent))
            b = np.unique(np.r_[r.permutation(a)[change:], r.choice(tokens, change)])
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            held = defaultdict(set)
            for rows, key in jaccard.part_keys([a, b], percent, heat):
                for i, k in zip(rows.tolist(), key.tolist()):
                    held[i].add(k)
            assert held[0] & held[1], (size, change)


def test_jaccard_hot_passages_and_ids_of_two_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_DOCS", 2)
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", 400)
    r = np.random.default_rng(5)
    word = lambda: "w" + str(r.integers(10**9))
    passage, base = [word() for _ in range(60)], [word() for _ in range(80)]
    texts = [" ".join(passage + [word() for _ in range(k % 40)]) for k in range(60)]
    for k in range(30):
        copy = list(base)
        copy[int(r.integers(80))] = word()
        texts.append(" ".join(copy))
    rows = [(i, t, "en", "s", 0, "", "", "", "") for i, t in enumerate(texts)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.jaccard_components(frame(spark, rows), 5, 80).collect()}
    assert got == plain_components(rows, 5, 80)
    # rows of one id: each by its own text
    two = [(1, texts[70], *rows[0][2:]), (1, texts[0], *rows[0][2:]), (2, texts[71], *rows[0][2:]), (3, texts[3], *rows[0][2:])]
    assert sorted((x["doc_id"], x["component_id"]) for x in jaccard.jaccard_components(frame(spark, two), 5, 80).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted(x["text"] for x in jaccard.keep_first(frame(spark, two)).collect()) == sorted([texts[70], texts[0]])


def shifted(shift: int, pick) -> int | None:
    """A number of eight printable bytes that is so again when shift is added; pick chooses among a byte's values."""
    out, carry = 0, 0
    for k in range(8):
        s = (shift >> 8 * k) & 255
        good = [b for b in range(33, 127) if 33 <= (b + s + carry) & 255 < 127]
        if not good:
            return None
        b = pick(good)
        out |= b << 8 * k
        carry = (b + s + carry) >> 8
    return out


def old_pair() -> tuple[str, str]:
    """Two printable lines that sums of mixed eights with linear places cannot tell apart, whatever is added to all."""
    step = 0xA0761D6478BD642F * pow(0xE7037ED1A0B428DB, -1, 1 << 64)
    for d in range(1, 200):
        shift = step * d % (1 << 64)
        x, y = shifted(shift, min), shifted(shift, max)
        if x is not None and y is not None:
            fill = [int.from_bytes(b"a filler", "little")] * (d - 1)
            lines = [[(y + shift) % (1 << 64), *fill, x], [(x + shift) % (1 << 64), *fill, y]]
            return tuple(b"".join(e.to_bytes(8, "little") for e in line).decode() for line in lines)
    raise AssertionError("no pair")


def swapped_pair(key: int):
    """Two byte strings that the hash of a known key cannot tell apart."""
    places = hashing._of_places(key, 8)
    gap = int(places[2]) - int(places[1])
    a = [5, 77]
    b = [(a[1] + gap) % (1 << 64), (a[0] - gap) % (1 << 64)]
    return tuple(b"".join(x.to_bytes(8, "little") for x in y) for y in (a, b))


def test_span_hashes_depend_on_a_drawn_key():
    hashes = lambda pair, key, n: [span.tolist() for span in hashing.span_hashes(np.frombuffer(b"".join(pair), np.uint8), np.array([0, len(pair[0])]), np.array([len(pair[0]), 2 * len(pair[0])]), key, n)]
    known = swapped_pair(123)
    one, two = hashes(known, 123, 2)
    assert one[0] == one[1] and two[0] != two[1]  # made for the first stream of this key only
    for key in [hashing.draw() for _ in range(20)]:
        assert all(a != b for a, b in hashes(known, key, 2))
    assert len({hashing.draw() for _ in range(50)}) == 50


def test_lines_words_and_segments_of_old_collisions(spark):
    pair = old_pair()
    assert len(pair[0]) == len(pair[1]) and sum(a != b for a, b in zip(*pair)) > 10
    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1])], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, exact_chars=1).collect()} == {1: pair[0], 2: pair[1]}
    assert {r["component_id"] for r in jaccard.jaccard_components(docs).collect()} == {1, 2}
    # segments of one anchor: what the lines share stands before and behind what differs
    head = "the same words stand before both of the strings " * 2
    rows = [(1, head + pair[0] + head), (2, head + pair[1] + head)]
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_removal(rows)


def test_words_of_equal_polynomials_differ():
    """A word of 1,024 letters and its complement: polynomials modulo 2^64 take them for equal."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    sets = jaccard.shingle_sets(pa.array([a, b, a]), 3)
    assert sets[0][0] == sets[2][0] != sets[1][0]


def test_signature_tree_links_what_scan_links():
    r = np.random.default_rng(0)
    base = [np.sort(r.choice(2**40, 80, replace=False).astype(np.uint64)) for _ in range(4)]
    sets = []
    for b in base:
        for _ in range(8):
            s = b.copy()
            s[r.integers(0, 80, 3)] = r.integers(0, 2**40, 3).astype(np.uint64)
            sets.append(np.unique(s))
    links = jaccard.SignatureTree(sets, list(range(len(sets))), 90).join()
    want = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i < j and 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (len(sets[i]) + len(sets[j]) - k)}
    assert {tuple(sorted(x)) for x in links} <= want
    parts = lambda pairs: Counter(frozenset(x) for x in _groups(len(sets), pairs))
    assert parts(links) == parts(want)


def _groups(n, pairs):
    lead = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            lead[a] = lead[b] = min(lead[a], lead[b])
    out = defaultdict(set)
    for i, x in enumerate(lead):
        out[x].add(i)
    return out.values()


# 4


def labelled(n=400):
    rows, labels = [], []
    for i in range(n):
        good, toxic = i % 4 != 0, i % 7 == 0
        words = [f"w{(i * 13 + k * 7) % 90}" for k in range(40)] if good else ["%%% spam ###"] * 30
        rows.append((i, " ".join([*words, "vile" if toxic else "fine"]), "en", f"s{i % 5}", 0, "x", "y", "z", "w"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_quality_tells_held_out(spark):
    rows, labels = labelled()
    out = quality.classify(frame(spark, rows), spark.createDataFrame([x for x in labels if x[0] % 3], LABELS))
    wrong = sum(r["keep"] != (r["doc_id"] % 4 != 0 and r["doc_id"] % 7 != 0) for r in out.collect())
    assert wrong <= 4
    kept = quality.keep_good(frame(spark, rows), spark.createDataFrame(labels, LABELS))
    assert kept.columns == frame(spark, rows).columns


@pytest.mark.parametrize("sparse", [False, True])
def test_site_posteriors_equal_plain_ones(spark, sparse):
    """Also for hosts of one or two documents."""
    r = np.random.default_rng(11)
    sizes = [int(x) for x in (r.integers(1, 3, 150) if sparse else r.integers(20, 60, 12))]
    rows = [(f"h{h}", f"p{h}.{i % 3}", float(r.normal(h % 5 - 2, 1)), float(r.normal(-2, 1))) for h, n in enumerate(sizes) for i in range(n)]
    evidence = spark.createDataFrame(rows, "host string, path string, quality_logit double, toxic_logit double")
    sites = evidence.join(quality.site_posteriors(evidence), ["host", "path"])
    got = {(x["host"], x["path"], x["quality_logit"]): (x["q"], x["t"]) for x in sites.withColumns({k[0]: quality.leave_one_out(k, 1 / (1 + F.exp(-F.col(f"{k}_logit")))) for k in ("quality", "toxic")}).collect()}
    p = np.array([[1 / (1 + np.exp(-x)) for x in row[2:]] for row in rows])
    host, path = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])

    def strength(values, groups):
        n = np.array([(groups == g).sum() for g in np.unique(groups)])
        means = np.array([values[groups == g].mean() for g in np.unique(groups)])
        mean = values.mean()
        extra = (n * (means - mean) ** 2).sum() - (len(n) - 1) * mean * (1 - mean)
        variance = extra / max(n.sum() - (n**2).sum() / n.sum(), 1e-9)
        return float(np.clip(mean * (1 - mean) / variance - 1, *quality.STRENGTH)) if len(n) > 1 and variance > 1e-9 else quality.STRENGTH[1]

    for k in (0, 1):
        mean, top = (p[:, k].sum() + 0.5) / (len(p) + 1), strength(p[:, k], host)
        for i, row in enumerate(rows):
            of_host, of_path = host == row[0], path == row[1]
            s = strength(p[of_host, k], path[of_host])
            h = (p[of_host, k].sum() - p[i, k] + top * mean) / (of_host.sum() - 1 + top)
            want = (p[of_path, k].sum() - p[i, k] + s * h) / (of_path.sum() - 1 + s)
            assert got[row[:3]][k] == pytest.approx(want, rel=1e-6)


def test_quality_without_labels_keeps(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.keep_good(frame(spark), none).count() == len(awkward())
    assert quality.classify(empty(spark), none).count() == 0


# 5


def test_extract_held_out_and_awkward(spark):
    model = extract.fit_model(300)
    exact = 0
    for seed in range(60):
        page = extract.Page(7_000_000 + seed).html()
        marked = extract.Tree(page)
        want = "\n".join(t.replace(extract.Page.MARK, "") for _, t in marked.blocks if extract.Page.MARK in t)
        tree = extract.Tree(page.replace(extract.Page.MARK, ""))
        exact += tree.main_text(model.logit(tree.features())) == want
    assert exact >= 42
    html = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>A &amp; b</h1><p>First   text, long enough to stand.<p>Second &eacute; text<br>here, and more of it.</article><footer>&copy; foot</footer>"
    pages = [(1, "u", html), (2, None, None), (3, "u", ""), (4, "u", "<"), (5, "u", "<script>x"), (None, "u", "<p" * 50), (1, "u", html)]
    got = extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()
    texts = sorted(r["text"] for r in got if r["page_id"] == 1)
    assert texts == ["A & b\nFirst text, long enough to stand.\nSecond é text here, and more of it."] * 2
    assert all(r["text"] == "" for r in got if r["page_id"] in (2, 3, 5)) and len(got) == 7


def test_extract_scripts_and_long_values():
    texts = lambda html: [t for _, t in extract.Tree(html).blocks]
    page = "<script>for(i=0;i<n;i++){ /* don't */ }</script><p>Real text isn't here.</p><p>Next.</p>"
    assert texts(page) == ["Real text isn't here.", "Next."] and extract.Tree(page).tag == ["html", "p", "p"]
    for q in "'\"":
        held = "<p>no text</p> > " * 1000
        assert texts(f"<div data-props={q}{held}{q}><p>Inner text.</p></div>") == ["Inner text."]
    assert texts("<p class=don't>one</p><p title='a>b' id = \"c>d\">two</p><p x=>three</p>") == ["one", "two", "three"]
    assert texts("<p title='open>one</p><p>two</p>") == ["one", "two"]


def test_extract_time_is_linear():
    n = 100_000
    for broken in ("<a x='>'", "<a", "<a x=", "</a", "<!a", "<a x=\"'>'", "<a '", "<script></script", "<script></script x>"):
        started = time.process_time()
        for html in (broken * n, broken * n + "\"", "<a x='" + broken * n):
            markup, at = extract.Markup(html), 0
            while found := markup.next(at):
                at = found[1]
        assert time.process_time() - started < 20, broken


def test_extract_choice_is_consistent():
    tree = extract.Tree("<div><nav><p>a</p><p>b</p></nav><article><p>c</p></article></div>")
    chosen = tree.decode(np.random.default_rng(0).normal(size=len(tree.tag)) * 3)
    assert all(not c or p < 0 or chosen[p] for c, p in zip(chosen, tree.parent))


# 6


def test_top_k_equals_scan(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)]
    rows += [(i + 1000, rows[0][1]) for i in range(20)] + [(2000, None), (2001, [float("nan")] * 8), (2002, [None] * 8), (2003, [1.0]), (2004, []), (None, [1.0] * 8)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    out = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, shard_rows=64)
    got = {(q, k): (v, s) for q, k, v, s in map(tuple, out.collect())}
    ints = {i: np.array([int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (8 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in ints if i % 50 == 0):
        best = sorted(((-int(ints[q] @ ints[v]), v) for v in ints if v != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(v, -s) for s, v in best]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_of_many_ties_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "RESCORED", 100)
    rows = [(i, [1.0, -2.0, 0.5], "x", 3) for i in range(200)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, score int"))
    out = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, shard_rows=64).collect()
    want = 256 * 256 * 1 + 512 * 512 + 128 * 128
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out} == {(q, k + 1, v, want) for q in (0, 50, 100, 150) for k, v in enumerate([x for x in range(6) if x != q][:5])}


# 7


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "\\<|end|>\n", "<|turn|>user\nx<|end|>\n", None, "", "a" * 4000, "é☃"]
    rows = [(c, t, ["system", "user", "assistant"][min(t, 1) + t % 2 if c else (t + 1) % 3], tricky[(t + c) % len(tricky)]) for c in range(4) for t in range(40)]
    rows += [(None, None, None, "x"), (9, 0, "assistant", "same"), (9, 0, "assistant", "same"), (10, 0, "odd\nrole", "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    windows = chat_format.format_windows(turns, budget=60, history_turns=3, history_tokens=20)
    got = {r["conv_id"]: r for r in chat_format.read_back(windows).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0], r[1] or "", r[2] or ""))
        said = "".join(t or "" for _, role, t in own if role == "assistant")
        digest = sha("".join(f"{role or ''}\n{t or ''}\n" for _, role, t in own))
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), digest, len(said), sha(said))
    for w in windows.collect():
        assert w["tokens"] <= 60 or w["turns"] == 1
    assert chat_format.count_tokens([("user", "two words")]) == [len(packing.encoder(None).tokenizer.encode("<|turn|>user\ntwo words<|end|>\n", add_special_tokens=False).ids)]
    assert chat_format.read_back(chat_format.format_windows(turns.limit(0))).count() == 0


def test_no_control_string_survives_escaping():
    for text in chat_format.CONTROL:
        assert text not in chat_format.escape(f"a{text}b") and chat_format.unescape(chat_format.escape(text)) == text


# 8


def test_pii_base_equals_regex(spark):
    texts = ["a@b.c.d,x%y@z-1.org.", "@@ a@b a@.c", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4539 1488-0343 6467 4111111111111111x 123", "+1 (415) 555-0199 +12 +3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "é☃ +44 20 7946 0958 q@é.de ☃@x.y", None, "", "1" * 5000, "a" * 5000 + "@"]
    texts += ["".join(f"é{k % 7}.{k % 300}.0.1 x{k}@y.zz +44 20 7946 0{k % 10}58 ☃" for k in range(n)) for n in (pii.CHUNK - 1, pii.CHUNK, 3 * pii.CHUNK + 1)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.cd"), (1, texts[1])]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").withColumn("email", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, v):
        d = [int(c) for c in re.sub("[^0-9]", "", v)]
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        want = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, text) if valid(k, m[0])]
        assert [tuple(s) for s in r["base"]] == want


def test_pii_ip_with_zero_parts(spark):
    texts = ["10.0.0.1", "0.0.0.0", "00.1.2.3", "192.168.000.007", "1.2.3.0", "256.0.0.1", "0.0.0.256", "1.2.3.000300"]
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: [("ip", 0, len(t))] if i < 5 else [] for i, t in enumerate(texts)}


def test_pii_contexts_of_any_seed_and_candidate(spark):
    letters = [a + b for a in "abcd" for b in "efgh"]
    kinds = {
        "my mail is ": [f"{x}.doe@example.org" for x in letters],
        "you may call ": [f"+44 20 7946 09{k}" for k in range(10, 26)],
        "our longest is ": [f"{x * 40}@example.org" for x in letters],
        "the account was ": ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "4012 8888 8888 1881", "3056 9309 0259 04", "6011 1111 1111 1117"],
    }
    new = ["john-smith_q", "4111 1111 1111 1112", "k" * 70 + "7", "a1", "jSmith"]
    rows = [(len(v), f"so {c}{v} then") for c, values in kinds.items() for v in values]
    rows += [(-k, f"so {c}{v} then") for c in kinds for k, v in enumerate(new, 1)] + [(-9, "so my mail is broken then")]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.struct("doc_id", "text"))).collect()
    for r in got:
        i, text = r["doc_id"]
        want = []
        if -9 < i < 0:
            at = text.index(new[-i - 1])
            want = [("ctx", at, at + len(new[-i - 1]))]
        assert [tuple(s) for s in r["added"]] == want, text


def test_pii_very_long_text(spark):
    text = "1.2.3.4 é " * 40_000
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(s) for s in got[0]["base"]] == [("ip", 10 * k, 10 * k + 7) for k in range(40_000)]


@pytest.mark.parametrize("known, least, most", [(40, 0.9, 1.0), (4, 0.0, 0.0)])
def test_pii_recall_of_planted_identifiers(spark, known, least, most):
    """A pattern is believed where most of its distinct instances are seeds, and not where they are few among others."""
    leads = ["write to the owner at ", "please call again on ", "was logged in from "]
    seeds = [lambda k: f"user{k}@mail.org", lambda k: f"+44 20 7946 {1000 + k}", lambda k: f"10.0.{k}.7"]
    rows = [(k, f"we {lead}{seed(k)} today") for lead, seed in zip(leads, seeds) for k in range(known)]
    planted = {1000 + 100 * i + k: f"id-{i}{k:03d}-x{k}" for i in range(3) for k in range(10)}
    rows += [(d, f"we {leads[(d - 1000) // 100]}{v} today") for d, v in planted.items()]
    clean = [(2000 + k, f"we sold {k}00 pieces of item n{k}-b in the shop {k}") for k in range(200)]
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["added"]] for r in pii.find_pii(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    at = {d: t.index(planted[d]) for d, t in rows if d in planted}
    caught = sum((at[d], at[d] + len(v)) in found[d] for d, v in planted.items())
    assert least <= caught / len(planted) <= most and not any(found[d] for d, _ in clean)


def test_pii_contexts_discover(spark):
    rows = [(i, f"please write to box {i}@mail.org soon") for i in range(12)] + [(20, "please write to box a1b2c3-77 soon"), (21, "we sold 123456 pieces of it"), (22, "we sold 223456 pieces of it")]
    found = {r["doc_id"]: r["added"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[20]] == [("ctx", 20, 29)]
    assert not found[21] and not found[0]
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_within():
    r = np.random.default_rng(4)
    for _ in range(600):
        a = "".join(r.choice(list("ab☃"), r.integers(0, 9)))
        b = "".join(r.choice(list("ab☃"), r.integers(0, 9)))
        for t in (0, 1, 2, 3):
            assert line_dedup.within(a, b, t) == (distance(a, b) <= t), (a, b, t)


@pytest.mark.parametrize("few", [True, False])
def test_line_dedup_equals_all_pairs(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    r = np.random.default_rng(5)
    lines = ["".join(r.choice(list("abcdefg "), 30)) for _ in range(20)]
    docs = []
    for i in range(30):
        own = []
        for k in r.integers(0, 20, 4):
            s = list(lines[k])
            for _ in range(r.integers(0, 3)):
                at = r.integers(0, len(s))
                s[at : at + r.integers(0, 2)] = list(r.choice(["x", "yz", ""]))
            own.append("".join(s))
        docs.append((i, "\n".join([*own, "short"]), "en", "s", 0, "x", "y", "z", "w"))
    rows = docs + [(i + 100, *x[1:]) for i, *x in [(y[0], None, *y[1:]) for y in awkward()]]
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(frame(spark, rows), 2, 20).collect()}
    first = {}
    for i, t, *_ in sorted(rows, key=lambda x: x[0]):
        for k, line in enumerate((t or "").split("\n")):
            if len(line) >= 20:
                first.setdefault(line, (i, k))
    kinds = list(first)
    groups = _groups(len(kinds), [(a, b) for a in range(len(kinds)) for b in range(a) if abs(len(kinds[a]) - len(kinds[b])) <= 2 and sum(((c := Counter(kinds[a])) - (d := Counter(kinds[b]))).values()) + sum((d - c).values()) <= 4 and distance(kinds[a], kinds[b]) <= 2])
    lead = {kinds[k]: min(first[kinds[x]] for x in g) for g in groups for k in g}
    for i, t, *_ in rows:
        want = t and "\n".join(x for k, x in enumerate(t.split("\n")) if len(x) < 20 or lead[x] == (i, k))
        assert got[i] == want, i


def test_line_dedup_tells_equal_polynomials(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    rows = [(i, t, "en", "s", 0, "x", "y", "z", "w") for i, t in enumerate([a, b, a])]
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()} == {0: a, 1: b, 2: ""}


def test_line_dedup_lists_no_pairs_of_a_group(spark):
    """Variants of one line meet their lead, not each other."""
    base = "a line that stands in hundreds of documents, each time with an edit of its own"
    rows = [(k, base[: k % 70] + chr(97 + k % 26) + base[k % 70 + 1 :] + f"\nown line of {k} " + "xyzw"[k % 4] * 20, "en", "s", 0, "x", "y", "z", "w") for k in range(300)]
    docs = frame(spark, rows).select(F.col("doc_id").alias("doc"), "text")
    assert line_dedup.near_links(docs).count() <= 12 * 300
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert sum(base[-8:] in r["text"].split("\n")[0] for r in got) == 1


def test_line_dedup_short_lines(spark):
    long = "a line of more than twenty characters"
    texts = [f"Short.\n\n{long}\nx", f"Short.\n\n{long}\nx", "Short.\nShort!\nx\ny", "\n\n", "x\n \n\u2003"]
    rows = [(i, t, "en", "s", 0, "x", "y", "z", "w") for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(frame(spark, rows), exact_chars=1).collect()}
    assert got == {0: (texts[0], 0), 1: ("", 3), 2: ("Short!\ny", 2), 3: ("\n\n", 0), 4: (" \n\u2003", 1)}
    assert {r["doc_id"] for r in line_dedup.clean_lines(frame(spark, rows)).collect()} == {0, 2, 3}


def test_line_dedup_awkward_tables(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    out = line_dedup.clean_lines(frame(spark))
    assert out.columns == frame(spark).columns
    left = {r["doc_id"] for r in out.collect()}
    assert 6 in left and 7 not in left and {0, 1, 2, 3, 4, 5} <= left


# 10


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = [*awkward(), (500, "a <|endoftext|> b", *awkward()[0][2:]), (None, "null id", *awkward()[0][2:])]
    out = [r.asDict() for r in packing.pack_documents(frame(spark, rows), window=64).collect()]
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted((p for p in out if p["doc_id"] == i), key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids)) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    filled = defaultdict(int)
    for p in sorted(out, key=lambda p: (p["sequence_id"], p["offset"])):
        assert filled[p["sequence_id"]] == p["offset"]
        filled[p["sequence_id"]] += p["length"]
    assert max(filled.values()) <= 64 and sum(filled.values()) >= 0.9 * 64 * len(filled)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_plan_uses_every_length_once():
    r = np.random.default_rng(6)
    counts = Counter(int(x) for x in r.integers(1, 129, 5000))
    used = Counter()
    for pattern, times in packing.make_plan(dict(counts), 128):
        assert sum(pattern) <= 128 and times > 0
        for k in pattern:
            used[k] += times
    assert used == counts
