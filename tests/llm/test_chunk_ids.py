"""Chunks of texts end where the vocabulary's pattern splits, and keep their ids whatever stands beside them."""

import random

import numpy as np
import pyarrow as pa

from priceweave.llm import packing

PARTS = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "\x1c", "\x85", " ", "　", " ", "a", "Bc", "don't", "'s", "'", "'ll", "é", "жи", "漢字", "12", "3.14", ",", ".", "!", ")", "(", "-", "—", "“", "<|endoftext|>", "<|endoftext", "|>", "×", "ª", "́", "‍", "\x00", "_", " " + "x" * 70, "漢" * 80, "a" * 40 + "é" * 40]


def test_ids_of_any_texts():
    r = random.Random(5)
    e = packing.Encoder(packing.encoder(None).tokenizer_path, packing.encoder(None).pattern)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["", "  ", "a "]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 300):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts[at : at + 300])] == want[at : at + 300]


def test_a_null_text_has_no_ids():
    data, at = packing.encoder(None).encode_column(pa.array(["a b", None, "", "c"]))
    assert np.diff(at).tolist() == [8, 0, 0, 4] and len(data) == 12


def test_marks_and_lines_do_not_make_new_chunks():
    """A known word is not encoded again beside another mark, at the end of a line or in another text, and no text is split
    word by word."""
    e = packing.Encoder(packing.encoder(None).tokenizer_path, packing.encoder(None).pattern)
    learnt, learn = [], e._learn
    e._learn = lambda chunks: learnt.extend(chunks) or learn(chunks)
    e.words = lambda text: 1 / 0
    e.encode(["one two, three.\nfour (five) six"])
    learnt.clear()
    e.encode([" two! three: five; one, six) two,\nfour three", " six. three two"])
    assert not {" two", " three", " six", "four"} & set(learnt)


def test_words_in_use_survive_a_full_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 100)
    e = packing.Encoder(packing.encoder(None).tokenizer_path, packing.encoder(None).pattern)
    learnt, learn = [], e._learn
    e._learn = lambda chunks: learnt.extend(chunks) or learn(chunks)
    for i in range(40):
        e.encode(["x common" + "".join(f" w{i}n{k}" for k in range(20))])
        assert len(e.cache) + len(e.before) <= 150
    assert learnt.count(" common") == 1
