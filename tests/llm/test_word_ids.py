"""Words that are encoded as one text have the ids that each has by itself."""

import random

import numpy as np

from priceweave.llm import packing


def test_words_learnt_together_have_their_own_ids():
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCéñßøжλ"
    words = {" " + "".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(6000)}
    words |= {"abc", " ", "  ", " 12", "'s", " ...", "\n", " 漢字", " á", " ǅ", "é", " ªº"}
    e = packing.Encoder(packing.encoder(None).tokenizer_path, packing.encoder(None).pattern)
    calls = []
    each = e._ids
    e._ids = lambda texts: calls.extend(texts) or each(texts)
    texts = ["".join(w) for w in ([*words][i : i + 50] for i in range(0, len(words), 50))]
    got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
    assert got == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    # single words are few
    assert len(calls) < 200
