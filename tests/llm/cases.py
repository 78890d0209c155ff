"""Documents of every awkward kind, for all operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, keep string, n_lines string, row string"


def awkward(seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    texts = [None, "", " ", "\n\n", "one", "one two", base, base, base, base.replace(" ", "  ", 1)]
    for k in range(6):
        w = base.split()
        w[7 * k + 3] = f"new{k}"
        texts.append(" ".join(w))
    texts += [prose(30) + " " + passage + " " + prose(30) for _ in range(5)]
    texts += ["a" * 3000, "ab " * 700, "é ß ☃ " * 60 + prose(20), prose(4000)]
    texts += ["\n".join([prose(10), "this line stands in several documents as it is", prose(9)]) for _ in range(4)]
    texts += ["\n".join([prose(10), "this line stands in several documents as it was", prose(9)])]
    return [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", None]), len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]


def frame(spark, rows=None, parts: int = 3):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(parts)
