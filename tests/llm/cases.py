"""Small documents with nulls, empty and long texts, ties, repeated rows, and an extra column with a clashing name."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, kept boolean, digest string, n double"


def base(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "Th", "on", "re", "é", "st", "ou", "."]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(50))
    texts = []
    for k in range(n):
        body = [word() for _ in range(rng.randint(0, 120))]
        if k % 7 == 3:
            body[len(body) // 2 : len(body) // 2] = passage.split()
        texts.append(" ".join(body))
    for k in range(5):
        near = texts[10 * k].split()
        texts.append("\n".join(near))
        if near:
            near[-1] = "changed"
        texts.append(" ".join(near))
    texts += ["", "  \n\t ", None, "one two", "ONE two", "one  two", "a " * 400, " ".join(word() for _ in range(9000)), "x <|endoftext|> y", "$$$ ### %%%" * 9]
    rows = [(k, t, ["en", "fr", None][k % 3], ["s0", "s1", "s2", None][min(3, k % 7)], 0, 1, False, "x", 1.0) for k, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "no id at all here", "en", "s0", 0, 1, True, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
