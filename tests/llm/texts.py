"""Small tables of awkward rows for the operators on documents."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rnd: random.Random, words: int) -> str:
    parts = ["on", "thi", "er", "é", "ü", "st", "a", "or", "Nd", "'s", "ß", "12", "x."]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(words))


def awkward(seed: int = 0) -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, repeated rows and shared passages."""
    rnd = random.Random(seed)
    base, passage = sentence(rnd, 120), sentence(rnd, 70)
    texts = [None, "", " \t\n", "one", "one two three four", "One two THREE four", base, base.upper()]
    for i in range(12):
        words = base.split()
        words[7 * i % 120] = f"edit{i}"
        texts.append(" ".join(words))
    texts += [f"{sentence(rnd, 30)}\n{passage}\n{sentence(rnd, 30)}" for _ in range(8)]
    texts += [sentence(rnd, rnd.randint(1, 60)) for _ in range(30)]
    texts += ["ab " * 400, "z" * 900, "z" * 450 + "y" + "z" * 450, sentence(rnd, 6000), "a" * 100 + "'s" * 20]
    texts += ["中文字" * 90, "<|endoftext|> x <|startoftext|>", "é İ ſ Σ", "0\x00\x1c\x85 ​_Ⅷª"]
    rows = [(i * 7 % 101, t, "en", ["s1", "s2", None, "sé"][i % 4 if i % 3 else 0], None) for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], rows[6], (None, base, None, None, 1), (None, None, None, None, None), (rows[3][0], "other text", "", "", 0)]
