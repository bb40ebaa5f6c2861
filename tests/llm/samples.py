from __future__ import annotations

import random

#: Columns besides the four of documents clash with names that operators use inside.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, uid string, size string, id string, bucket int, row string, shard int"


def word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6)))


def prose(rng: random.Random, n: int) -> str:
    return "".join(word(rng) + rng.choice([" ", " ", " ", "\n", "  ", ".\t"]) for _ in range(n))


def messy_rows() -> list[tuple]:
    """Nulls, empty, blank, long and repeated texts, near copies, ties, null and repeated ids."""
    rng = random.Random(5)
    base = prose(rng, 150)
    shared = prose(rng, 60)
    words = base.split()
    texts = [base, base, base + " tail", " ".join([*words[:70], "changed", *words[71:]]), None, "", " \n\t ", "one", "One two", prose(rng, 40) + shared + prose(rng, 30), prose(rng, 25) + shared, shared + prose(rng, 35)]
    texts += [prose(rng, rng.randint(1, 120)) for _ in range(40)] + [prose(rng, 6000), "x" * 5000, "la " * 400, "Ab\x0bcd\x0c ef\x85gh ij"]
    sources = ["s1", "s2", None, "s10", "é"]
    rows = [(i, t, "en", sources[0 if i % 3 == 0 else i % 5], len(t or ""), "u", "z", "i", 1, "r", 2) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, base, None, None, None, None, None, None, None, None, None), (None, "null id text of its own", None, "s2", 3, None, None, None, None, None, None), (3, "same id, other text", "en", "s1", 1, "", "", "", 0, "", 0)]
