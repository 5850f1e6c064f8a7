"""Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

SCHEMA = "doc_id long, text string, n long, h string, key string, fp long, keep_id long, u long, bad_id long"


def documents(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [say(rng.randint(1, 200)) for _ in range(25)]
    texts = [None, "", " \t\n", "a", "a b", "A  B", "x" * 3000, "the same \n line\n" * 40, say(6000), "\x0b\x0c tab\there", "日本 語 \U0001f600 ok"]
    texts += base + base[:6] + [b.replace(" ", "  ", 3) for b in base[:4]]
    texts += [" ".join(w if rng.random() > 0.03 else "zz" for w in b.split()) for b in base for _ in range(2)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[0], rows[3], (None, "a b"), (None, None)]
    return [(i, t, 1, "h", "k", 5, 6, 7, 8) for i, t in rows]
