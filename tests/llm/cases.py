"""A small corpus with the awkward cases, and plain reference forms of the operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th long, cls long, key long, a long, u long, score double, text_ string, rest string"


def corpus(seed: int = 5, n: int = 40) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, clashing columns): nulls, blanks, copies, near copies, shared passages, a long text, repeated rows and ids."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "naïve", "été", "A"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(60)
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (6, "One two"), (7, text(3000)), (8, "a a a a a a a a a a " * 60), (9, "a a a a a a a a a a " * 60), (None, text(30)), (None, None)]
    base = text(120)
    out += [(20, base), (21, base), (22, base.upper()), (23, base + " tail"), (20, base), (24, text(200)), (24, "other text under the same id")]
    for i in range(n):
        body = text(rng.randint(5, 150))
        if i % 4 == 0:
            body = f"{body}\n{passage} {text(10)}"
        if i % 5 == 0:
            words = base.split()
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            body = " ".join(words)
        out.append((100 + i, body))
    rng.shuffle(out)
    extra = lambda i: (i, None, 7, i, None, 3, 0.5, "clash", None)
    return [(d, t, None if i % 7 == 0 else "en", None if i % 9 == 0 else "s", None if t is None else len(t), *extra(i)) for i, (d, t) in enumerate(out)]


def words(t: str | None) -> list[str]:
    return WORD.findall(t or "")


def components(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in links:
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
