"""Rows with every awkward case, and brute force, for the tests of this folder."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)] + ["the", "of", "and", "Ärger", "ÉTÉ", "x,", "idiot"]


def rows():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base, passage = text(200), text(90)
    out = [None, "", " \n\t ", "one", "a b c d", "A b C d", base, base, base.replace("w1 ", "w2 "), base + " tail", passage, text(50) + " " + passage + text(60), passage + "\n" + text(30), "na " * 900, ("x" * 900), text(3000)]
    out += [text(rng.randint(1, 120)) for _ in range(40)] + [f"{text(8)}.\nline\nline\n{text(3)}" for _ in range(4)]
    out = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", "ä", None]), len(t or "")) for i, t in enumerate(out)]
    return [*out, (None, base, None, None, 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3)]


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def shingles(t):
    w = low(t).split()
    w = split(low(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_force(items):
    """{id: smallest id reachable} over [(id, set)]."""
    up = {i: i for i, _ in items}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, x) in enumerate(items):
        for j, y in items[:k]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in up}


def targets_by_force(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(size.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        above = {s for s in free if unit * weight[s] > 2 * size[s]}
        if not above:
            return out | {s: unit * weight[s] for s in free}
        out |= {s: 2.0 * size[s] for s in above}
        left -= sum(2.0 * size[s] for s in above)
        free -= above
    return out


def spans_by_force(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = np.frombuffer(b, "u1")[~gone].tobytes()
        out.append((int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out
