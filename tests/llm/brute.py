"""Plain-Python versions of what the operators return."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(texts, window):
    """(n words, n removed, sha256 of what stays) of each text."""
    words = [SPACE.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, n=5):
    w = SPACE.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(docs, n=5, percent=75):
    """{id: (n shingles, least id of its component)} of (id, text) with different ids."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def phrases(text, base):
    w = ALNUM.findall((text or "").translate(LOWER))
    found = [(j, label) for p, label in base.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
    return len(w), len(found), min((j for j, _ in found), default=None), max((j for j, _ in found), default=None), ",".join(sorted({x for _, x in found}))
