"""Plain versions that the operators are compared with."""

import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def likeness(a, b):
    """Generalised Jaccard similarity of word counts."""
    a, b = Counter(words(a)), Counter(words(b))
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def dedup_lines(rows):
    """Cut texts of (doc_id, text) with distinct ids, in the order of the ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        line = (text or "").split("\n")
        gone = set()
        for k in range(len(line) - 2):
            w = tuple(line[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(line) if k not in gone) if gone else text
    return out


def components(rows):
    """Smallest id by id, of (doc_id, text)."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def leaks(docs, items, share=0.75):
    kept = {k: shingles(t) for k, t in items if shingles(t)}
    return {(i, k) for i, t in docs for k, s in kept.items() if len(s & shingles(t)) >= share * len(s)}
