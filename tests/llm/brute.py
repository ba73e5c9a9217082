"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from math import floor

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return SPACE_WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeated(units, window):
    """For each sequence, which units lie in a window that stands at two places or more."""
    count = Counter(tuple(u[p : p + window]) for u in units for p in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for p in range(len(u) - window + 1):
            if count[tuple(u[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out.append(gone)
    return out


def cut_words(texts, window):
    """(n_words, n_removed, kept words) of each text."""
    lists = [words(t) for t in texts]
    return [(len(w), sum(g), [x for x, lost in zip(w, g) if not lost]) for w, g in zip(lists, repeated(lists, window))]


def cut_bytes(texts, window):
    out = []
    raw = [(t or "").encode() for t in texts]
    for b, g in zip(raw, repeated(raw, window)):
        spans = sum(g[i] and (i == 0 or not g[i - 1]) for i in range(len(g)))
        kept = bytes(x for x, lost in zip(b, g) if not lost)
        out.append((len(b), sum(g), spans, sha(kept)))
    return out


def shingle_set(text, k=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_components(docs):
    """{doc_id: (set size, component)} of unique doc_ids."""
    sets = {i: shingle_set(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    common = Counter((b, a) for own in holders.values() for n, a in enumerate(sorted(own, reverse=True)) for b in sorted(own, reverse=True)[n + 1 :])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """{source: target}, by capping one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if epochs * sizes[s] < level * weight[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: float(epochs * sizes[s]) for s in over}
        left -= sum(epochs * sizes[s] for s in over)
        free -= over
    return out


def pieces(word, vocabulary):
    """Best segmentation of one marked word by trying every last piece; the longest of equal ones."""
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        options = []
        for begin in range(end):
            if hit := vocabulary.pieces.get(word[begin:end]):
                options.append((best[begin][0] + hit[1], end - begin, best[begin][1] + [hit[0]]))
        raw = word[end - 1].encode()
        by_bytes = (best[end - 1][0] + vocabulary.byte_score * len(raw), 0, best[end - 1][1] + [vocabulary.byte_ids[b] for b in raw])
        top = max([*options, by_bytes], key=lambda o: o[:2])
        best.append((top[0], top[2]))
    return best[-1][1]


def encode(text, vocabulary):
    marked = re.findall(r"\n| *[^ \n]+| +", " " + text) if text else []
    return [i for w in marked for i in pieces(w, vocabulary)]


def whole(target, size):
    return floor(target / size) if size else 0
