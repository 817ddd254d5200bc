"""Brute-force versions of the operators, over small lists of rows."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b).hexdigest()
BIG = 1 << 62


def order(d):
    return BIG if d is None else d


def substring_words(rows, width=13):
    """rows: (doc_id, text)"""
    first = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, BIG + 1), order(d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < order(d):
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), sha(" ".join(kept).encode())))
    return out


def repeated_bytes(rows, length=100):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - length + 1):
            k = t[i : i + length]
            if order(d) < first.get(k, BIG + 1):
                first[k] = order(d)
    out = []
    for d, t in texts:
        gone, seen, until = bytearray(len(t)), set(), 0
        for i in range(len(t) - length + 1):
            k = t[i : i + length]
            if first[k] < order(d) or k in seen:
                gone[max(i, until) : i + length] = b"\1" * (i + length - max(i, until))
                until = i + length
            seen.add(k)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(t), sum(gone), runs, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def jaccard(rows, width=4, percent=85):
    sets = []
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    lists = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        count = {}
        for x in s:
            for j in lists[x]:
                if j < i:
                    count[j] = count.get(j, 0) + 1
        for j, c in count.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), BIG + 1), order(d))
    return [(d, len(sets[i]), None if least[root(i)] == BIG else least[root(i)]) for i, (d, _) in enumerate(rows)]
