"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def terms(text) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


def contamination(docs, items, size=10):
    """(doc_id, n_words, n_hit, n_items, digest, contaminated) of (doc_id, text) rows."""
    windows = {}
    for item, text in items:
        w = terms(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = terms(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (phrase := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[phrase]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def repeated_bytes(docs, depth=100):
    """doc_id: (n_bytes, n_removed, n_spans, digest), documents in order of doc_id."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - depth + 1):
            if data[i : i + depth] in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(data[i : i + depth])
        spans = sum(1 for i in range(len(data)) if gone[i] and not (i and gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g)))
    return out


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near(docs, size, percent=80):
    """doc_id: (n_shingles, component)."""
    sets = {doc: shingles(text, size) for doc, text in docs}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {doc: (len(sets[doc]), find(doc)) for doc in sets}


def repeated_lines(docs, least):
    """doc_id: (n_lines, n_removed, text left)."""
    texts = [(doc, text.split("\n")) for doc, text in sorted(docs)]
    places, out = {}, {}
    for k, (_, lines) in enumerate(texts):
        for i, line in enumerate(lines):
            places.setdefault(line, []).append((k, i))
    for k, (doc, lines) in enumerate(texts):
        gone = [False] * len(lines)
        for i in range(len(lines)):
            for k2, i2 in places[lines[i]]:
                if (k2, i2) >= (k, i):
                    break
                other, n = texts[k2][1], 0
                while i + n < len(lines) and i2 + n < len(other) and lines[i + n] == other[i2 + n]:
                    n += 1
                if sum(len(x.split()) for x in lines[i : i + n]) >= least:
                    gone[i : i + n] = [True] * n
        out[doc] = (len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g))
    return out
