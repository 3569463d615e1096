"""Spelling variants against a plain version, and the rules for words one by one."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import pytest
from brute import LOWER
from claimloom.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in spelling.LETTERS.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else 0) for w in counts)


def collected(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_hard_rows(documents):
    rows = [(1, "colour " * 200 + "color " * 30 + "colors " * 6 + "Colours " * 6), (None, "colour, COLOUR; naïveté " * 9), (None, None), (2, ""), (2, "x")]
    rows += [(2, "naivete naïvetés ÀÉÎÕÜ×÷ÿ àéîõüÿ ")] * 7
    rows += [(3, "abcdef bcdefg abcdefg zabcdef abcdeg abcdf xbcdef aabcdef abcdeff " * 6), (4, "aaaaaa aaaaaaa aaaaaaaa baaaaa aaaaab " * 5)]
    rows += [(5, ("q" * 40 + " " + "q" * 39 + "r ") * 5 + ("q" * 20 + "x" + "q" * 20 + " ") * 5)]
    assert collected(spelling.spelling(documents(rows))) == plain(rows)


@pytest.mark.parametrize("letters", ["ab", "abcñ"])
def test_dense_words_against_every_pair(documents, letters):
    """Nearly all short words over a few letters, so that every kind of edit and tie occurs."""
    from itertools import product

    words = ["".join(p) for p in product(letters, repeat=6)][::3] + ["".join(p) for p in product("ab", repeat=7)][::2]
    rows = [(k, " ".join(words[k % 4 :: 4] * (k % 9 + 1))) for k in range(12)]
    assert collected(spelling.spelling(documents(rows))) == plain(rows)


def test_roots_follow_long_chains(documents):
    """Each word is one letter from the next, which is five times as frequent."""
    words = ["planet", "planets", "planeta", "plaketa", "plakete"]
    rows = [(k, " ".join([w] * 5 ** (6 - i))) for k, (i, w) in enumerate(enumerate(words))]
    found = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling(documents(rows)).collect()}
    assert {w: (r or None, t) for w, r, t, *_ in plain(rows)} == found
    assert found["plakete"][1] != found["plakete"][0]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "too few words of this")]])
def test_no_words(documents, rows):
    assert collected(spelling.spelling(documents(rows))) == []


def test_counts_do_not_depend_on_partitions(documents, monkeypatch):
    monkeypatch.setattr(spelling, "KEPT_WORDS", 3)
    rows = [(k, "several different wordings occurring everywhere " * (k + 1)) for k in range(20)]
    df = documents(rows)
    assert sorted(spelling.count_words(df.repartition(9)).collect()) == sorted(spelling.count_words(df.coalesce(1)).collect())
