from __future__ import annotations

import random

import pytest

from brute import near
from claimloom.llm import sketches


def check(documents, rows, size=4):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sketches.near_duplicates(documents(rows), size).collect()}
    assert got == near(rows, size)


def corpus(seed, n, edits, passage=0):
    rng = random.Random(seed)
    common = " ".join(f"c{i}" for i in range(passage))
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, 90))] for _ in range(n // 4)]
    rows = []
    for d in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((d, " ".join(words) + (" " + common if rng.random() < 0.5 else "")))
    return rows


def test_against_plain_version(documents):
    rows = corpus(1, 160, 3) + [(500, None), (501, ""), (502, " \t"), (503, "One"), (504, "one"), (505, "a b c"), (506, "A B C"), (507, "a b c d")]
    check(documents, rows)
    check(documents, rows, 5)


def test_long_lists(documents, monkeypatch):
    monkeypatch.setattr(sketches, "SHORT_LIST", 3)
    check(documents, corpus(2, 140, 2, passage=12))
    check(documents, [(i, " ".join([f"x{i % 3}", *"abcdefgh"])) for i in range(40)])


def test_one_large_group(documents):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = [(d, " ".join(w if rng.random() > 0.004 else f"n{rng.randrange(999)}" for w in base)) for d in range(150)]
    check(documents, rows)


def test_copies_null_ids_and_removal(documents):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (None, None), (9, "x y z u v w"), (None, "q r s t")]
    got = sorted((tuple(r) for r in sketches.near_duplicates(documents(rows), 4).collect()), key=repr)
    assert got == sorted(
        [(5, 3, 2, False), (5, 3, 2, False), (None, 3, 2, False), (2, 3, 2, True), (None, 0, None, True), (9, 3, 9, True), (None, 1, None, True)], key=repr
    )
    assert sketches.near_duplicates(documents([])).collect() == []
    left = sketches.one_of_each(documents([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)]))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3] and len(left.columns) == len(documents([]).columns)


@pytest.mark.parametrize("text", ["word " * 300_000, "".join(f"w{i} " for i in range(200_000))])
def test_long_text(documents, text):
    got = sketches.near_duplicates(documents([(1, text), (2, text + "end"), (3, "w1 w2 w3 w4")])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3} or len(set(text.split())) == 1
