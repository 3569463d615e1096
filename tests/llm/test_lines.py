from __future__ import annotations

import random

import pytest

from brute import repeated_lines
from claimloom.llm import lines


def corpus():
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 6))) for _ in range(12)]
    rows = []
    for d in range(60):
        text = []
        while len(text) < rng.randint(1, 25):
            s = rng.randint(0, 11)
            text += base[s : s + rng.randint(1, 6)] if rng.random() < 0.6 else [str(rng.random())]
        rows.append((d, "\n".join(text)))
    return rows + [(100, ""), (101, "\n\n\n"), (102, rows[7][1]), (103, "é " * 12 + "\n" + "é " * 12)]


@pytest.mark.parametrize("least", [1, 5, 10])
def test_against_plain_version(documents, least):
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in lines.dedup(documents(corpus()), least).collect()}
    assert got == repeated_lines(corpus(), least)


def test_null_repeated_and_long(documents):
    line = " ".join("abcdefghijkl")
    long = "\n".join(f"{i} {line}" for i in range(50_000))
    rows = [(1, None), (2, line), (2, line), (None, line), (3, long), (4, long)]
    left = lines.dedup(documents(rows))
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["n_runs"]) for r in left.collect()), key=repr)
    assert got == sorted([(1, 0, 0, 0), (2, 1, 1, 1), (2, 1, 1, 1), (None, 1, 0, 0), (3, 50_000, 0, 0), (4, 50_000, 50_000, 1)], key=repr)
    assert left.where("doc_id = 1").first()["text"] is None and set(documents([]).columns) <= set(left.columns)
    assert lines.dedup(documents([])).collect() == []


def test_regular_lines_of_equal_polynomials(documents):
    """A Thue-Morse line and its complement agree in every polynomial hash modulo a power of two."""
    ones = [bin(k).count("1") % 2 for k in range(2048)]
    rows = [(1, "".join("ab"[x] for x in ones)), (2, "".join("ba"[x] for x in ones)), (3, "".join("ab"[x] for x in ones))]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup(documents(rows), 1).collect()}
    assert got == {1: 0, 2: 0, 3: 1}
