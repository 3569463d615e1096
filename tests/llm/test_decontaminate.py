from __future__ import annotations

import random

from brute import contamination, terms
from claimloom.llm import decontaminate


def items_table(spark, items):
    return spark.createDataFrame([(i, t, "x", "x") for i, t in items], "item_id long, text string, win string, term string")


def check(spark, documents, docs, items, size=10):
    got = sorted(map(tuple, decontaminate.report(documents(docs), items_table(spark, items), size).collect()), key=repr)
    assert got == sorted(contamination(docs, items, size), key=repr)


def text(rng, n, vocabulary="abcdefghij"):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def test_against_plain_version(spark, documents):
    rng = random.Random(3)
    items = [(i, text(rng, rng.randint(0, 9), "abc")) for i in range(6)] + [(10, None), (11, "..."), (None, "K1 l2 é-m"), (12, "Z")]
    docs = [(d, text(rng, rng.randint(0, 60), "abcd")) for d in range(40)] + [(50, None), (51, ""), (52, "k1, L2; é/m n"), (52, "z"), (None, "Z z")]
    check(spark, documents, docs, items, size=4)
    check(spark, documents, docs, items, size=10)


def test_repeats_and_long_text(spark, documents):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(25))
    docs = [(1, passage), (1, passage), (2, " ".join(["q"] * 200_000) + " " + passage), (3, passage.replace("p12", "x"))]
    docs += [(10 + i, text(rng, 20)) for i in range(5)]
    check(spark, documents, docs, [(1, passage.upper()), (2, passage), (2, passage)])


def test_empty_tables(spark, documents):
    check(spark, documents, [], [(1, "a b")])
    check(spark, documents, [(1, "a b")], [])
    docs = documents([(1, "a b"), (None, "a b"), (None, "c"), (3, None)])
    assert sorted(map(repr, (r[0] for r in decontaminate.clean(docs, items_table(spark, [(1, "a b")])).collect()))) == ["3"]


def test_proximity(spark, documents):
    rng = random.Random(8)
    docs = [(d, text(rng, rng.randint(0, 40), "abcdefgh")) for d in range(25)]
    items, slop = [(0, "a b c"), (1, "d d e")], 2
    wanted = decontaminate.windows(items_table(spark, items))
    found = decontaminate.index(documents(docs), wanted.vocabulary)
    named = {r["win"]: r["item_id"] for r in wanted.items.collect()}
    ids = {r["row"]: r["doc_id"] for r in found.documents.collect()}
    got = {(ids[r["row"]], named[r["win"]]) for r in decontaminate.proximity_matches(found, wanted, slop).collect()}
    want = set()
    for d, t in docs:
        w = terms(t)
        for i, item in items:
            need, span = set(terms(item)), len(terms(item)) + slop
            if any(need <= set(w[k : k + span]) for k in range(len(w))):
                want.add((d, i))
    assert got == want
