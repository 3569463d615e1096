from __future__ import annotations

import random

import pytest

from claimloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, keep string, tokens string"
SMALL = quality.Settings(bins=1 << 12, word_z=4.0)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for d in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        if bad:
            text = [w + rng.choice(["###", "%%%", "&&&"]) for w in text]
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["villain", "rogue"])
        docs.append((d, " ".join(text), "en", f"s{d % 5}", "x", "x"))
        labels.append((d, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus(900)
    table = spark.createDataFrame(docs, SCHEMA)
    seen = labels[:500] + [(3, None, 1), (None, 1, 0), (5000, 1, 0), labels[0]]
    return table, labels, quality.train(table, spark.createDataFrame(seen, "doc_id long, quality int, toxic int"), SMALL)


def test_held_out_accuracy(fitted):
    table, labels, model = fitted
    got = {r["doc_id"]: r for r in quality.score(table, model).collect()}
    held = labels[500:]
    assert len(got) == 900
    assert sum((got[d]["quality_probability"] >= 0.5) == bool(q) for d, q, _ in held) >= 0.97 * len(held)
    assert sum((got[d]["toxic_probability"] >= 0.5) == bool(t) for d, _, t in held) >= 0.95 * len(held)
    assert {r["doc_id"] for r in quality.accepted(table, model).collect()} == {d for d, r in got.items() if r["keep"]}


def test_hard_rows(spark, fitted):
    rows = [(1, None, None, None, "x", "x"), (1, None, None, None, "x", "x"), (None, "", "", "", "x", "x"), (2, "w1 " * 1_000_000, "en", "s", "x", "x")]
    got = quality.score(spark.createDataFrame(rows, SCHEMA), fitted[2]).collect()
    assert len(got) == 4 and all(0 <= r["quality_probability"] <= 1 for r in got)
    assert got[0] == got[1]


def test_nothing_to_learn(spark):
    docs, labels = corpus(40)
    table, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["keep"] for r in quality.score(table, quality.train(table, none, SMALL)).collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score(empty, quality.train(empty, none, SMALL)).collect() == []


def test_one_view_teaches_the_other(spark):
    docs, labels = corpus(900, seed=2)
    table = spark.createDataFrame(docs, SCHEMA)
    model = quality.train(table, spark.createDataFrame(labels[:120], "doc_id long, quality int, toxic int"), SMALL)
    got = {r["doc_id"]: r["quality_probability"] for r in quality.score(table, model).collect()}
    assert sum((got[d] >= 0.5) == bool(q) for d, q, _ in labels[120:]) >= 0.95 * len(labels[120:])


def test_a_rare_class_is_learnt(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rare = {150 * k + 7 for k in range(14)}
    docs = [(d, " ".join([rng.choice(words) for _ in range(30)] + ["villain"] * (3 * (d in rare))), "en", "s", "x", "x") for d in range(2100)]
    labels = [(d, d % 2, int(d in rare)) for d in range(2100)]
    table = spark.createDataFrame(docs, SCHEMA)
    model = quality.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), quality.Settings(bins=1 << 12, word_z=4.0, labelled_rows=200, pool_rows=100))
    got = {r["doc_id"]: r["toxic_probability"] for r in quality.score(table, model).collect()}
    assert sum(got[d] >= 0.5 for d in rare) >= 12
    assert sum(got[d] >= 0.5 for d in got.keys() - rare) <= 10
    few = quality.train(table, spark.createDataFrame(labels[5:9], "doc_id long, quality int, toxic int"), SMALL)
    assert few.quality and few.toxic
