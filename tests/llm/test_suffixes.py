from __future__ import annotations

import random

from brute import repeated_bytes, sha
from claimloom.llm import suffixes


def run(documents, rows):
    return sorted((tuple(r)[:5] for r in suffixes.report(documents(rows)).collect()), key=repr)


def check(documents, rows):
    want = [(doc, *rest) for doc, rest in repeated_bytes(rows).items()]
    assert run(documents, rows) == sorted(want, key=repr)


def test_against_plain_version(documents):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcde é") for _ in range(rng.randint(50, 400))) for _ in range(12)]
    rows = []
    for d in range(80):
        text = ""
        for _ in range(rng.randint(0, 6)):
            p, s = rng.choice(passages), rng.randint(0, 30)
            text += p[s : s + rng.randint(60, 400)] if rng.random() < 0.6 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200)))
        rows.append((d, text + "ab" * rng.choice([0, 0, 0, 60]) + "x" * rng.choice([0, 0, 0, 99, 100, 101, 320])))
    check(documents, rows + [(500, None), (501, ""), (502, "y" * 99), (503, rows[3][1])])


def test_text_longer_than_a_slice(documents):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefghijkl ") for _ in range(5_000_000))
    rows = [(1, long[1_000_000:1_000_500]), (2, long), (3, long[4_100_000:4_300_000])]
    got = {r[0]: r for r in run(documents, rows)}
    assert got[1][2] == 0 and got[2][1:4] == (len(long), 500, 1) and got[3][1:4] == (200_000, 200_000, 1)
    assert got[2][4] == sha(long[:1_000_000] + long[1_000_500:])


def test_repeated_rows_share_a_fate(documents):
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    got = run(documents, [(1, text), (1, text), (2, text), (None, text + "!")])
    assert [(r[0], r[2]) for r in got] == [(1, 300), (1, 300), (2, 300), (None, 0)]
    assert [(r[0], r[2]) for r in run(documents, [(1, text), (1, text), (2, text)])] == [(1, 0), (1, 0), (2, 300)]
    assert run(documents, []) == []


def test_texts_of_equal_short_hash_stay_apart(spark, documents):
    """Without ids rows are known by a hash of their text; texts that agree in 32 bits are not one document."""
    from pyspark.sql import functions as F

    shared = ("abcdefghijklm" * 10)[:130]
    numbers = spark.range(200_000).select(F.format_string("%0320d", "id").alias("n"))
    first = numbers.select(F.concat(F.lit(shared), "n").alias("a")).withColumn("k", F.hash("a"))
    second = numbers.select(F.concat("n", F.lit(shared)).alias("b")).withColumn("k", F.hash("b"))
    a, b = first.join(second, "k").select("a", "b").orderBy("a", "b").first()
    import random

    rng = random.Random(4)
    noise = ["".join(rng.choice("uvwxyz") for _ in range(150)) for _ in range(2)]
    rows = [(None, a), (None, b), (1, noise[0]), (2, noise[1])]
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.report(documents(rows)).collect())
    assert len(got) == 4 and any(g[1] for g in got)
    ids = spark.createDataFrame([(a,), (b,)], "t string").select("t", F.xxhash64("t").alias("h")).orderBy("h").collect()
    order = {r["t"]: k for k, r in enumerate(ids)}
    want = repeated_bytes([(order[a], a), (order[b], b), (10, noise[0]), (11, noise[1])])
    assert got == sorted(w[:3] for w in want.values())
