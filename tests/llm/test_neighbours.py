from __future__ import annotations

import numpy as np

from claimloom.llm import neighbours


def brute(rows, asked, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.array(v, np.float64)
    out = {}
    for q in asked:
        if q in usable:
            a = usable[q]
            scores = sorted((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for i, b in usable.items() if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def run(spark, rows, k=5, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string, rank string")
    got = neighbours.search(df, df.where("vec_id % 10 = 0"), k, neighbours.Settings(**settings)).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in np.float32(rng.standard_normal(8))], "x", "x") for i in range(n)]


def close(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_whole_search_is_exact_with_copies_ties_and_bad_rows(spark):
    rows = vectors(200)
    rows += [(1000 + i, rows[0][1], "x", "x") for i in range(50)]  # one very common vector
    rows += [(2000, None, "x", "x"), (2010, [0.0] * 8, "x", "x"), (2020, [float("nan")] + [1.0] * 7, "x", "x")]
    rows += [(2030, [None] + [1.0] * 7, "x", "x"), (2040, [1.0] * 3, "x", "x"), (None, [1.0] * 8, "x", "x"), rows[5], rows[5]]
    rows += [(3000, [2 * x for x in rows[3][1]], "x", "x")]
    want = brute([r[:2] for r in rows], {r[0] for r in rows if r[0] is not None and r[0] % 10 == 0}, 5)
    close(run(spark, rows), want)
    close(run(spark, rows, leaf_rows=16, block_rows=8, query_rows=2, search_share=100.0), want)


def test_few_rows(spark):
    rows = vectors(3)
    close(run(spark, rows), brute([r[:2] for r in rows], {0}, 5))
    assert run(spark, []) == {}
    assert run(spark, [(10, None, "x", "x")]) == {}


def test_recall(spark):
    rows = vectors(3000)
    want = brute([r[:2] for r in rows], range(0, 3000, 10), 5)
    got = run(spark, rows, leaf_rows=64, search_rows=100, search_share=0.5)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
