"""Shards by histogram sort: nearly equal bytes, whole groups, gapless slots, and limits against a plain sort."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from claimloom.llm import shards

FOLDER = "/root/testdata/sf0.001"


def size(text):
    return len((text or "").encode()) + 1


def lawful(rows, source, n=8, tolerance=shards.TOLERANCE):
    """Rows (doc_id, text, shard, slot) hold all of `source`, are numbered without gaps, and are nearly equal in bytes."""
    assert Counter((d, t) for d, t, *_ in rows) == Counter(source)
    slots, sizes = defaultdict(list), [0] * n
    for _, text, s, slot in rows:
        slots[s].append(slot)
        sizes[s] += size(text)
    assert all(0 <= s < n and sorted(x) == list(range(len(x))) for s, x in slots.items())
    fair = sum(sizes) / n
    largest = max((size(t) for _, t in source), default=0)
    ends = np.cumsum(sizes)
    assert all(abs(e - fair * (k + 1)) <= max(tolerance * fair, largest / 2 + 1) for k, e in enumerate(ends))
    return sizes


def placed(df):
    return [(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in df.select("doc_id", "text", "shard", "slot").collect()]


def test_hard_rows(documents):
    source = [(1, "same"), (1, "same"), (1, "other"), (None, None), (None, ""), (None, ""), (2, "ñ" * 500), (3, "x" * 20_000)]
    source += [(k, f"text {k} " * (k % 7)) for k in range(10, 400)]
    df = shards.shard(documents(source).repartition(5), piece_bytes=700)
    assert {"id", "h", "row", "bucket", "lang"} <= set(df.columns)
    lawful(placed(df), source)


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_few_rows(documents, rows):
    source = [(k, "t" * k) for k in range(rows)]
    lawful(placed(shards.shard(documents(source))), source)


def test_columns_of_the_same_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "a", 9, 9, 9, 9)], "doc_id long, text string, shard int, slot int, g int, size int")
    row = shards.shard(df).collect()[0].asDict()
    assert row.pop("shard") < 8 and row == {"doc_id": 1, "text": "a", "g": 9, "size": 9, "slot": 0}
    assert sorted(shards.shard(df).columns) == sorted(df.columns)


def test_a_third_of_all_rows_is_one_row(documents):
    """Identical rows, without any id, are spread; other groups of equal texts stay whole."""
    source = [(None, "the very same text, again and again")] * 2000
    source += [(k, f"pair {k // 2:05d} of two equal texts here ") for k in range(4000)]
    rows = placed(shards.shard(documents(source).repartition(6), piece_bytes=20_000))
    lawful(rows, source)
    where = defaultdict(set)
    for _, text, s, _ in rows:
        where[text].add(s)
    assert len(where[source[0][1]]) >= 3
    assert all(len(s) == 1 for text, s in where.items() if text != source[0][1])


def test_limits_against_a_sort(spark):
    rng = np.random.default_rng(5)
    g = np.append(rng.integers(-(1 << 62), 1 << 62, 3000), np.full(1000, 77))
    t, weight = rng.integers(-(1 << 62), 1 << 62, 4000), rng.integers(1, 50, 4000)
    keyed = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(g, t, weight)], "g long, t long, size long").repartition(7)
    order = np.lexsort((t, g))
    below = np.append(0, np.cumsum(weight[order]))
    total = int(below[-1])
    wanted = [(total * k / 10, 0.0) for k in range(1, 10)]
    found, rounds = shards.limits(keyed, total, len(g), wanted)
    for (target, _), limit in zip(wanted, found):
        assert abs(limit.bytes - target) == np.abs(below - target).min()
        assert limit.bytes == below[limit.rows]
        keys = [shards._key(int(g[i]), int(t[i])) for i in order]
        assert sum(k < limit.key for k in keys) == limit.rows
    assert rounds < 14


def test_bins_of_equal_hashes():
    limit_g, limit_t = np.array([1, 5, 5, 5, 9]), np.array([0, -3, 0, 4, 2])
    keys = [(g, t) for g in (0, 1, 5, 6, 9) for t in (-5, -3, 0, 1, 4, 7)]
    got = shards.bins(np.array([g for g, _ in keys]), np.array([t for _, t in keys]), limit_g, limit_t)
    assert got.tolist() == [sum((a, b) <= k for a, b in zip(limit_g, limit_t)) for k in keys]


def test_saved_shards_read_back(documents, spark, tmp_path):
    source = [(k, f"text {k}") for k in range(200)]
    shards.save(shards.shard(documents(source), 4), str(tmp_path / "out"))
    lawful(placed(spark.read.parquet(str(tmp_path / "out"))), source, 4)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")
def test_query(spark):
    from claimloom.llm.queries import QUERIES

    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    found = QUERIES["op12_sharding"](spark, FOLDER).collect()
    assert lawful([(r["doc_id"], source[r["doc_id"]], r["shard"], r["slot"]) for r in found], list(source.items()))
    for r in found:
        text = source[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (size(text), zlib.crc32(text.encode()), "bytes", None)
