"""The registered queries against their SQL, or plain versions, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import compare
from brute import repeated_bytes, repeated_lines, sha
from claimloom.llm.queries import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_sql(spark, name):
    got = compare.actual(QUERIES[name](spark, FOLDER))
    assert compare.difference(got, compare.expected(compare.connect(FOLDER), CHECKS[name])) is None


def test_suffixes(spark):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op8_suffix_dedup"](spark, FOLDER).collect()}
    assert got == repeated_bytes(texts(spark))


def test_lines(spark):
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op10_line_dedup"](spark, FOLDER).collect()}
    assert got == {d: (n, gone, sha(left)) for d, (n, gone, left) in repeated_lines(texts(spark), 10).items()}


def test_neighbours_recall(spark):
    import numpy as np

    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.array([r["vec_id"] for r in rows])
    got = {(r["query_id"], r["vec_id"]) for r in QUERIES["op2_nearest_neighbours"](spark, FOLDER).collect()}
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i]
        score[i] = -2
        want |= {(ids[i], ids[j]) for j in np.argsort(-score, kind="stable")[:5]}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("name", ["op4_html_extraction", "op5_byte_bpe", "op6_quality_classifier", "op7_substring_dedup"])
def test_whole_tables(spark, name):
    table = "pages" if "html" in name else "documents"
    n = QUERIES[name](spark, FOLDER).count()
    assert n == spark.read.parquet(f"{FOLDER}/{table}.parquet").count() or name.startswith("op7")
