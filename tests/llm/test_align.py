"""Two tokenizations side by side against a plain version with the libraries as they are."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from brute import sha
from claimloom.llm import align
from claimloom.llm.bpe import byte_characters

FIRST = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
SECOND = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FIRST[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=SECOND)


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain(rows, libraries):
    first, second = libraries
    back = {c: b for b, c in enumerate(byte_characters())}
    docs, pairs = [], Counter()
    for doc, text in rows:
        a = b = ()
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        bytes_a = [bytes(back[c] for c in first.id_to_token(i)) for i in a]
        names = [second.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(x[3:5], 16)]) if second.is_byte(i) else x.replace("▁", " ").encode() for i, x in zip(b, names)]
        wanted = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != wanted or b"".join(bytes_b) != wanted:
            docs.append((doc, [], [], "", []))
            continue
        sa, sb = spans(bytes_a), spans(bytes_b)
        shared = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for high in shared:
            stretch = [ids[bisect_left(of, (low, 0)) : bisect_left(of, (high, 0))] for ids, of in ((a, sa), (b, sb))]
            groups.append("|".join(",".join(map(str, ids)) for ids in stretch))
            low = high
        ends = [v for _, v in sb]
        links = [(x, b[k]) for x, (s, e) in zip(a, sa) for k in range(bisect_right(ends, s), bisect_left(ends, e) + 1)]
        pairs.update(links)
        docs.append((doc, a, b, groups, links))
    top = defaultdict(int)
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    return sorted(
        (doc if doc is not None else -9, len(a), len(b), len(g), len(l), sum(pairs[x] == top[x[1]] for x in l), sum(pairs[x] for x in l), sha(";".join(g)) if g else "")
        for doc, a, b, g, l in docs
    )


def collected(df):
    return sorted((-9 if r["doc_id"] is None else r["doc_id"], *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


ROWS = [
    (1, "Hello wörld!\n\nfoo  bar "), (1, "Hello wörld!\n\nfoo  bar "), (2, None), (None, ""), (None, "x"), (3, "a▁b"), (4, " "), (5, "\n"), (6, "<s> <|endoftext|> <0x41>"),
    (7, "\0\t\r\x85   tab\t"), (8, "日本語のテキスト 😀 ñandú ﬁ Ⅻ ²"), (9, "internationalisation's misspeling antidisestablishmentarianism"), (10, "ᲊ Ɤ \U0001df00"),
    (11, "  lead\n  indented 12345 3.14"),
]


def test_hard_rows(documents, libraries):
    assert collected(align.report(documents(ROWS), FIRST, SECOND)) == plain(ROWS, libraries)


def test_parts_and_slices_leave_results_alone(documents, libraries, monkeypatch):
    """Long texts in parts, and many slices, in the worker's copy of the module too."""
    rows = [(k, "some words like internationalisation, again and again " * (k + 1)) for k in range(9)] + ROWS
    want = plain(rows, libraries)
    parts = [list(align.pieces_of(" " + t)) for _, t in rows if t]
    monkeypatch.setattr(align, "PART_CHARACTERS", 40)
    cut = [list(align.pieces_of(" " + t)) for _, t in rows if t]
    assert max(map(len, parts)) == 1 < max(map(len, cut)) and [" " + t for _, t in rows if t] == ["".join(p) for p in cut]
    assert collected(align.report(documents(rows).repartition(7), FIRST, SECOND)) == want
    for size in (60, 1 << 20):
        monkeypatch.setattr(align, "PART_BYTES", size)
        monkeypatch.setattr(align, "SLICE_BYTES", 300)
        out = _rows_of([r for r in rows if r[1]])
        assert out == [(n, k, g, l) for _, n, k, g, l, *_ in plain_in_order([r for r in rows if r[1]], libraries)]


def _rows_of(rows):
    """Counts per document from the encoding step, run here so that small limits hold."""
    found, encoders = [], align._encoders(FIRST, SECOND)
    import pyarrow as pa

    sums = {}
    for parts in align._batches_of_parts(pa.array([t for _, t in rows])):
        x = align.Parts([t for _, t, _ in parts], *encoders)
        links = x.links()[0]
        for k, (row, _, done) in enumerate(parts):
            bad, *old = sums.get(row, (False, 0, 0, 0, 0))
            new = [(x.part_a == k).sum(), (x.part_b == k).sum(), (x.part_of_group == k).sum(), (links == k).sum()]
            sums[row] = (bad or bool(x.bad[k]), *[int(p + q) for p, q in zip(old, new)])
            if done:
                found.append((0, 0, 0, 0) if sums[row][0] else sums[row][1:])
    return found


def plain_in_order(rows, libraries):
    return [plain([r], libraries)[0] for r in rows]


def test_empty_table(documents):
    assert align.report(documents([]), FIRST, SECOND).count() == 0


def test_groups_of_the_real_output(spark, libraries):
    rows = [(k, t) for k, (_, t) in enumerate(ROWS)]
    found = align.align(spark.createDataFrame(rows, "doc_id long, text string"), FIRST, SECOND).collect()
    for r in found:
        if r["a_ids"]:
            ends = sorted(set(r["a_ends"]) & set(r["b_ends"]))
            assert ends[-1] == len(r["text"].encode()) + 1
            for side in "ab":
                assert r[f"{side}_groups"] == [sum(e < x for e in ends) for x in r[f"{side}_ends"]]
        else:
            assert not r["text"] or "▁" in r["text"]


def test_pointer_jumping_crosses_long_chains():
    """Tokens that overlap in a staircase are one group; doubling needs few steps for it."""
    x = align.Parts.__new__(align.Parts)
    n = 1000
    x.a, x.b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    x.end_a, x.end_b = np.append(np.arange(1, n) * 2, 2 * n), np.append(np.arange(1, n) * 2 - 1, 2 * n)
    x.high = np.searchsorted(x.end_b, x.end_a, "left")
    x.part_a = np.zeros(n, np.int64)
    x._group()
    assert len(x.part_of_group) == 1 and not x.group_a.any() and not x.group_b.any()


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")
def test_query(spark, libraries):
    from claimloom.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert collected(QUERIES["op11_token_alignment"](spark, FOLDER)) == plain(rows, libraries)
