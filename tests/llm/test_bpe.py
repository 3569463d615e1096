from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken

from brute import sha
from claimloom.llm import bpe

RULES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("own", pat_str=RULES[1], mergeable_ranks=bpe.read_ranks(RULES[0]), special_tokens={})


def hard_texts():
    random.seed(1)
    bits = [" ", "  ", "\n", "a", "aa", "=", "-", "é", "ß", "中", "́", "1", "22", "'s", "'", "\t", "\xa0", "st", "th", "😀", "%", "\x1c", "\x00", "А", "ни", "<|endoftext|>"]
    texts = ["".join(random.choice(bits) * random.choice([1, 1, 1, 2, 3, 15]) for _ in range(random.randint(0, 12))) for _ in range(2000)]
    return texts + [c * n for c in "a=- .é0中" for n in range(1, 70)] + ["word " * 100_000, "x" * 50_000]


def test_same_ids_and_round_trip(other):
    own = bpe.ByteBPE(*RULES)
    for text in hard_texts():
        (ids,) = own.encode_batch([text])
        assert ids == other.encode_ordinary(text)
        assert own.decode_bytes(ids) == text.encode()


def test_offsets_and_split_characters():
    own = bpe.ByteBPE(*RULES)
    text = "né 😀\U0001f9ff 中國 x"
    ids, spans = own.encode_offsets(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for i, (a, b) in zip(ids, spans):
        assert own.table[i] in text[a:b].encode()
    assert any(x == y for x, y in zip(spans, spans[1:]))  # a character in several tokens
    assert "".join(own.decode_stream([i] for i in ids)) == text
    assert "".join(own.decode_stream([ids[:-3]])) != text


def test_tables(spark, documents, other):
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, ""), (3, "é" * 5000)]
    got = sorted(map(tuple, bpe.digests(documents(rows), *RULES).collect()), key=repr)
    want = []
    for doc, text in rows:
        ids = other.encode_ordinary(text or "")
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    assert got == sorted(want, key=repr)
    table = bpe.decode(bpe.encode(documents(rows).withColumnsRenamed({"id": "ids", "h": "decoded"}), *RULES), *RULES)
    assert sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in table.collect()), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)
    assert bpe.digests(documents([]), *RULES).collect() == []
