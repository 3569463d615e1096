"""Byte-level BPE: texts to token ids with character offsets, and back.

The rank file gives every token's bytes. For the tokenizers library the bytes
are written as printable characters (the usual byte-to-character table), and
every way to split a token into two smaller tokens becomes a merge of that
token's rank, which is how rank files are meant to be read.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .columns import give_back, table

#: Distinct matches of the split pattern whose ids a task keeps at most; beyond it, it starts afresh.
KEPT_MATCHES = 200_000

ENCODED = "row long, doc_id long, ids array<int>"
_DIGESTS = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
])


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, letters = read_ranks(path), byte_characters()
    spell = {token: "".join(letters[b] for b in token) for token in ranks}
    merges = [
        (spell[token[:k]], spell[token[k:]])
        for token in sorted(ranks, key=ranks.get)
        for k in range(len(token) - 1, 0, -1)
        if token[:k] in ranks and token[k:] in ranks
    ]
    encoder = Tokenizer(models.BPE({spell[t]: r for t, r in ranks.items()}, merges))
    encoder.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return encoder


@lru_cache(maxsize=2)
def _table(path: str) -> list[bytes]:
    """The bytes of every id: the reverse of the byte table, applied to the tokens' spelling."""
    ranks, letters = read_ranks(path), byte_characters()
    back = {c: b for b, c in enumerate(letters)}
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = bytes(back[c] for c in (letters[b] for b in token))
    return out


class ByteBPE:
    """Encoder and decoder for one rank file and split pattern.

    Texts are split by the pattern; each distinct match goes through the
    library once, whatever the length of the text it stands in.
    """

    def __init__(self, path: str, pattern: str):
        self.path, self.table = path, _table(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        known, out = self.known, []
        for text in texts:
            matches = self.split(text)
            new = [m for m in set(matches) if m not in known]
            if new:
                if len(known) + len(new) > KEPT_MATCHES:
                    known.clear()
                    new = list(set(matches))
                known.update(zip(new, (e.ids for e in _encoder(self.path).encode_batch_fast(new, add_special_tokens=False))))
            out.append([i for m in matches for i in known[m]])
        return out

    def encode_offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and for each id the characters [begin, end) of the text that its bytes come from.

        Ids that hold parts of one character all name that whole character.
        """
        ids = self.encode_batch([text])[0]
        lengths = np.array([len(c.encode()) for c in text], np.int64)
        character = np.repeat(np.arange(len(text)), lengths)  # of each byte
        ends = np.cumsum([len(self.table[i]) for i in ids]) if ids else np.zeros(0, np.int64)
        begins = np.append(0, ends[:-1]).astype(np.int64)
        return ids, [(int(character[a]), int(character[b - 1]) + 1) for a, b in zip(begins, ends)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        t = self.table
        return b"".join([t[i] for i in ids])

    def decode_stream(self, batches: Iterator[list[int]]) -> Iterator[str]:
        """Text of ids that arrive in pieces; a character split between pieces comes with the later one.

        Bytes that are no UTF-8 become U+FFFD.
        """
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in batches:
            yield decoder.decode(self.decode_bytes(ids))
        yield decoder.decode(b"", True)


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """Add `ids`, the token ids of `text`, to a table; a null text has none.

    With `decoded`, the bytes that the ids stand for come along. Every other
    column and row is kept, repeated ones too; columns of these names are
    replaced. Rows are independent: no shuffle, and memory is that of one row
    of text and one Arrow batch.
    """
    new = ["ids", "decoded"] if decoded else ["ids"]
    kinds = StructType.fromDDL("ids array<int>, decoded binary").fields[: len(new)]
    schema = StructType(docs.drop(*new).schema.fields + kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path, pattern)
        for batch in batches:
            give_back()
            batch = batch.drop_columns([c for c in new if c in batch.schema.names])
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = bpe.encode_batch([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()])
                out = part.append_column("ids", pa.array(ids, pa.list_(pa.int32())))
                yield out.append_column("decoded", pa.array(map(bpe.decode_bytes, ids), pa.binary())) if decoded else out

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add `decoded`, the bytes that `ids` stand for; null ids give no bytes."""
    schema = StructType(encoded.drop("decoded").schema.fields + StructType.fromDDL("decoded binary").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path, pattern)
        for batch in batches:
            give_back()
            if "decoded" in batch.schema.names:
                batch = batch.drop_columns(["decoded"])
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = part.column(part.schema.get_field_index("ids")).to_pylist()
                yield part.append_column("decoded", pa.array([bpe.decode_bytes(x or []) for x in ids], pa.binary()))

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode and digest in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(path, pattern)
        for batch in batches:
            give_back()
            counts, first, second = [], [], []
            for text in batch.column(1):
                ids = bpe.encode_batch([text.as_py() or ""])[0]
                counts.append(len(ids))
                first.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
            yield table(_DIGESTS, batch.column(0), counts, first, second)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
