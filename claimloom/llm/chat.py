"""Chat formatting: conversations as marked-up training text with a loss mask.

A turn becomes `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. Inside texts and roles every
`<`, any number of backslashes, `|` gets one more backslash after the `<`, so a
control string never occurs there and the reverse step restores the input
exactly. In roles, backslash and line feed are written `\\\\` and `\\n` first.

The output is built by columns: segment lengths, cumulative offsets and scatter
indices are numpy arrays, and headers, texts and footers are copied into one
preallocated buffer that Arrow then cuts into strings without another copy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import concat_ranges, flat, slices, table

BEGIN, END = b"<|im_start|>", b"<|im_end|>\n"

PARTS = "conv_id long, part long, n_turns long, text string, loss_begin array<int>, loss_end array<int>"
_PARTS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()),
    ("loss_begin", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32())),
])
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])

_MARK = re.compile(rb"<(\\*)\|")
_ESCAPED = re.compile(rb"<\\(\\*)\|")


def escape(text: bytes) -> bytes:
    return _MARK.sub(rb"<\\\1|", text)


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", text)


def escape_role(role: str) -> bytes:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n").encode())


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role), flags=re.S)


def _marks(data: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of the `<` that need a backslash behind them."""
    opens = np.flatnonzero(data == 0x3C)
    if not len(opens):
        return opens
    solid = np.append(np.flatnonzero(data != 0x5C), len(data))
    after = solid[np.searchsorted(solid, opens + 1)]
    row_end = np.repeat(ends, lengths)[opens]
    inside = after < row_end
    return opens[inside][data[after[inside]] == 0x7C]


def assemble(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Format the turns of a batch: bytes, offsets of turns, begins and ends of their texts."""
    data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
    lengths = np.diff(offsets)
    roles = pc.fill_null(batch.column(batch.schema.get_field_index("role")), "").dictionary_encode()
    codes = roles.indices.to_numpy(zero_copy_only=False)
    heads = [BEGIN + escape_role(r) + b"\n" for r in roles.dictionary.to_pylist()]
    marks = _marks(data, offsets[1:], lengths)
    extra = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[marks], minlength=len(lengths))
    head = np.array([len(h) for h in heads], np.int64)[codes] if heads else np.zeros(0, np.int64)

    turn_lengths = head + lengths + extra + len(END)
    turns = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(turn_lengths, out=turns[1:])
    text_begin = turns[:-1] + head
    text_end = text_begin + lengths + extra
    out = np.empty(int(turns[-1]), np.uint8)

    for code, h in enumerate(heads):
        out[turns[:-1][codes == code][:, None] + np.arange(len(h))] = np.frombuffer(h, np.uint8)
    out[text_end[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    shift = np.zeros(len(data) + 1, np.int64)
    shift[marks + 1] = 1  # the bytes behind a mark move by one
    moved = np.cumsum(shift)[: len(data)]
    first = moved[np.minimum(offsets[:-1], max(len(data) - 1, 0))] if len(data) else np.zeros(len(lengths), np.int64)
    target = concat_ranges(text_begin, lengths) + moved - np.repeat(first, lengths)
    out[target] = data
    out[target[marks] + 1] = 0x5C
    return out, turns, text_begin, text_end


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    for batch in batches:
        for piece in slices(batch, "text", 8 << 20):
            out, turns, begins, ends = assemble(piece)
            ids = piece.column(piece.schema.get_field_index("conv_id"))
            known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (known[1:] != known[:-1])))
            limits = np.append(new, len(values))
            cuts = turns[limits].astype(np.int32)
            text = pa.Array.from_buffers(pa.string(), len(new), [None, pa.py_buffer(cuts), pa.py_buffer(out)])
            learn = np.flatnonzero(
                pc.fill_null(pc.equal(piece.column(piece.schema.get_field_index("role")), "assistant"), False)
                .to_numpy(zero_copy_only=False)
            )
            base = turns[new][np.searchsorted(new, learn, "right") - 1]
            counts = np.searchsorted(learn, limits).astype(np.int32)
            yield table(
                _PARTS, ids.take(pa.array(new)), part + np.arange(len(new)), np.diff(limits), text,
                pa.ListArray.from_arrays(pa.array(counts), pa.array((begins[learn] - base).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(counts), pa.array((ends[learn] - base).astype(np.int32))),
            )
            part += len(new)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted text of every conversation, in parts of a few MB.

    `turns` has conv_id, turn, role, text; other columns are ignored. Rows are
    ordered by turn (null first), equal turns by role and text; repeated rows
    all count. A null text or role is empty, null conv_ids form one
    conversation, an empty table gives no rows. The result has one or more
    rows per conversation; `part` gives their order, and loss_begin and
    loss_end are byte offsets in the part's text. Partitions are ranges of
    (conv_id, turn), so the turns of one huge conversation are spread over
    many tasks.
    """
    spread = (
        turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
        .repartitionByRange(F.col("conv_id"), F.col("turn"))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return spread.mapInArrow(_format, PARTS)


def read_turns(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Role and text of every turn of a formatted text."""
    for turn in text.split(END)[:-1]:
        role, _, content = turn[len(BEGIN):].partition(b"\n")
        yield unescape_role(role), unescape(content)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != key:
                if state is not None:
                    done.append(_result(key, state))
                key, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = row["text"].encode()
            state[0] += row["n_turns"]
            for role, content in read_turns(text):
                state[1].update(role + b"\n" + content + b"\n")
            for a, b in zip(row["loss_begin"], row["loss_end"]):
                learnt = unescape(text[a:b])
                state[2] += len(learnt.decode())
                state[3].update(learnt)
            state[4] += len(row["text"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)
    if state is not None:
        yield pa.RecordBatch.from_pylist([_result(key, state)], schema=_DIGESTS)


def _result(key, state) -> dict:
    return dict(zip(_DIGESTS.names, (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])))


def digests(parts: DataFrame) -> DataFrame:
    """Read formatted parts back: turn count, digests and lengths of every conversation.

    A digest of a whole conversation has to see its bytes in order, so its
    parts meet in one task; they pass through it as a stream and need no memory
    beyond one Arrow batch.
    """
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(_digest, DIGESTS)
