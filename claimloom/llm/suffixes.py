"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are sorted by their first `depth` bytes only, most significant digit
first; what is equal after the last pass is exactly a repeated window, and a
suffix that is alone in its group is dropped at once. The digits are taken so
that the first pass needs to move few suffixes: a window is filed under its
anchor, the 32-byte string in it with the smallest hash (the leftmost of equal
ones). Neighbouring windows share an anchor, equal windows have equal anchors,
and only anchors move, about one for 35 windows.

Pass 1: the anchor string. Pass 2: the whole stretch of the windows under one
anchor; where it is equal, all windows in it are. Pass 3, for stretches that
differ: 83-byte strings around the anchor, of which every 100-byte window holds
one, so that only windows around a repeated one go on. Pass 4: these windows
themselves.
Digits are compared by 64-bit hashes, windows and stretches by two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import BYTE_CODES, SLICE_BYTES, concat_ranges, flat, mix, prefix, slices, span_hash
from .shared import stored

DEPTH = 100
GRAM = 32
#: Bytes of text whose anchors make up one bucket of the radix sort.
BUCKET_BYTES = 4 << 20
#: Span lists of at most this many bytes are sent to every executor; beyond it the texts are shuffled to them.
BROADCAST_BYTES = 48 << 20
NO_ID = -(1 << 63)
_OTHER_CODES = mix(BYTE_CODES)
#: Pass 3 cuts the offsets that an anchor can have in a window into so many stretches.
CORES = 4
_ANCHOR = np.dtype([
    ("g", "<u8"), ("c", "<u8"), ("id", "<i8"), ("h", "<i8"), ("lo", "<i4"), ("n", "<u2"), ("back", "<u2"), ("cores", "<u2", (CORES,)),
])
COPY, OPEN = 0, 1


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The smallest of `width` neighbouring values from every place on."""
    size, low = 1, key
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchors(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, anchor behind it, and the digits g, c and cores of every anchor."""
    lengths = np.diff(offsets)
    fit = np.flatnonzero(lengths >= depth)
    if not len(fit):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2 + (np.zeros((0, CORES), np.uint64),)
    sums, other = prefix(BYTE_CODES[data]), prefix(_OTHER_CODES[data])
    places = np.arange(len(data) - GRAM + 1)
    gram = span_hash(sums, places, places + GRAM)
    low_bits = np.uint64((1 << 24) - 1)
    least = _least((gram & ~low_bits) | places.astype(np.uint64), depth - GRAM + 1)
    starts = concat_ranges(offsets[fit], lengths[fit] - depth + 1)
    rows = np.repeat(fit, lengths[fit] - depth + 1)
    anchor = (least[starts] & low_bits).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])))
    n = np.diff(np.append(new, len(starts)))
    lo, at, row = starts[new], anchor[new], rows[new]
    begin, end = offsets[row], offsets[row + 1]
    digits = []
    for low, high in _offsets(depth):
        a, b = at - low, at + depth - high
        inside = (a >= begin) & (b <= end)
        value = span_hash(other, np.where(inside, a, 0), np.where(inside, b, 0)) % np.uint64(65535) + np.uint64(1)
        digits.append(np.where(inside, value, np.uint64(0)))
    return row, lo - begin, n, at - lo, gram[at], span_hash(other, lo, lo + n - 1 + depth), np.column_stack(digits)


def _offsets(depth: int) -> list[tuple[int, int]]:
    """Stretches [low, high] of anchor offsets; windows with such an offset share all but high - low bytes."""
    cuts = [round(k * (depth - GRAM) / CORES) for k in range(CORES + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def _pieces(batch: pa.RecordBatch, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, ids, hashes and first byte of rows; a very long text comes in overlapping pieces."""
    for part in slices(batch, "text"):
        data, offsets = flat(part.column(2))
        ids, hashes = part.column(0).to_numpy(), part.column(1).to_numpy()
        if len(data) <= 2 * SLICE_BYTES:
            yield data, offsets, ids, hashes, np.zeros(len(ids), np.int64)
            continue
        for begin in range(0, len(data) - depth + 1, SLICE_BYTES):
            cut = data[begin : begin + SLICE_BYTES + depth - 1]
            yield cut, np.array([0, len(cut)]), ids, hashes, np.array([begin])


def _later(order_keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort by keys, then place: the order, which rows begin a group, and which lie behind the first place of theirs."""
    order = np.lexsort([*place[::-1], *order_keys[::-1]])
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in order_keys:
        same &= k[order][1:] == k[order][:-1]
    first = np.append(True, ~same) if len(order) else np.zeros(0, bool)
    head = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
    later = np.zeros(len(order), bool)
    for p in place:
        later |= p[order] != p[head]
    return order, first, later


def _dealt(rows: np.ndarray, digits: list[str], buckets: int) -> pa.RecordBatch:
    """Rows of one piece of the input, packed by the bucket of their first digit.

    Of rows with equal digits only the first has to meet those of other pieces;
    the others are known to be later copies and travel as such.
    """
    order, first, later = _later([rows[d] for d in digits], [rows["id"], rows["h"], rows["lo"]])
    copies, kept = rows[order[later]], rows[order[first]]
    bucket = (kept[digits[0]] >> np.uint64(24)) % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    kept, bucket = kept[by], bucket[by]
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]), len(bucket))
    packed = [kept[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    copied = [b""] * len(packed)
    if packed:
        copied[0] = _pack(copies)
    where = bucket[cuts[:-1]].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(where), pa.array(packed, pa.binary()), pa.array(copied, pa.binary())], ["bucket", "rows", "copies"])


def _sorted_by_bucket(packed: DataFrame, finish: Callable[[list[bytes]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Bring equal buckets together and finish one after the other; copies pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for b, rows, copies in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if copies:
                    yield _out(np.frombuffer(copies, _COPY), COPY)
                if b != bucket and held:
                    yield from finish(held)
                    held = []
                bucket = b
                held.append(rows)
        if held:
            yield from finish(held)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "id long, h long, lo int, n int, kind int")


def _spans(docs: DataFrame, buckets: int, depth: int) -> DataFrame:
    """Passes 1 to 3: stretches of windows that are copies, and stretches whose windows need a closer look."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, ids, hashes, shift in _pieces(batch, depth):
                row, lo, n, back, g, c, cores = anchors(data, offsets, depth)
                rows = np.zeros(len(row), _ANCHOR)
                for name, column in zip(_ANCHOR.names, (g, c, ids[row], hashes[row], lo + shift[row], n, back, cores)):
                    rows[name] = column
                yield _dealt(rows, ["g", "c"], buckets)

    packed = docs.mapInArrow(collect, "bucket long, rows binary, copies binary")
    return _sorted_by_bucket(packed, lambda held: _sorted(held, depth))


_COPY = np.dtype([("id", "<i8"), ("h", "<i8"), ("lo", "<i4"), ("n", "<u4")])


def _pack(rows: np.ndarray) -> bytes:
    out = np.zeros(len(rows), _COPY)
    for name in _COPY.names:
        out[name] = rows[name]
    return out.tobytes()


def _out(rows: np.ndarray, kind: int) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(rows[x]).astype(t)) for x, t in (("id", "i8"), ("h", "i8"), ("lo", "i4"), ("n", "i4"))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), kind, np.int32))], ["id", "h", "lo", "n", "kind"])


def _sorted(packed: list[bytes], depth: int) -> Iterator[pa.RecordBatch]:
    """One bucket: later members of equal stretches, and first members that share pass 3 with another stretch."""
    rows = np.frombuffer(b"".join(packed), _ANCHOR)
    columns = {name: np.ascontiguousarray(rows[name]) for name in _ANCHOR.names}
    order, first, later = _later([columns["g"], columns["c"]], [columns["id"], columns["h"], columns["lo"]])
    yield _out(rows[order[later]], COPY)
    heads = order[first]
    g = columns["g"][heads]
    many = np.zeros(len(heads), bool)
    if len(heads) > 1:
        same = g[1:] == g[:-1]
        many[1:] |= same
        many[:-1] |= same
    several = heads[many]
    g = columns["g"][several]
    last = columns["lo"][several].astype(np.int64) + columns["n"][several] - 1
    at = columns["lo"][several].astype(np.int64) + columns["back"][several]
    for k, (low, high) in enumerate(_offsets(depth)):
        digit = columns["cores"][several, k]
        by = np.lexsort((digit, g))
        same = (g[by][1:] == g[by][:-1]) & (digit[by][1:] == digit[by][:-1]) & (digit[by][1:] > 0)
        shared = np.zeros(len(by), bool)
        shared[by[1:][same]] = shared[by[:-1][same]] = True
        begin, end = np.maximum(at - high, columns["lo"][several]), np.minimum(at - low, last)
        shared &= begin <= end
        out = np.zeros(int(shared.sum()), _COPY)
        for name, column in (("id", columns["id"][several]), ("h", columns["h"][several]), ("lo", begin), ("n", end - begin + 1)):
            out[name] = column[shared]
        yield _out(out, OPEN)


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents and the span lists of their (id, h); texts stay where they are while the lists are few."""
    spans = stored(spans, "spans")
    size = spans.agg(F.sum(F.size("lo") * 8 + 64)).first()[0] or 0
    return docs.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, ["id", "h"], "left")


def _lists(spans: DataFrame, merged: int | None = None) -> DataFrame:
    """The stretches of every document, with `merged` joined into maximal runs of bytes (begin and length)."""
    lists = spans.groupBy("id", "h").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))
    if merged is None:
        return lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_merged(lo, n, merged) for lo, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            lo, n = ([pair[k].tolist() for pair in found] for k in (0, 1))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lo, kind), pa.array(n, kind)], ["id", "h", "lo", "n"])

    return lists.mapInArrow(run, "id long, h long, lo array<int>, n array<int>")


_WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8"), ("h", "<i8"), ("lo", "<i4"), ("n", "<u2")])


def _windows(docs: DataFrame, stretches: DataFrame, buckets: int, depth: int) -> DataFrame:
    """Pass 4: windows of open stretches that also begin earlier, as stretches of one window."""

    def digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                text = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint8)
                starts = np.unique(concat_ranges(*(np.array(batch.column(c)[k].as_py(), np.int64) for c in (3, 4))))
                for part in np.array_split(starts, len(starts) // SLICE_BYTES + 1):
                    cut = text[part[0] : part[-1] + depth]
                    at = part - part[0]
                    rows = np.zeros(len(part), _WINDOW)
                    rows["a"], rows["b"] = (span_hash(prefix(codes[cut]), at, at + depth) for codes in (BYTE_CODES, _OTHER_CODES))
                    rows["id"], rows["h"], rows["lo"], rows["n"] = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), part, 1
                    held.append(rows)
                    size += len(rows)
                    if size >= 1 << 17:
                        yield _dealt(np.concatenate(held), ["a", "b"], buckets)
                        held, size = [], 0
        if held:
            yield _dealt(np.concatenate(held), ["a", "b"], buckets)

    def finish(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(held), _WINDOW)
        order, _, later = _later([rows["a"], rows["b"]], [rows["id"], rows["h"], rows["lo"]])
        yield _out(rows[order[later]], COPY)

    open_docs = _with_spans(docs, _lists(stretches)).where("lo is not null").select("id", "h", F.col("text").cast("binary").alias("text"), "lo", "n")
    found = _sorted_by_bucket(open_docs.mapInArrow(digits, "bucket long, rows binary, copies binary"), finish)
    return found.select("id", "h", "lo", "n")


def repeated(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Stretches of windows that also begin earlier: id, h, lo (byte), n windows.

    `docs` has id, h and text; earlier is a smaller (id, h), or the same and an
    earlier byte.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = total // BUCKET_BYTES + 256
    spans = stored(_spans(docs.where("text is not null"), buckets, depth), "stretches")
    open_ones = spans.where(f"kind = {OPEN}").select("id", "h", "lo", "n")
    return spans.where(f"kind = {COPY}").select("id", "h", "lo", "n").unionByName(_windows(docs, open_ones, buckets, depth))


def _merged(lo: list[int], n: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the maximal byte runs covered by stretches of windows."""
    begin = np.array(lo, np.int64)
    end = begin + np.array(n, np.int64) - 1 + depth
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > reach[:-1])
    return begin[new], np.append(reach[:-1][new[1:]], reach[-1]) - begin[new]


def report(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed runs as begins and ends.

    `docs` has doc_id and text; other columns are ignored. Texts are UTF-8
    bytes, null is empty. A byte is removed if a string of `depth` bytes that
    covers it also starts earlier: in a document with smaller doc_id, or
    earlier in the same one; strings may overlap, never cross documents, and
    are judged on the input. Texts shorter than `depth` lose nothing. Every row
    gives one row. Rows equal in doc_id and text share one fate; rows that
    share only doc_id are ordered by a hash of their text; null doc_id comes
    first. An empty table gives no rows.
    """
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("h"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    joined = _with_spans(keyed, _lists(repeated(keyed, depth), depth)).select("id", "h", F.col("text").cast("binary").alias("text"), "lo", "n")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "begins", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names]
            for k in range(batch.num_rows):
                key, text = batch.column(0)[k].as_py(), memoryview(batch.column(2)[k].as_buffer())
                begin = np.array(batch.column(3)[k].as_py() or [], np.int64)
                end = begin + np.array(batch.column(4)[k].as_py() or [], np.int64)
                kept, at = hashlib.sha256(), 0
                for a, b in zip(begin, end):
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                row = (None if key == NO_ID else key, len(text), int((end - begin).sum()), len(begin), kept.hexdigest(), begin.tolist(), end.tolist())
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return joined.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, begins array<long>, ends array<long>"
    )
