"""Text columns as flat byte buffers: slices of bounded size, word spans and span hashes in numpy.

All functions work on one Arrow batch inside a task. Hashes are 64 bits wide,
depend on the bytes alone, and are the same in every task and session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; the arrays beside them take up to about forty times as much.
SLICE_BYTES = 2 << 20
#: The same where nothing is gained by seeing much text together.
SMALL_SLICE = 512 << 10

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULTIPLIER)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = pc.fill_null(array, b"" if "binary" in str(array.type) else "")
    _, offsets, data = array.buffers()
    n = len(array)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offsets, kind)[array.offset : array.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def give_back() -> None:
    """Return what Arrow holds of earlier batches; an idle worker would keep it until it ends."""
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most `limit` bytes of text each; a longer row comes alone."""
    give_back()
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), n)
        yield batch.slice(begin, end - begin)
        begin = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of True; a run never crosses a row's limit."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(mask) + 1, bool)
    before[0], before[1:] = False, mask
    after = np.empty(len(mask) + 1, bool)
    after[-1], after[:-1] = False, mask
    inner = offsets[(offsets > 0) & (offsets < len(mask))]
    before[inner] = False
    begins = np.flatnonzero(mask & ~before[:-1])
    after[inner] = False
    ends = np.flatnonzero(mask & ~after[1:]) + 1
    return begins, ends


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        for key, base in (("up", _MULTIPLIER), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span_hash` reads the hash of any stretch of `codes`."""
    up, _ = _power(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [begin, end); equal contents give equal hashes wherever they stand."""
    _, down = _power(len(sums))
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * _MULTIPLIER)


def concat_ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [begin, begin + length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.repeat(begins - firsts, lengths) + np.arange(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
