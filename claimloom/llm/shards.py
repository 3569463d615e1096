"""Shards of nearly equal bytes by a histogram sort.

Rows are ordered by a hash of their text and then by a hash of their place in
the input. The limits between shards are found without sorting anything: in
every round all partitions count the bytes and rows below a list of candidate
keys, the counts narrow the interval that holds each limit, and new candidates
are set inside. Only counts reach the driver. When every limit is within
tolerance, each row is sent once, to the piece of a shard that holds its key.

Limits are first sought between different texts, so equal texts stay together;
a group of equal texts is cut only where no limit beside it is near enough,
and then by the second hash, which spreads even identical rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import table
from .shared import stored

#: A shard's limit may be off by this share of a shard, a piece's limit by this share of a piece.
TOLERANCE, PIECE_TOLERANCE = 0.01, 0.25
#: Bytes of one piece, the unit that a task sorts, and the most pieces of a shard (they grow beyond it).
PIECE_BYTES, MOST_PIECES = 8 << 20, 4096
#: Candidate keys in a round: for the first round and piece, and for a limit in later rounds.
FIRST_PROBES, PROBES = 8, 16

_HALF = 1 << 63
_LOWEST, _HIGHEST = 0, 1 << 128
_BINS = pa.schema([(x, pa.int64()) for x in ("bin", "bytes", "rows", "g0", "t0", "g1", "t1")])


@dataclass(frozen=True)
class Limit:
    """A key, and the bytes and rows whose keys are smaller."""

    key: int
    bytes: int
    rows: int


def _key(g: int, t: int) -> int:
    return (g + _HALF) << 64 | (t + _HALF)


def _halves(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([(k >> 64) - _HALF for k in keys], np.int64), np.array([(k & (1 << 64) - 1) - _HALF for k in keys], np.int64)


def bins(g: np.ndarray, t: np.ndarray, limit_g: np.ndarray, limit_t: np.ndarray) -> np.ndarray:
    """How many of the ordered limits are at or below each key (g, t)."""
    low, high = np.searchsorted(limit_g, g, "left"), np.searchsorted(limit_g, g, "right")
    out = low.astype(np.int64)
    same = np.flatnonzero(low < high)
    for at in np.unique(low[same]):
        rows = same[low[same] == at]
        out[rows] += np.searchsorted(limit_t[at : high[rows[0]]], t[rows], "right")
    return out


def _histogram(keyed: DataFrame, probes: list[int]) -> list[Limit]:
    """Exact bytes and rows below every probe, and below the smallest and behind the largest key between two probes."""
    limit_g, limit_t = _halves(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, t, size = (batch.column(k).to_numpy() for k in range(3))
            if not len(g):
                continue
            order = np.lexsort((t, g))
            g, t, size = g[order], t[order], size[order]
            at = bins(g, t, limit_g, limit_t)
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            last = np.append(first[1:], len(at)) - 1
            yield table(_BINS, at[first], np.add.reduceat(size, first), last - first + 1, g[first], t[first], g[last], t[last])

    found = keyed.select("g", "t", "size").mapInArrow(count, ", ".join(f"{f.name} long" for f in _BINS)).groupBy("bin").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
        F.min(F.struct("g0", "t0")).alias("low"), F.max(F.struct("g1", "t1")).alias("high"),
    )
    out, bytes_, rows = [], 0, 0
    for r in sorted(found.collect()):
        out.append(Limit(_key(*r["low"]), bytes_, rows))
        bytes_, rows = bytes_ + r["bytes"], rows + r["rows"]
        out.append(Limit(_key(*r["high"]) + 1, bytes_, rows))
        if r["bin"] < len(probes):
            out.append(Limit(probes[r["bin"]], bytes_, rows))
    return out


def _candidates(low: Limit, high: Limit, many: int) -> list[int]:
    """Keys strictly between two limits: those that begin a text's hash, or keys of the one hash there is."""
    first, last = low.key >> 64, (high.key - 1) >> 64
    base, end, scale = (first, last + 1, 64) if last > first else (low.key, high.key, 0)
    inner = end - base - 1
    many = min(many, inner)
    return [(base + (k * inner) // many) << scale for k in range(1, many + 1)] if inner > 0 else []


def limits(keyed: DataFrame, total: int, n: int, wanted: list[tuple[float, float]]) -> tuple[list[Limit], int]:
    """For every (bytes below, tolerance) a limit that near to it, or the nearest one there is; and the number of rounds."""
    ends = Limit(_LOWEST, 0, 0), Limit(_HIGHEST, total, n)
    between = {j: ends for j in range(len(wanted))}
    found: dict[int, Limit] = {}
    rounds = 0
    while between:
        spans = set(between.values())
        many = FIRST_PROBES * (len(wanted) + 1) if not rounds else PROBES
        probes = sorted({k for low, high in spans for k in _candidates(low, high, many)})
        points = sorted(_histogram(keyed, probes), key=lambda x: (x.key, x.bytes))
        rounds += 1
        below = [p.bytes for p in points]
        for j, (low, high) in list(between.items()):
            target, tolerance = wanted[j]
            at = bisect_right(below, target)
            # several keys may have the same bytes below: the largest of those not above the target, the smallest of those above
            near = [p for p in points[max(at - 1, 0) : at + 1]]
            low = max([low, *(p for p in near if p.bytes <= target)], key=lambda p: p.key)
            high = min([high, *(p for p in near if p.bytes > target)], key=lambda p: p.key)
            best = min(low, high, key=lambda p: abs(p.bytes - target))
            if abs(best.bytes - target) <= tolerance or not _candidates(low, high, 1):
                found[j] = best
                del between[j]
            else:
                between[j] = low, high
    return [found[j] for j in range(len(wanted))], rounds


def shard(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Every row with its shard (from 0) and its slot in it (gapless from 0); shards hold nearly equal bytes.

    A row counts as the UTF-8 bytes of `text` plus one; null is as long as
    empty. A limit between shards is off by at most `tolerance` of a shard, or
    by half of one row where a row is larger than that. Equal texts lie in
    one shard unless no limit between different texts is that near; which of
    them go where then follows doc_id and their place in the input. Slots
    follow the order of the keys. `docs` has doc_id and text; all columns and
    rows are kept, nulls and repeated rows too; `shard` and `slot` replace
    columns of these names. An empty table gives no rows.

    The table is stored with its keys, so that places hold when a task is run
    again; the rounds read the keys alone. Whole rows move once, in pieces of
    about `piece_bytes`; a row's slot is the exact number of rows in its shard
    below its piece, known from the counts, and its rank in the piece.
    """
    kept = docs.drop("shard", "slot")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = stored(
        kept.select(
            F.struct(*kept.columns).alias("doc"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.xxhash64(text).alias("g"),
            F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("t"),
        ),
        "keyed",
    )
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    pieces = max(1, min(MOST_PIECES, -(-total // (shards * piece_bytes))))
    every = shards * pieces
    wanted = [
        (total * j / every, tolerance * total / shards if j % pieces == 0 else PIECE_TOLERANCE * total / every) for j in range(1, every)
    ]
    cuts = limits(keyed, total, n, wanted)[0] if n else []
    # a limit of a piece never passes that of its shard
    for j in range(1, len(cuts)):
        cuts[j] = max(cuts[j - 1], cuts[j], key=lambda x: x.key)
    limit_g, limit_t = _halves([x.key for x in cuts])
    below = np.array([0, *(x.rows for x in cuts)], np.int64)
    before = below - np.repeat(below[::pieces], pieces)[: len(below)] if n else below

    @F.pandas_udf("piece long, before long")
    def place(g: pd.Series, t: pd.Series) -> pd.DataFrame:
        at = bins(g.to_numpy(), t.to_numpy(), limit_g, limit_t)
        return pd.DataFrame({"piece": at, "before": before[at]})

    placed = keyed.select("doc", "g", "t", place("g", "t").alias("at"))
    rank = F.row_number().over(W.partitionBy("at.piece").orderBy("g", "t"))
    return placed.select(
        *[F.col("doc").getField(c).alias(c) for c in kept.columns],
        F.floor(F.col("at.piece") / pieces).cast("int").alias("shard"), (F.col("at.before") + rank - 1).alias("slot"),
    )


def save(sharded: DataFrame, path: str) -> None:
    """Write shards as folders `shard=k`; rows are where they belong already, so nothing moves."""
    sharded.write.partitionBy("shard").parquet(path)
