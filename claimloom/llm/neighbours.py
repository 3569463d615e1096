"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Each tree halves a sample again and again at the median of its projection on
the difference of two sample vectors. All rows are then put into one leaf of
every tree. A query walks all trees through one priority queue, always taking
up the branch that lies nearest to its side of the splits, until it has
gathered enough leaves; the vectors in these leaves are scored exactly in
double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import table
from .shared import stored

_LEAVES = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("block", pa.int32()), ("vec_id", pa.int64()),
                     ("others", pa.list_(pa.int64())), ("vector", pa.binary())])
_PROBES = pa.schema([("tree", pa.int32()), ("leaf", pa.int32()), ("block", pa.int32()), ("query_id", pa.int64()),
                     ("vector", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


@dataclass(frozen=True)
class Settings:
    """How the forest is fitted and searched.

    `sample_rows` bounds what the driver fits the trees on (every row is
    indexed). Leaves hold about `leaf_rows` rows while the table has up to
    sample_rows * leaf_rows / least_sample rows and grow with it beyond.
    A query opens leaves until they hold `search_share` of all rows, and
    `search_rows` rows at least, over all trees together (a row found through
    two trees counts twice, so a share of 1.0 sees about two thirds of the
    rows). Vectors without structure need such a share for a recall of 0.95;
    clustered ones need far less. A leaf is cut into blocks of `block_rows`
    rows and `query_rows` queries, so no group outgrows a task.
    """

    trees: int = 8
    leaf_rows: int = 512
    sample_rows: int = 50_000
    least_sample: int = 8
    search_share: float = 1.0
    search_rows: int = 4_000
    block_rows: int = 4_096
    query_rows: int = 20_000
    seed: int = 7


class Forest:
    """Complete binary trees in heap order: unit normals and offsets per inner node."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, seed: int):
        self.depth, self.trees = depth, trees
        inner = (1 << depth) - 1
        width = sample.shape[1]
        self.normals = np.zeros((trees, inner, width), np.float32)
        self.offsets = np.zeros((trees, inner), np.float32)
        for tree in range(trees):
            rng = np.random.default_rng([seed, tree])
            groups = [np.arange(len(sample))]
            for level in range(depth):
                halves = []
                for k, rows in enumerate(groups):
                    node = (1 << level) - 1 + k
                    normal = np.zeros(width)
                    if len(rows) > 1:
                        a, b = rng.choice(rows, 2, replace=False)
                        normal = sample[a].astype(np.float64) - sample[b]
                    if not normal.any():
                        normal = rng.standard_normal(width)
                    normal /= np.linalg.norm(normal)
                    side = sample[rows] @ normal.astype(np.float32)
                    cut = np.float32(np.median(side)) if len(rows) else np.float32(0)
                    self.normals[tree, node], self.offsets[tree, node] = normal, cut
                    halves += [rows[side <= cut], rows[side > cut]]
                groups = halves

    def leaves(self, units: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        out = np.zeros((len(units), self.trees), np.int32)
        for tree in range(self.trees):
            node = np.zeros(len(units), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", units, self.normals[tree][node])
                node = 2 * node + 1 + (side > self.offsets[tree][node])
            out[:, tree] = node - ((1 << self.depth) - 1)
        return out

    def search(self, unit: np.ndarray, rows_in: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs in order of promise until their rows reach `wanted`."""
        inner = (1 << self.depth) - 1
        margins = self.normals @ unit - self.offsets if inner else np.zeros((self.trees, 0))
        queue = [(-np.inf, tree, 0) for tree in range(self.trees)]
        found, rows = [], 0.0
        while queue and rows < wanted:
            worst, tree, node = heapq.heappop(queue)
            if node >= inner:
                leaf = node - inner
                if rows_in[tree, leaf]:
                    found.append((tree, leaf))
                    rows += rows_in[tree, leaf]
                continue
            margin = float(margins[tree, node])
            heapq.heappush(queue, (max(worst, margin), tree, 2 * node + 1))
            heapq.heappush(queue, (max(worst, -margin), tree, 2 * node + 2))
        return found


def _numpy(column: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _units(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1)[:, None]).astype(np.float32)


def _usable(vectors: DataFrame, width: int, kind: np.dtype) -> DataFrame:
    """vec_id and the vector as bytes, of rows that have a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values = np.asarray(column.flatten(), dtype=kind).reshape(-1, width)
            with np.errstate(over="ignore", invalid="ignore"):
                norms = np.sqrt((values.astype(np.float64) ** 2).sum(axis=1))
            keep = np.flatnonzero(np.isfinite(values).all(axis=1) & np.isfinite(norms) & (norms > 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep)), pa.array([v.tobytes() for v in values[keep]], pa.binary())],
                names=["vec_id", "vector"],
            )

    e = F.col("embedding")
    whole = vectors.where(
        F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) == width) & ~F.exists(e, lambda x: x.isNull())
    )
    return whole.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, vector binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings()) -> DataFrame:
    """The k nearest rows found for every query row, by cosine: query_id, rank, vec_id, score.

    Both tables have vec_id and embedding (array of float or double); other
    columns are ignored. A row never finds its own vec_id. Vectors that are
    null, zero, hold null or non-finite components, or have another length
    than most take no part, nor do rows without vec_id. Equal scores are
    ordered by vec_id. Repeated rows count once; where one vec_id has several
    vectors, its best score counts. Empty tables give no rows. Equal vectors
    are indexed as one entry with their k + 1 smallest vec_ids, which is all
    that can appear in a result, so copies never fill a leaf.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    widths = (
        vectors.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("width"))
        .count().orderBy(F.desc("count"), "width").limit(1).collect()
    )
    if not widths:
        return empty
    width = widths[0]["width"]
    kind = np.dtype("float32" if "array<float>" in dict(vectors.dtypes)["embedding"] else "float64")

    pairs = _usable(vectors, width, kind).distinct()
    order = Window.partitionBy("vector").orderBy("vec_id")
    entries = stored(
        pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
        .groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("others"))
        .select(F.col("others")[0].alias("vec_id"), "others", "vector"),
        "vectors",
    )
    n = entries.count()
    if not n:
        return empty
    share = min(1.0, settings.sample_rows / n)
    near = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    picked = sorted((r["vec_id"], bytes(r["vector"])) for r in entries.where(near).select("vec_id", "vector").collect())
    sample = _units(np.frombuffer(b"".join(v for _, v in picked), kind).reshape(-1, width)) if picked else np.zeros((0, width))
    depth = int(np.ceil(np.log2(max(1, min(n / settings.leaf_rows, len(picked) / settings.least_sample)))))
    forest = Forest(sample, depth, settings.trees, settings.seed)

    def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(_numpy(batch.column(0), kind, width))
            counts = np.stack([np.bincount(x, minlength=1 << depth) for x in forest.leaves(units).T])
            tree, leaf = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(leaf), pa.array(counts[tree, leaf])], ["tree", "leaf", "n"])

    rows_in = np.zeros((settings.trees, 1 << depth), np.int64)
    sizes = entries.select("vector").mapInArrow(leaves_of, "tree long, leaf long, n long").groupBy("tree", "leaf")
    for r in sizes.agg(F.sum("n").alias("n")).collect():  # one row for each leaf of the forest
        rows_in[r["tree"], r["leaf"]] = r["n"]
    blocks = -(-rows_in // settings.block_rows)
    wanted = max(settings.search_share * n, settings.search_rows)
    asked = _usable(queries, width, kind).distinct()
    n_queries = asked.count()
    bands = max(1, -(-int(n_queries * min(1.0, wanted / n / settings.trees)) // settings.query_rows))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                units = _units(_numpy(part.column(2), kind, width))
                ids = part.column(0).to_numpy()
                spots = forest.leaves(units)
                for tree in range(settings.trees):
                    leaf = spots[:, tree]
                    yield table(_LEAVES, np.full(len(ids), tree, np.int32), leaf, (ids % blocks[tree][leaf]).astype(np.int32),
                                part.column(0), part.column(1), part.column(2))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                units = _units(_numpy(part.column(1), kind, width))
                spots = [(t, leaf, b, row) for row, u in enumerate(units)
                         for t, leaf in forest.search(u, rows_in, wanted) for b in range(blocks[t, leaf])]
                tree, leaf, block, row = np.array(spots, np.int32).reshape(-1, 4).T
                yield table(_PROBES, tree, leaf, block, part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)))

    keys = ["tree", "leaf", "block", "band"]
    ddl = "tree int, leaf int, block int"
    leaves = entries.mapInArrow(index, ddl + ", vec_id long, others array<long>, vector binary")
    leaves = leaves.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    probes = asked.mapInArrow(probe, ddl + ", query_id long, vector binary")
    probes = probes.withColumn("band", F.pmod(F.xxhash64("query_id"), F.lit(bands)).cast("int"))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            near = _numpy(right["vector"], kind, width).astype(np.float64)
            lengths = np.sqrt((near * near).sum(axis=1))
            others = right["others"].to_pylist()
            asking = left["query_id"].to_pylist()
            q = _numpy(left["vector"], kind, width).astype(np.float64)
            q_lengths = np.sqrt((q * q).sum(axis=1))
            take = min(k + 1, len(near))
            for begin in range(0, len(q), 256):
                rough = (q[begin : begin + 256] @ near.T) / lengths
                least = np.partition(rough, len(near) - take, axis=1)[:, len(near) - take]
                for j, row in enumerate(rough):
                    i = begin + j
                    spots = np.flatnonzero(row >= least[j] - 1e-9 * q_lengths[i])
                    scores = (near[spots] * q[i]).sum(axis=1) / (lengths[spots] * q_lengths[i])
                    best = sorted((-s, v) for s, p in zip(scores, spots) for v in others[p] if v != asking[i])[:k]
                    out[0] += [asking[i]] * len(best)
                    out[1] += [v for _, v in best]
                    out[2] += [-s for s, _ in best]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND)], schema=_FOUND)

    found = (
        probes.groupBy(*keys).cogroup(leaves.groupBy(*keys))
        .applyInArrow(rank, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
