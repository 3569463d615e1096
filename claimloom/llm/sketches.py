"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch holds its k
smallest. Inverted lists of the retained values bring documents together, the
bottom k of the union of two sketches estimates their similarity, and the full
shingle sets confirm it.

Which links can be lost: of the k smallest values of a union, those in both
sets number Binomial(k, J), and each is in both sketches. With k = 32 and
J >= 0.8 fewer than 9 are shared with a probability of 3e-11; candidates and
estimates ask for no more. Sets of up to k shingles are compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import BYTE_CODES, SMALL_SLICE, flat, give_back, lower_ascii, mix, prefix, runs, signed, slices, span_hash
from .components import components
from .shared import small_batches, stored

SHINGLE_WORDS = 5
SKETCH = 32
#: Shared values of two sketches, of SKETCH, that every link has but for the chance stated above.
LEAST_SHARED = 9
#: Lists up to this length are compared member by member.
SHORT_LIST = 64
#: Stored keys up to this number are sent to every executor, more are shuffled.
BROADCAST_ROWS = 500_000
NO_ID = -(1 << 63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, one row after the other, and their offsets."""
    data = lower_ascii(data)
    begins, ends = runs(~((data == 0x20) | ((data >= 9) & (data <= 13))), offsets)
    hashes = span_hash(prefix(BYTE_CODES[data]), begins, ends)
    first = np.searchsorted(begins, offsets[:-1])
    n_words = np.searchsorted(begins, offsets[1:]) - first
    rows = np.repeat(np.arange(len(n_words)), np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0))
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(len(n_words) + 1, np.int64)
    counts = np.bincount(rows, minlength=len(n_words))
    starts = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + first[rows]
    last = first[rows] + n_words[rows]
    value = np.zeros(len(rows), np.uint64)
    for k in range(size):
        there = starts + k < last
        word = hashes[np.minimum(starts + k, len(hashes) - 1)]
        value = np.where(there, mix(value * np.uint64(0xD6E8FEB86659FD93) + word + np.uint64(k + 1)), value)
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.append(True, (value[1:] != value[:-1]) | (rows[1:] != rows[:-1]))
    value, rows = value[new], rows[new]
    return value, np.searchsorted(rows, np.arange(len(n_words) + 1))


def _key(docs: DataFrame) -> DataFrame:
    """Rows are known by doc_id and a hash of their text: rows equal in both have one fate."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("h"), "text"
    )


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SMALL_SLICE):
                data, offsets = flat(part.column(2))
                values, cut = shingle_sets(data, offsets, size)
                lows, marks = [], []
                for a, b in zip(cut[:-1], cut[1:]):
                    lows.append(values[a : min(b, a + SKETCH)].tobytes())
                    marks.append(hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(cut)), pa.array(marks, pa.binary()), pa.array(lows, pa.binary())],
                    ["id", "h", "n", "mark", "sketch"],
                )

    return docs.mapInArrow(run, "id long, h long, n long, mark binary, sketch binary")


def _values(classes: DataFrame) -> DataFrame:
    """One row for each retained value: value, class, n, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(2))
            values, counts = data.view(np.uint64), np.diff(offsets) // 8
            rows = np.repeat(np.arange(len(counts)), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(values.copy())), batch.column(0).take(pa.array(rows)),
                 batch.column(1).take(pa.array(rows)), pa.array(counts[rows].astype(np.int32))],
                ["value", "class", "n", "kept"],
            )

    return classes.select("class", "n", "sketch").mapInArrow(run, "value long, class long, n long, kept int")


def _estimated(pairs: DataFrame, classes: DataFrame, least_percent: int) -> DataFrame:
    """Pairs (a, b) that the union of their sketches doesn't rule out."""

    def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = flat(column)
        counts = np.diff(offsets) // 8
        out = np.full((len(counts), SKETCH), ~np.uint64(0))  # larger than any value but with a chance of 2^-64
        out[np.arange(SKETCH) < counts[:, None]] = data.view(np.uint64)
        return out, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            (x, x_kept), (y, y_kept) = matrix(batch.column(2)), matrix(batch.column(3))
            both = np.sort(np.concatenate([x, y], axis=1), axis=1)
            twice = np.zeros(both.shape, bool)
            twice[:, :-1] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != ~np.uint64(0))
            again = np.zeros(both.shape, bool)
            again[:, 1:] = twice[:, :-1]
            place = np.cumsum(~again, axis=1)  # among the distinct values of the union
            union = x_kept + y_kept - twice.sum(axis=1)
            shared = (twice & (place <= SKETCH)).sum(axis=1)
            n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            whole = (x_kept == n) & (y_kept == m)
            keep = np.where(
                whole, 100 * (x_kept + y_kept - union) >= least_percent * union,
                SKETCH * shared >= LEAST_SHARED * np.minimum(union, SKETCH),
            )
            yield batch.select([0, 1]).filter(pa.array(keep))

    side = classes.select("class", "n", "sketch")
    both = pairs.join(side.toDF("a", "n_a", "sketch_a"), "a").join(side.toDF("b", "n_b", "sketch_b"), "b")
    return both.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(run, "a long, b long")


def _full_sets(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The full shingle sets of classes (class, id, h); texts of other documents are not moved."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(wanted) if few else wanted, ["id", "h"]).select("class", "text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SMALL_SLICE):
                values, cut = shingle_sets(*flat(part.column(1)), size)
                sets = [values[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["class", "shingles"])

    with small_batches(docs.sparkSession, 500):
        return stored(texts.mapInArrow(full, "class long, shingles binary").dropDuplicates(["class"]), "shingles")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, least_percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    pairs = stored(pairs, "pairs")
    named = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    sets = _full_sets(stored(named.join(classes.select("class", "id", "h"), "class"), "candidates"), docs, size)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= least_percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    with small_batches(docs.sparkSession, 200):
        return stored(both.mapInArrow(compare, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, least_percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    `docs` has doc_id and text; other columns are ignored. Two documents are
    linked if 100 * |intersection| >= least_percent * |union| of their sets of
    `size`-word shingles (least_percent 80 or more); with fewer words the whole
    text is one shingle. A null text or one without words has an empty set and
    is linked with nothing. component_id is the smallest doc_id of all that
    links lead to, kept says that it is the row's own. Every row gives one row;
    repeated rows are copies of each other. A row without doc_id is linked like
    any other but gives no component its id; a component of such rows has none
    and they are kept. An empty table gives no rows.

    Documents with equal sets are one class, and only one of a class is
    compared. In every inverted list, all are first compared with the list's
    first class only; after that, only members of different components are, in
    lists up to SHORT_LIST. A class with enough of its sketch in longer lists
    may share none of these with a class it is linked with. Such classes are
    joined again by the rarest values of their full sets: in short lists as
    before, in long ones with the class that has the fewest values of its own,
    and then where the counts of such values leave room for a link.
    """
    return _judged(docs, size, least_percent).drop("id", "h")


def _judged(docs: DataFrame, size: int, least_percent: int) -> DataFrame:
    """The rows of `near_duplicates`, each with the id and hash it is known by."""
    keyed = _key(docs)
    with small_batches(docs.sparkSession, 2000):
        rows = stored(_sketch(keyed, size), "sketches")
    grouped = (
        rows.where("n > 0").groupBy("mark").agg(F.min("id").alias("id"), F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("least_id"))
    )
    firsts = rows.where("n > 0").join(grouped, ["mark", "id"]).groupBy("mark", "id", "least_id").agg(
        F.min("h").alias("h"), F.max("n").alias("n"), F.max("sketch").alias("sketch")
    )
    classes = stored(firsts.withColumn("class", F.monotonically_increasing_id()), "classes")

    values = stored(_values(classes), "values")
    sizes = values.groupBy("value").agg(F.count("*").alias("length"), F.min("class").alias("first")).where("length > 1")
    lists = stored(values.join(sizes, "value"), "lists")
    stars = lists.where("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b")).distinct()
    links = _confirmed(_estimated(stars, classes, least_percent), classes, keyed, size, least_percent)

    roots = components(links)
    part = stored(
        lists.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")), "list-roots"
    )
    side = "value", "class", "n", "root"
    short = part.where(F.col("length") <= SHORT_LIST).select(*side)
    open_short = short.join(_divided(short, "value"), "value")
    pairs = _across(open_short, "value", least_percent)

    heavy = part.where(F.col("length") > SHORT_LIST).groupBy("class").agg(F.count("*").alias("in_long"), F.max("kept").alias("kept")).where(
        F.col("in_long") * SKETCH >= F.col("kept") * LEAST_SHARED
    )
    known = stored(classes.join(heavy, "class").select("class", "id", "h"), "heavy")
    full = _prefixes(_full_sets(known, keyed, size), least_percent)
    centres = full.where(F.col("length") > SHORT_LIST).groupBy("value").agg(
        F.min_by("class", F.struct(F.col("own") / F.col("n"), "class")).alias("a")
    )
    centre = full.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("own").alias("own_a")).distinct()
    rays = (
        full.where(F.col("length") > SHORT_LIST).select("value", F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("own").alias("own_b"))
        .join(centres, "value").where("a <> b").select("a", "b", "n_b", "own_b").distinct().join(centre, "a")
        .where(_can_link(least_percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    links = links.unionByName(_confirmed(_estimated(rays, classes, least_percent), classes, keyed, size, least_percent))
    roots = components(links)
    rooted = stored(
        full.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")), "prefix-roots"
    )
    rare = rooted.where(F.col("length").between(2, SHORT_LIST))
    common = rooted.where(F.col("length") > SHORT_LIST)
    pairs = pairs.unionByName(_across(rare.join(_divided(rare, "value"), "value"), "value", least_percent)).unionByName(
        _across(common.join(_divided(common, "value"), "value"), "value", least_percent, _can_link(least_percent))
    ).distinct()
    more = _confirmed(_estimated(pairs, classes, least_percent), classes, keyed, size, least_percent)

    roots = components(links.unionByName(more))
    class_of = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = class_of.groupBy("root").agg(F.min("least_id").alias("component"))
    of_mark = class_of.join(smallest, "root").select("mark", "component")
    own = F.when(F.col("id") != NO_ID, F.col("id"))
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(own)
    return rows.join(of_mark, "mark", "left").select(
        own.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), own.eqNullSafe(component).alias("kept"), "id", "h"
    )


def _divided(members: DataFrame, *keys: str) -> DataFrame:
    """Lists whose members are in more than one component."""
    return members.groupBy(*keys).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*keys)


def _can_link(least_percent: int) -> F.Column:
    """Whether two sets that share none of their `own` values can be similar enough.

    They differ in all own values, and in the numbers of the others at least;
    linked sets differ in (100 - p) / (100 + p) of their summed sizes at most.
    """
    rest = F.abs((F.col("n_a") - F.col("own_a")) - (F.col("n_b") - F.col("own_b")))
    return (100 + least_percent) * (F.col("own_a") + F.col("own_b") + rest) <= (100 - least_percent) * (F.col("n_a") + F.col("n_b"))


def _across(members: DataFrame, key: str, least_percent: int, also: F.Column | None = None) -> DataFrame:
    """Pairs of one list in different components, of sizes that can be linked."""
    columns = [c for c in ("class", "n", "root", "own") if c in members.columns]
    left, right = (members.select(key, *(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in "ab")
    smaller, larger = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    fits = (F.col("class_a") < F.col("class_b")) & (F.col("root_a") != F.col("root_b")) & (100 * smaller >= least_percent * larger)
    met = left.join(right, key).where(fits if also is None else fits & also)
    return met.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def _prefixes(sets: DataFrame, least_percent: int) -> DataFrame:
    """The rarest values of full sets: value, length, class, n, own.

    Values are ordered by the length of their lists among these sets, then by
    value. Linked sets share a value of their first n - p/100 n + 1 ones. `own`
    counts the values of a set in lists up to SHORT_LIST.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            data, offsets = flat(batch.column(1))
            counts = np.diff(offsets) // 8
            rows = np.repeat(np.arange(batch.num_rows), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(data.view(np.uint64).copy())), batch.column(0).take(pa.array(rows)), pa.array(counts[rows])],
                ["value", "class", "n"],
            )

    with small_batches(sets.sparkSession, 500):
        values = stored(sets.select("class", "shingles").mapInArrow(run, "value long, class long, n long"), "heavy-values")
    lengths = values.groupBy("value").agg(F.count("*").alias("length"))
    placed = values.join(lengths, "value")
    order = Window.partitionBy("class").orderBy("length", "value")
    first = F.col("n") - F.ceil(F.col("n") * least_percent / 100) + 1
    own = F.sum((F.col("length") <= SHORT_LIST).cast("int")).over(Window.partitionBy("class"))
    return stored(
        placed.withColumn("own", own).withColumn("place", F.row_number().over(order)).where(F.col("place") <= first)
        .select("value", "length", "class", "n", "own"),
        "prefixes",
    )


def one_of_each(docs: DataFrame, size: int = SHINGLE_WORDS, least_percent: int = 80) -> DataFrame:
    """The documents that are the first of their component, all columns kept; other rows with the same doc_id or none stay."""
    gone = _judged(docs, size, least_percent).where("not kept").select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
    own_id = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    return docs.join(gone, (own_id == gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__h"]), "left_anti")
