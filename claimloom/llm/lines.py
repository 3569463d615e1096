"""Line dedup: later copies of repeated line runs are deleted.

Line sequences are treated as strings over line IDs and their suffixes are
grouped by distributed prefix doubling: suffixes equal in 2^j lines get one
name, and two names at a distance of 2^j give the name for 2^(j+1). A suffix
whose group has one member is settled and dropped from further rounds. Suffixes
equal in L lines form the interval of the suffix array with a longest common
prefix of L; the intervals in question here are those whose common prefix holds
a given number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .columns import BYTE_CODES, SMALL_SLICE, flat, mix, prefix, runs, signed, slices, span_hash
from .shared import stored

#: A repeated run is deleted if it holds at least this many words.
MIN_WORDS = 10
#: The polynomial hashes of lines longer than this can fail together on regular patterns; one of them gives way to a real digest.
LONG_LINE = 256
NO_ID = -(1 << 63)
_OTHER_CODES = mix(BYTE_CODES)
PLACE = ["id", "h", "i"]


def _line_limits(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of every line; a text has one line more than line feeds."""
    feeds = np.flatnonzero(data == 10)
    row_of_feed = np.searchsorted(offsets, feeds, "right") - 1
    rows = np.concatenate([np.arange(len(offsets) - 1), row_of_feed])
    begins = np.concatenate([offsets[:-1], feeds + 1])
    order = np.lexsort((begins, rows))
    rows, begins = rows[order], begins[order]
    last = np.append(rows[1:] != rows[:-1], True)
    ends = np.where(last, offsets[rows + 1], np.append(begins[1:] - 1, 0))
    return rows, begins, ends


def _windows(rows: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For every line, how many lines from it on, and up to it, hold `least` words; 0 if the text has no such."""
    sums = np.append(0, np.cumsum(words))
    at = np.arange(len(rows))
    first, last = np.searchsorted(rows, rows), np.searchsorted(rows, rows, "right")
    ahead = np.searchsorted(sums, sums[:-1] + least, "left")
    ahead = np.where(ahead <= last, np.maximum(ahead - at, 1), 0)
    behind = np.searchsorted(sums, sums[1:] - least, "right") - 1
    behind = np.where((behind >= first) & (sums[1:] >= least), np.maximum(at + 1 - behind, 1), 0)
    return ahead.astype(np.int32), behind.astype(np.int32)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SMALL_SLICE):
                data, offsets = flat(part.column(2))
                rows, begins, ends = _line_limits(data, offsets)
                word_begins, _ = runs(~((data == 0x20) | ((data >= 9) & (data <= 13))), offsets)
                words = np.searchsorted(word_begins, ends) - np.searchsorted(word_begins, begins)
                ahead, behind = _windows(rows, words, least)
                a, b = (signed(span_hash(prefix(codes[data]), begins, ends)) for codes in (BYTE_CODES, _OTHER_CODES))
                for k in np.flatnonzero(ends - begins > LONG_LINE):
                    b[k] = int.from_bytes(blake2b(data[begins[k] : ends[k]], digest_size=8).digest(), "little", signed=True)
                firsts = np.searchsorted(rows, rows)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array((np.arange(len(rows)) - firsts).astype(np.int32)),
                     pa.array(a), pa.array(b), pa.array(ahead), pa.array(behind)],
                    ["id", "h", "i", "a", "b", "ahead", "behind"],
                )

    return docs.mapInArrow(run, "id long, h long, i int, a long, b long, ahead int, behind int")


def _groups(members: DataFrame, keys: list[str]) -> DataFrame:
    """A name for every group of members that has several places."""
    place = F.struct(*PLACE)
    groups = members.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    return stored(groups.select(*keys, F.monotonically_increasing_id().alias("group")), "groups")


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Windows of lines that also begin at an earlier place: id, h, begin, length.

    `docs` has id, h and text. Earlier means a smaller (id, h), or the same and
    a smaller line number. From every line the shortest window with `least`
    words is taken, ahead and back; equal runs have equal windows, and the
    windows of a maximal repeated run that holds `least` words cover it.
    """
    lines = stored(_lines(docs.where("text is not null"), least), "lines")
    groups = _groups(lines, ["a", "b"])
    active = stored(lines.join(groups, ["a", "b"]).select(*PLACE, F.col("group").alias("name"), "ahead", "behind"), "level")
    asked = stored(
        active.where("ahead > 0").select("id", "h", "i", F.col("ahead").alias("length"))
        .unionByName(active.where("behind > 0").select("id", "h", (F.col("i") - F.col("behind") + 1).alias("i"), F.col("behind").alias("length")))
        .distinct(), "windows",
    )
    found, level = [], 0
    while True:
        step = 1 << level
        spot = active.select(*PLACE, "name")
        due = asked.where((F.col("length") >= step) & (F.col("length") < 2 * step)).join(spot, PLACE)
        ends = spot.select("id", "h", F.col("i").alias("tail"), F.col("name").alias("name2"))
        due = due.withColumn("tail", (F.col("i") + F.col("length") - step).cast("int")).join(ends, ["id", "h", "tail"])
        place = F.struct(*PLACE)
        first = due.groupBy("length", "name", "name2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
        later = due.join(first, ["length", "name", "name2"]).where(place != F.col("first"))
        found.append(stored(later.select("id", "h", F.col("i").alias("begin"), "length"), "runs"))
        if not asked.where(F.col("length") >= 2 * step).limit(1).count():
            return reduce(DataFrame.unionByName, found)
        after = spot.select("id", "h", (F.col("i") - step).cast("int").alias("i"), F.col("name").alias("name2"))
        pairs = stored(spot.join(after, PLACE), "pairs")
        groups = _groups(pairs, ["name", "name2"])
        active = stored(pairs.join(groups, ["name", "name2"]).select(*PLACE, F.col("group").alias("name")), "level")
        level += 1


def dedup(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated line runs; adds n_lines, n_removed and n_runs.

    `docs` has doc_id and text; all other columns are kept, but earlier
    n_lines, n_removed and n_runs are replaced. Lines end at line feeds and are
    compared byte by byte; words are what stands between white space. A line is
    deleted if it lies in a run of lines with at least `least` words that also
    occurs earlier: in a document with smaller doc_id, or further up in the
    same one. Occurrences may overlap, and runs are judged on the input. What is
    left is joined by line feeds, and a text of which nothing is left is empty.
    A null text stays null and has no lines. Rows equal in doc_id and text
    share one fate; rows that share only doc_id are ordered by a hash of their
    text; null doc_id comes first. n_runs counts maximal stretches of deleted
    lines. An empty table gives no rows.
    """
    base = docs.drop("n_lines", "n_removed", "n_runs")
    key = (F.coalesce(base["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(base["text"]))
    runs_of = repeated_runs(base.select(key[0].alias("id"), key[1].alias("h"), "text"), least)
    by_doc = runs_of.groupBy("id", "h", "begin").agg(F.max("length").alias("length")).groupBy("id", "h").agg(
        F.collect_list("begin").alias("begins"), F.collect_list("length").alias("lengths")
    ).select(F.col("id").alias("__id"), F.col("h").alias("__h"), "begins", "lengths")
    joined = base.join(by_doc, (key[0] == by_doc["__id"]) & (key[1] == by_doc["__h"]), "left").select(
        *(base[c].alias(f"c{k}") for k, c in enumerate(base.columns)), by_doc["begins"], by_doc["lengths"]
    )
    added = StructType.fromDDL("n_lines long, n_removed long, n_runs long")
    schema = StructType(base.schema.fields + added.fields)
    text_at, width = base.columns.index("text"), len(base.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts, counts = [], [[], [], []]
                for text, begins, lengths in zip(*(part.column(k) for k in (text_at, width, width + 1))):
                    text, begins, lengths = text.as_py(), begins.as_py(), lengths.as_py()
                    n = 0 if text is None else text.count("\n") + 1
                    gone = np.zeros(n + 1, np.int64)
                    if begins:
                        np.add.at(gone, begins, 1)
                        np.add.at(gone, np.array(begins) + lengths, -1)
                    gone = np.cumsum(gone)[:n] > 0
                    if gone.any():
                        text = "\n".join(line for line, out in zip(text.split("\n"), gone) if not out)
                    texts.append(text)
                    for c, v in zip(counts, (n, int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if n else 0)):
                        c.append(v)
                out = [part.column(k) for k in range(width)]
                out[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(out + [pa.array(c, pa.int64()) for c in counts], names=columns_out)

    columns_out = [f.name for f in schema]
    return joined.mapInArrow(run, schema)
