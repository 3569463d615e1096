"""Benchmark decontamination with a positional inverted index.

The words of the training documents that also occur in a benchmark are stored
as postings (row, term, position), in document order and without a shuffle;
one end mark per document, term 0, stands at its word count. A benchmark
window is looked up through its rarest word: that word's postings, moved by
its offset in the window, are the candidate starts. They are intersected with
the moved list of the next rarest word, and what is left with the lists of all
other words, which proves the phrase. Everything is DataFrame work: arrays,
joins and grouped counts.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: A stored table goes to every executor only when it has at most this many rows (of some 60 bytes); else it is shuffled.
BROADCAST_ROWS = 500_000


def words(text) -> F.Column:
    """The words of a text, A-Z in lower case; none for null."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


@dataclass
class Windows:
    """Distinct windows of a benchmark, stored."""

    items: DataFrame  # win, item_id
    terms: DataFrame  # win, offset, term, size
    vocabulary: DataFrame  # term, word


@dataclass
class Index:
    """Stored postings of the vocabulary's words, and the end marks of all documents."""

    postings: DataFrame  # row, term, pos
    documents: DataFrame  # row, doc_id, h (hash of the text), n_words


def windows(benchmark: DataFrame, size: int = WINDOW) -> Windows:
    """Cut items into windows of `size` words; a shorter item is one window, an item without words none.

    `benchmark` has item_id and text. Equal windows of several items are one
    window. An item without item_id takes part in hits but is not listed.
    """
    w = F.col("words")
    cut = (
        benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size(w) > 0)
        .select("item_id", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))).alias("at"))
        .select("item_id", F.slice(w, F.col("at") + 1, size).alias("words"))
    )
    distinct = stored(cut.select("words").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
    items = stored(cut.join(distinct, "words").select("win", "item_id").distinct(), "window-items")
    spread = distinct.select("win", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word"))
    vocabulary = stored(
        spread.select("word").distinct().select((F.monotonically_increasing_id() + 1).alias("term"), "word"), "vocabulary"
    )
    terms = stored(spread.join(vocabulary, "word").select("win", "offset", "term", "size"), "window-terms")
    return Windows(items, terms, vocabulary)


def index(docs: DataFrame, vocabulary: DataFrame) -> Index:
    """Store the postings of all words of `vocabulary` in whole documents, in one pass over the texts."""
    end = vocabulary.sparkSession.sql("select 0L as term, '' as word")
    known = _small(stored(vocabulary.unionByName(end), "terms"))
    tokens = (
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.xxhash64("text").alias("h"),
            F.concat(words(F.col("text")), F.array(F.lit(""))).alias("words"),
        )
        .select("row", "doc_id", "h", F.posexplode("words").alias("pos", "word"))
    )
    postings = stored(
        tokens.join(known, "word").select(
            "row", *(F.when(F.col("term") == 0, F.col(c)).alias(c) for c in ("doc_id", "h")), "term", "pos"
        ),
        "postings",
    )
    return Index(
        postings.where("term <> 0").select("row", "term", "pos"),
        postings.where("term = 0").select("row", "doc_id", "h", F.col("pos").cast("long").alias("n_words")),
    )


def _ranked(found: Index, wanted: Windows) -> DataFrame:
    """Window terms with their place in order of rarity; windows with a word that no document has are left out."""
    counts = found.postings.groupBy("term").count()
    by_rarity = Window.partitionBy("win").orderBy("count", "term", "offset")
    all_of = Window.partitionBy("win")
    return stored(
        wanted.terms.join(counts, "term")
        .withColumn("present", F.count("*").over(all_of)).where("present = size")
        .withColumn("place", F.row_number().over(by_rarity)).drop("present"),
        "ranked-terms",
    )


def _first(found: Index, ranked: DataFrame) -> DataFrame:
    """Candidate starts from each window's rarest word."""
    rarest = _small(ranked.where("place = 1").select("win", "term", "offset", "size"))
    return (
        found.postings.join(rarest, "term").where("pos >= offset")
        .select("row", "win", (F.col("pos") - F.col("offset")).alias("start"), "size")
    )


def phrase_matches(found: Index, wanted: Windows) -> DataFrame:
    """Every occurrence of every window: row, win, start, size."""
    ranked = _ranked(found, wanted)
    first = _first(found, ranked)

    second_terms = _small(ranked.where("place = 2").select("win", "term", "offset"))
    second_lists = found.postings.join(_small(stored(second_terms.select("term").distinct(), "second-terms")), "term", "left_semi")
    expected = first.join(second_terms, "win", "left").select(
        "row", "win", "start", "size", "term", (F.col("start") + F.col("offset")).alias("pos")
    )
    alone = expected.where("term is null").select("row", "win", "start", "size")  # windows of one word
    both = stored(
        expected.where("term is not null").join(second_lists, ["row", "term", "pos"], "left_semi")
        .select("row", "win", "start", "size").unionByName(alone),
        "candidates",
    )

    rest = _small(stored(ranked.where("place > 2").select("win", "term", "offset"), "other-terms"))
    probes = both.where("size > 2").join(rest, "win").select(
        "row", "win", "start", "size", "term", (F.col("start") + F.col("offset")).alias("pos")
    )
    rows = _small(stored(both.where("size > 2").select("row").distinct(), "candidate-rows"))
    lists = found.postings.join(rows, "row", "left_semi")
    proved = (
        probes.join(lists, ["row", "term", "pos"], "left_semi")
        .groupBy("row", "win", "start", "size").count().where("count = size - 2").drop("count")
    )
    return stored(proved.unionByName(both.where("size <= 2")), "matches")


def proximity_matches(found: Index, wanted: Windows, slop: int) -> DataFrame:
    """Stretches of at most size + slop words that hold every word of a window, in any order.

    Returns row, win, begin, end (exclusive): the shortest stretch from each of
    its first words, around each place of the window's rarest word.
    """
    ranked = _ranked(found, wanted)
    terms = ranked.groupBy("win", "term", "size").agg(F.min("place").alias("place"))
    n_terms = terms.groupBy("win").agg(F.count("*").alias("n_terms"))
    anchors = (
        found.postings.join(terms.where("place = 1"), "term")
        .select("row", "win", F.col("pos").alias("anchor"), (F.col("size") + slop - 1).alias("reach"))
    )
    # a posting lies near an anchor if it is in the same or a neighbouring stretch of `reach` + 1 positions
    near = (
        anchors.join(terms.select("win", "term"), "win")
        .withColumn("cell", F.explode(F.expr("sequence(anchor div (reach + 1) - 1, anchor div (reach + 1) + 1)")))
    )
    placed = (
        found.postings.join(wanted.terms.select("term", (F.col("size") + slop - 1).alias("reach")).distinct(), "term")
        .withColumn("cell", F.expr("pos div (reach + 1)"))
    )
    around = (
        near.join(placed, ["row", "term", "reach", "cell"]).where("abs(pos - anchor) <= reach")
        .select("row", "win", "anchor", "reach", "term", "pos")
    )
    starts = around.where("pos <= anchor").select("row", "win", "anchor", F.col("pos").alias("begin")).distinct()
    firsts = (
        starts.join(around, ["row", "win", "anchor"]).where("pos between begin and begin + reach")
        .groupBy("row", "win", "anchor", "begin", "term").agg(F.min("pos").alias("pos"))
        .groupBy("row", "win", "anchor", "begin").agg(F.count("*").alias("n"), (F.max("pos") + 1).alias("end"))
    )
    return firsts.join(n_terms, "win").where("n = n_terms and end > anchor").select("row", "win", "begin", "end").distinct()


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    `docs` has doc_id and text, `benchmark` item_id and text; other columns are
    ignored. Every row of `docs` gives one row, also with repeated or null
    doc_id. A null or empty text has no words and no hits; empty tables give no
    rows or no hits. A word counts as hit if any occurrence of any window
    covers it.
    """
    return _judged(docs, benchmark, size).drop("h")


def _judged(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """The rows of `report`, each with the hash of its text."""
    wanted = windows(benchmark, size)
    found = index(docs, wanted.vocabulary)
    matches = phrase_matches(found, wanted)
    covered = (
        matches.select("row", F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos"))
        .distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    )
    items = (
        matches.select("row", "win").distinct().join(wanted.items.where("item_id is not null"), "win")
        .select("row", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    hits, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return (
        found.documents.join(covered, "row", "left").join(items, "row", "left")
        .select(
            "doc_id", "n_words", hits.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"), "h",
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without any hit, all columns kept; of rows that share a doc_id all go if one is hit."""
    dirty = report(docs, benchmark, size).where("contaminated").select(F.col("doc_id").alias("__dirty")).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["__dirty"]), "left_anti")


def clean_rows(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows without any hit, all columns kept; other rows with the same doc_id or none stay."""
    dirty = _judged(docs, benchmark, size).where("contaminated").select(F.col("doc_id").alias("__dirty"), F.col("h").alias("__h")).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["__dirty"]) & (F.xxhash64(docs["text"]) == dirty["__h"]), "left_anti")
