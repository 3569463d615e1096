"""Spelling variants: words one edit apart, found by a frontier that walks a trie held as a table.

The trie is an edge table (node, letter, child); a node stands for a prefix of
the words of one length. Each word walks the tries of its own length and of one
letter more as states (word, position, node, edits), all words at once, one
level for one join. A state follows the edge of the letter due, or one of
another letter as its one edit: a replacement in the trie of its own length, an
insertion in the other one. States without an edge die. Deletions need no
states: they are insertions seen from the other word.

An edit lies in the second half of a word or in the second half of the word
read backwards. So every word walks forwards and backwards and may edit in its
second half only; the first half leads to one node, where the walk begins, and
the crowded upper levels are never searched. An edge below which there is a
single word names that word, and the walk ends there.

Nodes are 64-bit hashes. A collision can only add a candidate, and every pair
is compared by its real edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import give_back
from .shared import small_batches, stored

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in so many loses a letter; least letters and occurrences of a word; how much more frequent its form must be.
DROP_ONE_IN, LEAST_LETTERS, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Distinct words a task counts at once.
KEPT_WORDS = 200_000
#: Rows handed to a Python worker at once.
BATCH_ROWS = 1000
#: Prefixes of words that a task writes in one batch.
PREFIX_ROWS = 20_000

_PRIME, _MASK = 0x100000001B3, (1 << 64) - 1


def variants_of(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """Words of one text and how often each occurs, after the letters are dropped that chance picks."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(LETTERS.findall(text or "")).items():
        data = run.encode().lower()  # of bytes, lower() touches A to Z alone
        word, h = data.decode(), zlib.crc32(data, start)
        if h % DROP_ONE_IN == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, over whole texts; counted in every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            give_back()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in variants_of(doc_id, text.as_py()):
                    if len(word) >= least_letters:
                        seen[word] += n
                if len(seen) >= KEPT_WORDS:
                    yield out()
        yield out()

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


_PREFIXES = pa.schema([
    ("back", pa.bool_()), ("word", pa.string()), ("longer", pa.bool_()), ("depth", pa.int32()), ("node", pa.int64()), ("letter", pa.string()),
    ("child", pa.int64()),
])


def _nodes(text: str, seed: int) -> list[int]:
    """The node of every prefix of a text, in the trie of a seed."""
    out = [seed * 0x9E3779B97F4A7C15 & _MASK]
    for letter in text:
        node = ((out[-1] ^ ord(letter)) * _PRIME + 1) & _MASK
        out.append(node ^ node >> 29)
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _prefixes(words: DataFrame) -> DataFrame:
    """Edges of every word, forwards and backwards, from the half on; and, with letter null, where it begins to walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _PREFIXES)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_PREFIXES)

        for batch in batches:
            for word in batch.column(0).to_pylist():
                n, half = len(word), len(word) // 2
                for back in (False, True):
                    text = word[::-1] if back else word
                    own, other = _nodes(text, 2 * n + back), _nodes(text[:half], 2 * (n + 1) + back)
                    rows.append((back, word, False, half, own[half], None, None))
                    rows.append((back, word, True, half, other[half], None, None))
                    # words one letter shorter begin at half their length
                    for depth in range((n - 1) // 2, n):
                        rows.append((back, word, None, depth, own[depth], text[depth], own[depth + 1]))
                        if len(rows) >= PREFIX_ROWS:
                            yield out()
        if rows:
            yield out()

    ddl = "back boolean, word string, longer boolean, depth int, node long, letter string, child long"
    return words.select("word").mapInArrow(run, ddl)


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (word, other) of words that differ by exactly one inserted, deleted or replaced code point, both ways round.

    `words` has distinct `word`s of two code points at least. The number of
    rounds is at most the length of the longest prefix or suffix that two words
    of one length share; each round is one join on the nodes and is stored.
    """
    prefixes = stored(_prefixes(words), "prefixes")
    edges = stored(
        prefixes.where("letter is not null").groupBy("depth", "node", "letter", "child").agg(
            F.when(F.count(F.lit(1)) == 1, F.min("word")).alias("only")
        ),
        "trie",
    )
    text = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("text")
    starts = prefixes.where("letter is null").select("word", text, "longer", F.col("depth").alias("place"), "depth", "node", F.lit(0).alias("edits"))
    low, last_start = starts.agg(F.min("depth"), F.max("depth")).first()
    if low is None:
        return words.select("word", F.col("word").alias("other"))
    frontier, found, depth = starts.where("false"), [], low
    while True:
        at = frontier.unionByName(starts.where(F.col("depth") == depth)).drop("depth")
        step = at.join(edges.where(F.col("depth") == depth).drop("depth"), "node")
        due = F.substring("text", F.col("place") + 1, F.lit(1)) == F.col("letter")
        only, own = F.col("only"), F.col("word")
        moved = step.where(due | (F.col("edits") == 0)).select(
            "word", "text", "longer", (F.col("place") + F.when(~due & F.col("longer"), 0).otherwise(1)).alias("place"), F.lit(depth + 1).alias("depth"),
            F.col("child").alias("node"), F.when(due, F.col("edits")).otherwise(1).alias("edits"), "only",
        )
        result = stored(moved.where(only.isNull() | (F.levenshtein(own, only, 1) == 1)), "frontier")
        found.append(result.where("only is not null").select("word", F.col("only").alias("other")))
        frontier = result.where("only is null").drop("only")
        depth += 1
        if depth > last_start and frontier.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def spelling(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Words of a corpus with their number of variants, their usual form and the root of it.

    Words are the maximal runs of `LETTERS` of whole texts, with A to Z lower-cased;
    of a run for which crc32("<doc_id>:<run>") is divisible by `DROP_ONE_IN`
    one code point is left out. Kept are distinct results of `LEAST_LETTERS` code
    points and `LEAST_COUNT` occurrences, over all rows. Columns: word; form,
    the near word of largest n (ties: smallest in code-point order) if its n is
    at least `ratio` times the word's; root, the last word on following forms
    (the word itself without a form); n; n_near; form_n.

    `docs` has doc_id and text; other columns are ignored. Every row counts,
    repeated ones too; null texts have no words, and a null doc_id is written as
    nothing before the colon. An empty table gives no rows.
    """
    with small_batches(docs.sparkSession, BATCH_ROWS):
        words = stored(count_words(docs), "words")
    near = near_pairs(words)
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = near.join(counts, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.max("other_n").alias("best_n"), F.min_by("other", F.struct(-F.col("other_n"), "other")).alias("best")
    )
    usual = F.col("best_n") >= ratio * F.col("n")
    formed = stored(
        words.join(best, "word", "left").select(
            "word", F.when(usual, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(usual, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    # every step multiplies n, so chains are short; each round doubles how far a word has looked
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = stored(roots, "roots")
        farther = onward.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = onward.join(farther, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        if onward.join(farther, "root", "left_semi").isEmpty():
            break
    return formed.join(onward, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
