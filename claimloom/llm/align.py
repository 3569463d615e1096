"""Two tokenizations of one text side by side: the smallest stretches where both have a limit, and which ids overlap.

Tokens of both kinds are nodes, and a token overlaps some tokens of the other
kind. Every token points to the one of these that reaches farthest right; a
token of the first kind that ends where one of the second kind ends points to
itself. Doubling (each pointer jumps to its target's target) reaches the last
token of every component in a logarithmic number of steps over whole arrays,
and that token labels the group.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import byte_characters
from .columns import concat_ranges, give_back, table
from .shared import small_batches, stored

#: Bytes of text aligned at once.
PART_BYTES = 1 << 20
#: Longer texts are encoded in parts of about this many characters, cut where both tokenizers have a limit.
PART_CHARACTERS = 1 << 17
#: Bytes of text, and distinct id pairs, after which a task begins a new slice of the input.
SLICE_BYTES, SLICE_PAIRS = 16 << 20, 1 << 17
#: Rows handed to a Python worker at once.
BATCH_ROWS = 1000

SPACE = "▁"
# A space between two Latin letters begins a token in both tokenizers.
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
# Characters that count as letter, digit, space or neither in every version of Unicode the libraries may hold.
_SETTLED = re.compile("[\0-ɏͰ-ͳͶ-ͷͺ-ͽ΄-ΊΎ-ΡΣ-ԧ -⁯₠-₵"
                      "←-⏳─-⛿぀ぁ-ゖ゠-ヿ一-龥가-힣\U0001f300-\U0001faff]*")


class Bytes:
    """Token bytes by id: all in one array, with where each begins and how long it is."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[concat_ranges(self.begin[ids], self.length[ids])]


class ByteLevel:
    """Ids of a byte-level BPE file; the text must not rely on special tokens."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        back = {c: b for b, c in enumerate(byte_characters())}
        names = self.library.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            spelled[k] = bytes(back[c] for c in name if c in back)
        self.bytes, self.quick = Bytes(spelled), None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
            # the same vocabulary by another library, several times as fast
            if all(k < len(spelled) and spelled[k] == t for t, k in known.items()):
                self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> np.ndarray:
        if self.quick and _SETTLED.fullmatch(text):
            return np.array(self.quick(text), np.int32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)


class Pieces:
    """Ids of a sentence-piece BPE model, which puts a space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.size = len(self.library)
        names = [self.library.id_to_piece(k) for k in range(self.size)]
        # pieces that stand for a byte are known by their type, not by their look
        self.bytes = Bytes([
            bytes([int(x[3:5], 16)]) if self.library.is_byte(k) else x.replace(SPACE, " ").encode() for k, x in enumerate(names)
        ])

        #: No piece has a space behind another character, so a space there begins a token.
        self.apart = not any(SPACE in x.lstrip(SPACE) for x in names)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.library.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def _encoders(first: tuple[str | None, ...], second: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(*first), Pieces(second)


def pieces_of(text: str) -> Iterator[str]:
    """Stretches of a text, all but the first beginning with a space, that can be encoded one by one."""
    begin, n = 0, len(text)
    while n - begin > 2 * PART_CHARACTERS:
        cut = _CUT.search(text, begin + PART_CHARACTERS)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


class Parts:
    """Both tokenizations of several stretches of text, in flat arrays; `part` says whose stretch a token is."""

    def __init__(self, texts: list[str], first: ByteLevel, second: Pieces):
        """`texts` begin with the space that the first kind of token counts and the second kind adds."""
        encoded, others = [first.encode(t) for t in texts], second.encode_all([t[1:] for t in texts])
        (a, many_a), (b, many_b) = ((np.concatenate(x), np.array([len(y) for y in x], np.int64)) for x in (encoded, others))
        raw = [t.encode() for t in texts]
        size = np.array([len(x) for x in raw], np.int64)
        part_a, part_b = (np.repeat(np.arange(len(texts)), m) for m in (many_a, many_b))
        self.bad = np.zeros(len(texts), bool)
        for ids, part, tokens in ((a, part_a, first.bytes), (b, part_b, second.bytes)):
            self.bad |= np.bincount(part, weights=tokens.length[ids], minlength=len(texts)).astype(np.int64) != size
        limits, data = np.append(0, np.cumsum(size)), np.frombuffer(b"".join(raw), np.uint8)
        for ids, part, tokens in ((a, part_a, first.bytes), (b, part_b, second.bytes)):
            fit = ~self.bad
            wanted = data[concat_ranges(limits[:-1][fit], size[fit])]
            unlike = np.flatnonzero(tokens.joined(ids[fit[part]]) != wanted)
            if len(unlike):
                of = np.searchsorted(np.cumsum(size[fit]), unlike, "right")
                self.bad[np.flatnonzero(fit)[np.unique(of)]] = True
        fit = ~self.bad
        self.a, self.part_a = a[fit[part_a]], part_a[fit[part_a]]
        self.b, self.part_b = b[fit[part_b]], part_b[fit[part_b]]
        self.base = np.where(fit, np.cumsum(np.where(fit, size, 0)) - size, 0)
        self.end_a, self.end_b = np.cumsum(first.bytes.length[self.a]), np.cumsum(second.bytes.length[self.b])
        begin_a = self.end_a - first.bytes.length[self.a]
        #: First and last token of the other kind that each one overlaps.
        self.low = np.searchsorted(self.end_b, begin_a, "right")
        self.high = np.searchsorted(self.end_b, self.end_a, "left")
        self._group()

    def _group(self) -> None:
        n = len(self.a)
        if not n:
            self.group_a = self.group_b = self.part_of_group = np.zeros(0, np.int64)
            return
        over = self.end_b[self.high] > self.end_a
        points = np.concatenate([
            np.where(over, n + self.high, np.arange(n)), np.searchsorted(self.end_a, self.end_b, "left"),
        ])
        while True:
            farther = points[points]
            if np.array_equal(farther, points):
                break
            points = farther
        last = np.flatnonzero(~over)
        label = np.cumsum(~over) - 1
        self.group_a, self.group_b = label[points[:n]], label[points[n:]]
        self.part_of_group = self.part_a[last]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Part, first id and second id of every pair of tokens that overlap."""
        many = self.high - self.low + 1
        return np.repeat(self.part_a, many), np.repeat(self.a, many), self.b[concat_ranges(self.low, many)]

    def written(self, names_a: list[np.ndarray], names_b: list[np.ndarray], parts: int) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of every part: groups in order, each with a closing `;`."""
        groups = len(self.part_of_group)
        if not groups:
            return [""] * parts
        n_a, n_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        ends = np.zeros(len(self.a) + len(self.b), object)
        at_a = np.arange(len(self.a)) + (np.cumsum(n_b) - n_b)[self.group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(n_a)[self.group_b]
        last_a, last_b = np.append(self.group_a[1:] != self.group_a[:-1], True), np.append(self.group_b[1:] != self.group_b[:-1], True)
        ends[at_a] = np.where(last_a, names_a[1][self.a], names_a[0][self.a])
        ends[at_b] = np.where(last_b, names_b[1][self.b], names_b[0][self.b])
        tokens = np.bincount(self.part_a, minlength=parts) + np.bincount(self.part_b, minlength=parts)
        cuts = np.append(0, np.cumsum(tokens)).tolist()
        flat = ends.tolist()
        return ["".join(flat[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]


def _names(size: int, inside: str, last: str) -> list[np.ndarray]:
    return [np.array([f"{k}{end}" for k in range(size)], object) for end in (inside, last)]


def _batches_of_parts(column: pa.Array, apart: bool = True) -> Iterator[list[tuple[int, str, bool]]]:
    """(row, stretch, is its last) of the texts of a column, about PART_BYTES together; texts without characters are left out."""
    held, size = [], 0
    for row, text in enumerate(column):
        text = text.as_py()
        if not text:
            continue
        ahead = None
        for part in pieces_of(" " + text) if apart else [" " + text]:
            if ahead is not None:
                held.append((row, ahead, False))
            ahead = part
            size += len(part)
            if size >= PART_BYTES and held:
                yield held
                held, size = [], len(part)
        held.append((row, ahead, True))
    if held:
        yield held


ALIGNED = "a_ids array<int>, a_ends array<long>, a_groups array<long>, b_ids array<int>, b_ends array<long>, b_groups array<long>"


def align(docs: DataFrame, first: tuple[str | None, ...], second: str) -> DataFrame:
    """Add both tokenizations of `text`: ids, byte offsets of the ends in " " + text, and group labels from 0.

    `first` is the file of the byte-level tokenizer (and, for speed, the rank
    file and split pattern of the same vocabulary), `second` the model of the
    sentence-piece one. Texts that are null or empty, or whose tokens do not
    spell " " + text, get empty lists. All other columns and rows are kept,
    repeated ones too; columns of these names are replaced. No shuffle; memory
    is that of one row's text and arrays.
    """
    new = StructType.fromDDL(ALIGNED)
    kept = docs.drop(*new.names)
    schema = StructType(kept.schema.fields + new.fields)
    kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(first, second)
        for batch in batches:
            give_back()
            found: dict[int, list[list[np.ndarray]]] = {}
            bad, groups, shift = set(), {}, {}
            for parts in _batches_of_parts(batch.column(batch.schema.get_field_index("text")), encoders[1].apart):
                x = Parts([t for _, t, _ in parts], *encoders)
                for k, (row, text, _) in enumerate(parts):
                    if x.bad[k]:
                        bad.add(row)
                        continue
                    s, g = shift.get(row, 0) - x.base[k], groups.get(row, 0)
                    a, b = (slice(*np.searchsorted(p, [k, k + 1])) for p in (x.part_a, x.part_b))
                    low = x.group_a[a.start]
                    found.setdefault(row, []).append([
                        x.a[a], x.end_a[a] + s, x.group_a[a] - low + g, x.b[b], x.end_b[b] + s, x.group_b[b] - low + g,
                    ])
                    groups[row] = g + int(x.group_a[a.stop - 1] - low) + 1
                    shift[row] = shift.get(row, 0) + len(text.encode())
            rows = [None if r in bad else found.get(r) for r in range(batch.num_rows)]
            out = batch.drop_columns([c for c in new.names if c in batch.schema.names])
            for k, (name, kind) in enumerate(zip(new.names, kinds)):
                lists = [np.concatenate([p[k] for p in r]) if r else np.zeros(0, np.int64) for r in rows]
                out = out.append_column(name, pa.array(lists, kind))
            yield out

    return docs.mapInArrow(run, schema)


_ROWS = pa.schema([
    ("slice", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()),
    ("times", pa.binary()), ("pair", pa.int64()), ("n", pa.int64()), ("best", pa.bool_()),
])
_ROWS_DDL = (
    "slice long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, times binary, pair long, n long, best boolean"
)
PAIR, DOCUMENT = 0, 1


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    if len(keys) == 1:
        return keys[0], counts[0]
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[new], np.add.reduceat(count, new)


class _Slice:
    """Id pairs of the documents of one stretch of the input, and the documents as rows."""

    def __init__(self, number: int, kind: np.dtype):
        self.number, self.kind = number, kind
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held, self.bytes, self.rows = 0, 0, []

    def add(self, doc_id: int | None, facts: list[int], digest: str, keys: np.ndarray, counts: np.ndarray) -> None:
        self.rows.append((doc_id, *facts, digest, keys.astype(self.kind).tobytes(), counts.astype("<u4").tobytes()))
        if len(keys):
            self.keys.append(keys)
            self.counts.append(counts)
            self.held += len(keys)
            if self.held > 8 * SLICE_PAIRS:
                self.settle()

    def settle(self) -> int:
        if self.keys:
            key, count = _summed(self.keys, self.counts)
            self.keys, self.counts, self.held = [key], [count], len(key)
        return self.held

    def documents(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 8
        n, self.rows = len(self.rows), []
        none = [None] * n
        return table(_ROWS, [self.number] * n, [DOCUMENT] * n, *columns, none, none, none)

    def pairs(self) -> Iterator[pa.RecordBatch]:
        if self.settle():
            key, count = self.keys[0], self.counts[0]
            for at in range(0, len(key), 20_000):
                n = len(key[at : at + 20_000])
                none = [None] * n
                yield table(_ROWS, [self.number] * n, [PAIR] * n, *[none] * 8, key[at : at + n], count[at : at + n], none)


def _encoded(docs: DataFrame, first: tuple[str | None, ...], second: str) -> DataFrame:
    """Rows of documents with their id pairs, and rows of the distinct pairs of every slice of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(first, second)
        width = encoders[1].size
        names_a, names_b = _names(len(encoders[0].bytes.length), ",", "|"), _names(width, ",", ";")
        kind = np.dtype("<u4" if len(encoders[0].bytes.length) * width < 1 << 32 else "<i8")
        base, seen = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
        now = _Slice(base, kind)
        for batch in batches:
            give_back()
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            empty = ([0, 0, 0, 0], "", np.zeros(0, np.int64), np.zeros(0, np.int64))
            met, open_row, sums, digest, keys, counts, bad = set(), None, [0] * 4, None, [], [], False
            for parts in _batches_of_parts(texts, encoders[1].apart):
                x = Parts([t for _, t, _ in parts], *encoders)
                many = len(parts)
                part, link_a, link_b = x.links()
                key = link_a.astype(np.int64) * width + link_b
                order = np.lexsort((key, part)) if len(np.unique(part)) > 1 else np.argsort(key, kind="stable")
                part, key = part[order], key[order]
                new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))[: len(key)])
                times = np.diff(np.append(new, len(key)))
                cuts = np.searchsorted(part[new], np.arange(many + 1)).tolist()
                facts = np.column_stack([np.bincount(p, minlength=many) for p in (x.part_a, x.part_b, x.part_of_group, part)]).tolist()
                texts_of = x.written(names_a, names_b, many)
                distinct = key[new]
                for k, (row, text, done) in enumerate(parts):
                    if open_row != row:
                        open_row, sums, digest, keys, counts, bad = row, [0] * 4, hashlib.sha256(), [], [], False
                        closing = ""
                    bad |= bool(x.bad[k])
                    sums = [p + q for p, q in zip(sums, facts[k])]
                    digest.update((closing + texts_of[k][:-1]).encode())
                    closing = ";"
                    keys.append(distinct[cuts[k] : cuts[k + 1]])
                    counts.append(times[cuts[k] : cuts[k + 1]])
                    now.bytes += len(text)
                    if done:
                        met.add(row)
                        now.add(ids[row], *(empty if bad else (sums, digest.hexdigest(), *_summed(keys, counts))))
                yield now.documents()
                if open_row in met and (now.bytes >= SLICE_BYTES or now.held > 4 * SLICE_PAIRS and now.settle() >= SLICE_PAIRS):
                    yield from now.pairs()
                    seen += 1
                    now = _Slice(base + seen, kind)
            for row in range(batch.num_rows):
                if row not in met:
                    now.add(ids[row], *empty)
            yield now.documents()
        yield from now.pairs()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROWS_DDL)


_REPORT = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])


def _scored(rows: DataFrame, kind: str) -> DataFrame:
    """Documents with the counts of their links; the rows of a slice's pairs come before those of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, key, count, best = None, [], None, None, None
        for batch in batches:
            numbers, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for begin, end in zip(np.append(0, change).tolist(), np.append(change, batch.num_rows).tolist()):
                if begin == end:
                    continue
                if numbers[begin] != current:
                    current, held, key = numbers[begin], [], None
                part = batch.slice(begin, end - begin)
                if kinds[begin] == PAIR:
                    held.append([part.column(k).to_numpy(zero_copy_only=False) for k in (10, 11, 12)])
                    continue
                if key is None:
                    key, count, best = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in range(3))
                    order = np.argsort(key)
                    key, count, best, held = key[order], count[order], best[order].astype(np.int64), []
                pairs = [np.frombuffer(x, kind).astype(np.int64) for x in part.column(8).to_pylist()]
                times = np.frombuffer(b"".join(part.column(9).to_pylist()), "<u4").astype(np.int64)
                at = np.searchsorted(key, np.concatenate(pairs))
                of = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
                sums = []
                for value in (best, count):
                    total = np.zeros(len(pairs), np.int64)
                    np.add.at(total, of, times * value[at])
                    sums.append(total)
                plain = [part.column(k) for k in range(2, 7)]
                yield pa.RecordBatch.from_arrays([*plain, *map(pa.array, sums), part.column(7)], schema=_REPORT)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {'string' if f.name == 'groups_sha256' else 'long'}" for f in _REPORT))


def report(docs: DataFrame, first: tuple[str | None, ...], second: str) -> DataFrame:
    """Per document: tokens of both kinds, groups, links, and how its links stand in the whole corpus.

    Columns: doc_id, n_a, n_b, n_groups, n_links; n_best, the links whose id
    pair is (one of) the most frequent of its second id; count_sum, the sum of
    the corpus-wide counts of the links' id pairs; groups_sha256. `docs` has
    doc_id and text; other columns are ignored. Every row gives one row and
    counts as a document of its own, repeated rows and null doc_ids too. Texts
    that are null or empty, or whose tokens do not spell " " + text, give
    zeros and an empty digest. Empty tables give no rows.

    Pairs are counted in each slice of the input (`SLICE_BYTES`, `SLICE_PAIRS`),
    then over all slices; the counts return to the slices that hold a pair, and
    documents meet only the counts of their slice. So a pair moves once for a
    slice, not for a document or link, and no count table is held whole.
    """
    spark = docs.sparkSession
    size_a, size_b = (len(e.bytes.length) for e in _encoders(first, second))
    with small_batches(spark, BATCH_ROWS):
        rows = stored(_encoded(docs, first, second), "aligned")
        pairs = rows.where(f"kind = {PAIR}").select("slice", "pair", "n")
        counts = stored(pairs.groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
        second_id = (F.col("pair") % size_b).alias("second_id")
        highest = counts.groupBy(second_id).agg(F.max("total").alias("highest"))
        known = counts.withColumn("second_id", second_id).join(highest, "second_id").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
        meant = pairs.join(known, "pair").select("slice", "pair", F.col("total").alias("n"), "best").withColumn("kind", F.lit(PAIR))
        both = rows.where(f"kind = {DOCUMENT}").drop("pair", "n", "best").unionByName(meant, allowMissingColumns=True)
        sorted_rows = both.select(*_ROWS.names).repartition("slice").sortWithinPartitions("slice", "kind")
        return stored(_scored(sorted_rows, "<u4" if size_a * size_b < 1 << 32 else "<i8"), "alignment")
