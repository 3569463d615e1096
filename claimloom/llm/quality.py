"""Quality classifier by co-training two views of a document.

The text view sees which words and word beginnings occur, and how densely. The metadata view sees source, language,
length and the shape of the page: shares of letters, digits, marks and symbols,
word and line lengths, repetition. Each view starts from the labelled rows;
then, over some rounds, each labels the unlabelled rows it is surest of for the
other to learn from. On labelled rows kept aside the views are calibrated and
weighted against each other, and every document gets the combined probability.

Both labels are learnt this way: quality, and toxicity. Only the fit uses a
bounded sample, see `Settings`; scoring is one pass over whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import BYTE_CODES, SMALL_SLICE, flat, lower_ascii, prefix, runs, slices, span_hash

LANGUAGES, SOURCES, SHAPE_BINS = 32, 64, 32
#: Beginnings of longer words, in bytes, that count beside the whole words.
BEGINNINGS = (5, 7)
#: A word or beginning is marked as present, and again where one word in so many is it.
DENSITIES = (256, 64)
LEVELS = 1 + len(DENSITIES)
#: Measures of a page's shape, in this order.
SHAPE = (
    "bytes", "letters", "digits", "blanks", "stops", "symbols", "capitals", "word length", "words per line",
    "distinct words", "most repeated step",
)


@dataclass(frozen=True)
class Settings:
    """labelled_rows and pool_rows bound what is fitted on, whatever the corpus holds; rows are chosen by a hash of doc_id.

    Labelled rows are dealt evenly to the classes (quality and toxic together);
    what a rare class leaves free goes to the others.
    """

    labelled_rows: int = 8_000
    pool_rows: int = 3_000
    bins: int = 1 << 18
    rounds: int = 3
    share_per_round: float = 0.1
    confident: float = 0.9
    steps: int = 150
    word_z: float = 6.0
    held_out: float = 0.25
    seed: int = 11


def _names(column: pa.Array, bins: int) -> np.ndarray:
    data, offsets = flat(column)
    return (span_hash(prefix(BYTE_CODES[data]), offsets[:-1], offsets[1:]) % np.uint64(bins)).astype(np.int64)


def features(text: pa.Array, lang: pa.Array, source: pa.Array, bins: int, wanted: np.ndarray | None = None):
    """Word marks of all rows with their offsets, the shape measures, and language and source bins.

    With `wanted`, a flag for each bin, only marks of those bins are made.
    """
    data, offsets = flat(text)
    n = len(offsets) - 1
    length = np.diff(offsets)
    kinds = np.full(256, 5, np.int8)
    kinds[[ord(c) for c in " \t\r\v\f\n"]] = 3
    kinds[[ord(c) for c in ".,;:!?'\"-()"]] = 4
    kinds[48:58] = 2
    kinds[65:91] = kinds[97:123] = kinds[128:] = 1
    kind = kinds[data]

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags, dtype=np.int64))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    counts = np.column_stack([count(kind == k) for k in range(6)]).astype(float)
    capitals, feeds = count((data >= 65) & (data <= 90)), count(data == 10)

    lowered = lower_ascii(data)
    begins, ends = runs((kind == 1) | (kind == 2), offsets)  # letters and digits
    sums = prefix(BYTE_CODES[lowered])
    hashes = span_hash(sums, begins, ends)
    per_row = np.diff(np.searchsorted(begins, offsets))
    word_row = np.repeat(np.arange(n), per_row)
    buckets, rows = [(hashes % np.uint64(bins)).astype(np.int32)], [word_row]
    for size in BEGINNINGS:
        longer = np.flatnonzero(ends - begins > size)
        buckets.append((span_hash(sums, begins[longer], begins[longer] + size) % np.uint64(bins)).astype(np.int32))
        rows.append(word_row[longer])
    order = np.lexsort((hashes, word_row))
    new_word = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (word_row[order][1:] != word_row[order][:-1]))[: len(order)]
    distinct = np.bincount(word_row[order][new_word], minlength=n)
    bucket, row = np.concatenate(buckets), np.concatenate(rows)
    if wanted is not None:
        hit = wanted[bucket]
        bucket, row = bucket[hit], row[hit]
    order = np.lexsort((bucket, row))
    bucket, row = bucket[order], row[order]
    first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1]))[: len(order)])
    times = np.diff(np.append(first, len(order)))
    bucket, row = bucket[first].astype(np.int32), row[first]
    marks, mark_rows = [bucket * LEVELS], [row]
    for level, one_in in enumerate(DENSITIES, 1):
        dense = times * one_in >= per_row[row]
        marks.append(bucket[dense] * LEVELS + level)
        mark_rows.append(row[dense])
    mark_rows = np.concatenate(mark_rows)
    tokens = np.concatenate(marks)[np.argsort(mark_rows, kind="stable")]
    cut = np.append(0, np.cumsum(np.bincount(mark_rows, minlength=n)))
    again = np.bincount(word_row[1:][(hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])], minlength=n) if n else np.zeros(0)

    total, w = np.maximum(length, 1), np.maximum(per_row, 1)
    shape = np.column_stack([
        np.log1p(length), counts[:, 1] / total, counts[:, 2] / total, counts[:, 3] / total, counts[:, 4] / total,
        counts[:, 5] / total, capitals / total, (counts[:, 1] + counts[:, 2]) / w, np.log1p(per_row / (feeds + 1)),
        distinct / w, again / w,
    ]).astype(np.float32)
    return tokens, cut, shape, _names(lang, LANGUAGES), _names(source, SOURCES)


class Linear:
    """Logistic regression on rows that are lists of active bins."""

    def __init__(self, bins: int):
        self.weights, self.bias = np.zeros(bins), 0.0

    def odds(self, index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(self.weights[index]))
        return sums[offsets[1:]] - sums[offsets[:-1]] + self.bias

    def fit(self, index: np.ndarray, offsets: np.ndarray, target: np.ndarray, steps: int, least_z: float, penalty: float = 1e-4) -> Linear:
        """Fit the bins whose rows have another share of ones than the rest, by `least_z` standard errors."""
        row = np.repeat(np.arange(len(target), dtype=np.int32), np.diff(offsets))
        bins = len(self.weights)
        one = target > 0.5
        ones, n_ones = np.bincount(index[one[row]], minlength=bins), one.sum()
        zeros, n_zeros = np.bincount(index, minlength=bins) - ones, (~one).sum()
        common = (ones + zeros) / len(target)
        spread = np.sqrt(np.maximum(common * (1 - common), 1e-12) * (1 / max(n_ones, 1) + 1 / max(n_zeros, 1)))
        telling = np.flatnonzero(np.abs(ones / max(n_ones, 1) - zeros / max(n_zeros, 1)) >= least_z * spread)
        chosen = np.zeros(bins, bool)
        chosen[telling] = True
        kept = chosen[index]
        index, row = np.searchsorted(telling, index[kept]), row[kept]

        w, bias = np.zeros(len(telling)), 0.0
        mean, square, mean_b, square_b = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
        for step in range(1, steps + 1):
            odds = np.bincount(row, w[index], minlength=len(target)) + bias
            error = (1 / (1 + np.exp(-np.clip(odds, -35, 35))) - target) / len(target)
            slope, slope_b = np.bincount(index, error[row], minlength=len(w)) + penalty * w, error.sum()
            mean, mean_b = 0.9 * mean + 0.1 * slope, 0.9 * mean_b + 0.1 * slope_b
            square, square_b = 0.99 * square + 0.01 * slope**2, 0.99 * square_b + 0.01 * slope_b**2
            up, down = 1 - 0.9**step, 1 - 0.99**step
            w -= 0.1 * (mean / up) / (np.sqrt(square / down) + 1e-8)
            bias -= 0.1 * (mean_b / up) / (np.sqrt(square_b / down) + 1e-8)
        self.weights[telling], self.bias = w, bias
        return self


def _take(view, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Active bins of some rows of a view, which is a sequence of arrays, and their offsets."""
    parts = [view[i] for i in rows]
    return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


def _blend(odds: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 300) -> np.ndarray:
    """Slope of each column of log odds and a bias: calibration of one view, or of both together, rows counting by weight."""
    weight = weight / weight.mean()
    x = np.column_stack([np.clip(odds, -30, 30), np.ones(len(odds))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (weight * (p - target)) + 1e-2 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        change = np.linalg.solve(bend, slope)
        w -= np.clip(change, -1, 1)
        if np.abs(change).max() < 1e-9:
            break
    return w


@dataclass
class CoTrained:
    """Two views, their calibrations and the blend of the calibrated log odds."""

    views: list[Linear]
    calibrations: list[np.ndarray]
    blend: np.ndarray

    @classmethod
    def fit(cls, views, sizes, target: np.ndarray, labelled: np.ndarray, weight: np.ndarray, settings: Settings) -> CoTrained | None:
        """views: of all sample rows; target: 0 or 1 where labelled; weight: labels that a row stands for.

        None if either class is missing. Each class is split by itself; of one
        with a single row, that row is both fitted and calibrated on. The fits
        see the sample as it is, and the calibrations, by weight, what it stands for.
        """
        rng = np.random.default_rng(settings.seed)
        known = rng.permutation(np.flatnonzero(labelled))
        classes = [known[target[known] == c] for c in np.unique(target[known])]
        if len(classes) < 2:
            return None
        apart = [max(1, int(settings.held_out * len(c))) for c in classes]
        aside = np.concatenate([c[:n] for c, n in zip(classes, apart)])
        start = np.concatenate([c[n:] if len(c) > 1 else c for c, n in zip(classes, apart)])
        pool = np.flatnonzero(~labelled)
        rows = [start, start]
        marks = [target[start].astype(float)] * 2
        left = [pool, pool]
        models: list[Linear] = []
        for turn in range(settings.rounds + 1):
            models = [
                Linear(size).fit(*_take(v, r), m, settings.steps, z)
                for v, size, z, r, m in zip(views, sizes, (settings.word_z, 0.0), rows, marks)
            ]
            calibrations = [_blend(m.odds(*_take(v, aside))[:, None], target[aside], weight[aside]) for m, v in zip(models, views)]
            if turn == settings.rounds or not len(pool):
                break
            for me, other in ((0, 1), (1, 0)):  # what one view is surest of, the other learns
                free = left[other]
                if not len(free):
                    continue
                p = 1 / (1 + np.exp(-(models[me].odds(*_take(views[me], free)) * calibrations[me][0] + calibrations[me][1])))
                n = max(1, int(settings.share_per_round * len(pool)))
                order = np.argsort(np.abs(p - 0.5), kind="stable")[::-1][:n]
                order = order[np.maximum(p[order], 1 - p[order]) >= settings.confident]
                rows[other] = np.append(rows[other], free[order])
                marks[other] = np.append(marks[other], p[order] > 0.5)
                left[other] = np.delete(free, order)
        odds = np.column_stack([m.odds(*_take(v, aside)) * c[0] + c[1] for m, v, c in zip(models, views, calibrations)])
        return cls(models, calibrations, _blend(odds, target[aside], weight[aside]))

    def probabilities(self, views) -> np.ndarray:
        odds = [m.odds(*v) * c[0] + c[1] for m, v, c in zip(self.views, views, self.calibrations)]
        total = sum(np.clip(o, -30, 30) * w for o, w in zip(odds, self.blend)) + self.blend[-1]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _meta_view(shape: np.ndarray, lang: np.ndarray, source: np.ndarray, cuts: np.ndarray):
    """Metadata as active bins: one for each shape measure's quantile, one for language, one for source."""
    steps = cuts.shape[1] + 1
    columns = [np.searchsorted(c, shape[:, k], "right") + k * steps for k, c in enumerate(cuts)]
    base = len(cuts) * steps
    index = np.column_stack([*columns, base + lang, base + LANGUAGES + source])
    return index.ravel(), np.arange(len(index) + 1) * index.shape[1]


@dataclass
class Model:
    """What scoring needs; its size depends on Settings alone."""

    cuts: np.ndarray
    quality: CoTrained | None
    toxic: CoTrained | None
    settings: Settings


def _sample(rows: DataFrame, wanted: int) -> DataFrame:
    share = min(1.0, wanted / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def _sample_labels(known: DataFrame, wanted: int) -> DataFrame:
    """Labels with the number of labels each stands for; about `wanted`, dealt evenly to the classes."""
    kind = (F.col("quality") > 0).cast("int") * 2 + (F.col("toxic") > 0).cast("int")
    counts = {r["kind"]: r["count"] for r in known.groupBy(kind.alias("kind")).count().collect()}
    share, left = {}, wanted
    for k, (c, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):
        share[c] = min(1.0, left / (len(counts) - k) / n)
        left -= share[c] * n
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen, weight = F.lit(False), F.lit(1.0)
    for c, s in share.items():
        chosen = F.when(kind == c, drawn < int(s * (1 << 30))).otherwise(chosen)
        weight = F.when(kind == c, F.lit(1 / s)).otherwise(weight)
    return known.where(chosen).withColumn("weight", weight)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on labelled and unlabelled documents.

    `docs` has doc_id, text, lang, source; `labels` has doc_id, quality, toxic.
    Labels with null are left out; of contradicting labels of one doc_id the
    worse counts. Without both classes of a label there is no model for it and
    all documents pass.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic")
    )
    base = docs.where("doc_id is not null").select("doc_id", "text", "lang", "source")
    picked_labels = _sample_labels(known, settings.labelled_rows)
    marked = base.join(F.broadcast(picked_labels), "doc_id")  # about labelled_rows rows, so texts need not be shuffled
    pool = _sample(base.select("doc_id").join(known, "doc_id", "left_anti"), settings.pool_rows)
    pool = base.join(pool.distinct(), "doc_id").withColumns(
        {"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int"), "weight": F.lit(1.0)}
    )
    bins = settings.bins

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SMALL_SLICE):
                tokens, cut, shape, lang, source = features(part.column(1), part.column(2), part.column(3), bins)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([tokens[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                     pa.array([s.tobytes() for s in shape], pa.binary()), pa.array(lang), pa.array(source), part.column(4), part.column(5), part.column(6)],
                    ["doc_id", "tokens", "shape", "lang", "source", "quality", "toxic", "weight"],
                )

    ddl = "doc_id long, tokens binary, shape binary, lang long, source long, quality int, toxic int, weight double"
    columns = "doc_id", "text", "lang", "source", "quality", "toxic", "weight"
    both = marked.select(*columns).unionByName(pool.select(*columns))
    rows = sorted(both.mapInArrow(measure, ddl).collect(), key=lambda r: (r["doc_id"], r["tokens"]))
    if not rows:
        return Model(np.zeros((len(SHAPE), SHAPE_BINS - 1)), None, None, settings)
    text = [np.frombuffer(r["tokens"], np.int32) for r in rows]
    shape = np.frombuffer(b"".join(r["shape"] for r in rows), np.float32).reshape(len(rows), len(SHAPE))
    cuts = np.quantile(shape, np.arange(1, SHAPE_BINS) / SHAPE_BINS, axis=0).T
    meta = _meta_view(shape, np.array([r["lang"] for r in rows]), np.array([r["source"] for r in rows]), cuts)[0].reshape(len(rows), -1)
    labelled = np.array([r["quality"] is not None for r in rows])
    weight = np.array([r["weight"] for r in rows])
    sizes = bins * LEVELS, cuts.size + len(cuts) + LANGUAGES + SOURCES
    fits = {
        label: CoTrained.fit((text, meta), sizes, np.array([int((r[label] or 0) > 0) for r in rows]), labelled, weight, settings)
        for label in ("quality", "toxic")
    }
    return Model(cuts, fits["quality"], fits["toxic"], settings)


def _scorer(model: Model):
    """A function from text, language and source columns to the two probabilities and the decision."""
    wanted = np.zeros(model.settings.bins, bool)
    for fitted in (model.quality, model.toxic):
        if fitted:
            wanted |= (fitted.views[0].weights.reshape(-1, LEVELS) != 0).any(axis=1)

    def run(text: pa.Array, lang: pa.Array, source: pa.Array):
        tokens, cut, shape, lang, source = features(text, lang, source, model.settings.bins, wanted)
        views = (tokens, cut), _meta_view(shape, lang, source, model.cuts)
        good = model.quality.probabilities(views) if model.quality else np.ones(len(shape))
        toxic = model.toxic.probabilities(views) if model.toxic else np.zeros(len(shape))
        return good, toxic, (good >= 0.5) & (toxic < 0.5)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, quality_probability, toxic_probability, keep.

    `docs` has doc_id, text, lang and source; nulls count as empty, other
    columns are ignored, every row gives one row and equal rows equal scores.
    A document is kept if it is more likely good than bad and more likely
    harmless than toxic. Rows are independent: no shuffle.
    """
    scorer = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SMALL_SLICE):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, scorer(part.column(1), part.column(2), part.column(3)))],
                    ["doc_id", "quality_probability", "toxic_probability", "keep"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text", "lang", "source").mapInArrow(
        run, "doc_id long, quality_probability double, toxic_probability double, keep boolean"
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that `score` keeps, with all their columns."""
    scorer = _scorer(model)
    at = [docs.columns.index(c) for c in ("text", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SMALL_SLICE):
                yield part.filter(pa.array(scorer(*(part.column(k) for k in at))[2]))

    return docs.mapInArrow(run, docs.schema)
