"""Episodes of care: dated events of one member linked into episodes.

An event starts a new episode when it begins more than ``gap_days`` after the
end of what came before it (or when that end is unknown); otherwise it joins
the running episode. "What came before" is the previous event in (start, end)
order for ``rule="previous"`` and the latest end so far for
``rule="running_max"``.

Members are not equally large, and copies of one event can be many. Whether an
event starts an episode depends on dates alone, so the ordered pass runs over
*intervals*: the distinct (start, end) pairs of a member, per diagnosis code
where one is carried, counted with map-side aggregation first. Their number is
limited by the calendar and the code list, not by the number of claims, so the
window stays small for any member. Numbers without overlap labels need less:
the ordered pass runs over *days*, see ``_number_days``. Copies of an
interval share its episode except in one case, an interval that cannot reach
its own copy (no end date, or an end more than the gap before its start),
where every copy is an episode of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codes

# Copies written by one generated row, and slices of one interval's rows.
COPIES_PER_CHUNK = 10_000
INTERVAL_SLICES = 4096


def _starts_new(start: Column, prior_end: Column, gap_days: int) -> Column:
    return F.coalesce(start > F.date_add(prior_end, gap_days), F.lit(False)) | prior_end.isNull()


def _overlap(start: Column, end: Column, prior_start: Column, prior_end: Column, new: Column, first: Column, gap_days: int) -> Column:
    return (
        F.when(first, codes.FIRST)
        .when(new, codes.NEW_EPISODE)
        .when((start <= F.date_add(prior_end, gap_days)) & (end > prior_end), codes.REGULAR_OVERLAP)
        .when((start == prior_start) & (end < prior_end), codes.SAME_START)
        .when((start > prior_start) & (end < prior_end), codes.EMBEDDED)
        .when((start == prior_start) & (end == prior_end), codes.PERFECT_OVERLAP)
    )


def _number_intervals(
    intervals: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    tie: Sequence[str],
    gap_days: int,
    rule: str,
    labels: bool = False,
) -> DataFrame:
    """Add episode numbers to counted intervals (``_copies`` rows each).

    ``_last`` is the episode of an interval's last copy and ``_repeats`` says
    that its copies are episodes of their own, so copy ``j`` (0-based) belongs
    to ``_last - (_copies - 1 - j)`` where ``_repeats`` and to ``_last`` elsewhere.
    """
    ordered = W.partitionBy(*keys).orderBy(start, end, *tie)
    begin, finish = F.col(start), F.col(end)
    repeats = None
    if rule == "previous":
        prior = F.lag(end).over(ordered)
        own = finish
        if "_alone" in intervals.columns:
            repeats = F.col("_alone") == 1
    elif rule == "running_max":
        prior = F.max(end).over(ordered.rowsBetween(W.unboundedPreceding, -1))
        own = F.greatest(F.col("_prior_end"), finish)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    out = intervals.withColumn("_prior_end", prior)
    if labels:
        out = out.withColumns(
            {"_prior_start": F.lag(start).over(ordered), "_seq": F.row_number().over(ordered)}
        )
    out = out.withColumns(
        {
            "_new": _starts_new(begin, F.col("_prior_end"), gap_days),
            "_repeats": _starts_new(begin, own, gap_days) if repeats is None else repeats,
        }
    )
    started = F.col("_new").cast("long") + F.when(F.col("_repeats"), F.col("_copies") - 1).otherwise(0)
    out = out.withColumn(
        "_last", F.sum(started).over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    if labels:
        out = out.withColumns(
            {
                "_first_label": _overlap(
                    begin, finish, F.col("_prior_start"), F.col("_prior_end"), F.col("_new"),
                    F.col("_seq") == 1, gap_days,
                ),
                "_copy_label": _overlap(
                    begin, finish, begin, own, F.col("_repeats"), F.lit(False), gap_days
                ),
            }
        )
    return out


def _number_days(
    events: DataFrame, keys: Sequence[str], start: str, end: str, gap_days: int, rule: str
) -> DataFrame:
    """One row per member and start date: the state an ordered scan has when it reaches that day.

    Segments of the scan are the days. Within one, events that cannot reach
    their own copy come first (ends are ascending, unknown ones first), so two
    numbers and the last end summarise it, and they combine on the map side.
    The ordered pass over these summaries gives each day ``_base``, the number
    of its first such event, and ``_normal``, that of all its other events.
    """
    alone = _starts_new(F.col(start), F.col(end), gap_days).cast("long")
    days = events.groupBy(*keys, start).agg(
        F.sum(alone).alias("_alone"), F.count(F.lit(1)).alias("_rows"), F.max(end).alias("_last_end")
    )
    ordered = W.partitionBy(*keys).orderBy(start)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    all_alone = (F.col("_alone") == F.col("_rows")).cast("long")
    if rule == "previous":
        prior, first = F.lag("_last_end").over(ordered), F.col("_first")
        opened, normal = first + F.col("_alone") - all_alone, first + F.col("_alone")
    elif rule == "running_max":
        # a day within reach of an earlier end opens nothing, whatever its own ends are
        prior, first = F.max("_last_end").over(before), F.col("_first")
        opened, normal = first * (1 + F.col("_alone") - all_alone), first * (1 + F.col("_alone"))
    else:
        raise ValueError(f"unknown rule {rule!r}")
    numbered = days.withColumn("_first", _starts_new(F.col(start), prior, gap_days).cast("long")).withColumn(
        "_before", F.coalesce(F.sum(opened).over(before), F.lit(0))
    )
    step = F.lit(1) if rule == "previous" else first
    return numbered.select(
        *keys, start, (F.col("_before") + first).alias("_base"), (F.col("_before") + normal).alias("_normal"), step.alias("_step")
    )


def _number_by_days(
    events: DataFrame, keys: Sequence[str], start: str, end: str, gap_days: int, rule: str, episode: str, few_copies: bool
) -> DataFrame:
    """Every event with its episode number, taken from its day; only events that stand alone are ranked in theirs.

    The rows of a day need no order, so they move once and are joined; the
    join's frequent keys are split by adaptive execution.
    """
    columns, alone = events.columns, _starts_new(F.col(start), F.col(end), gap_days)
    day = [*keys, start]
    # days are unique and slim: hashing them spares both sides a sort
    days = _number_days(events, keys, start, end, gap_days, rule).withColumnsRenamed({c: f"_day_{c}" for c in day}).hint("shuffle_hash")
    same_day = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_day_{c}")) for c in day))
    linked = events.where(~alone).join(days, same_day).select(*columns, F.col("_normal").alias(episode))

    slices, rows = _sliced(events.where(alone), keys, start, end, few_copies)
    within_day = W.partitionBy(*day).orderBy(end, "_part").rowsBetween(W.unboundedPreceding, -1)
    ranked = slices.withColumn("_earlier", F.coalesce(F.sum("_copies").over(within_day), F.lit(0)))
    lone = _copies_placed(rows, ranked, keys, start, end, few_copies).join(days, same_day).select(
        *columns, (F.col("_base") + F.col("_step") * (F.col("_earlier") + F.col("_j"))).alias(episode)
    )
    return linked.unionByName(lone)


def _sliced(events: DataFrame, keys: Sequence[str], start: str, end: str, few_copies: bool) -> tuple[DataFrame, DataFrame]:
    """Rows spread over slices of their interval by a hash of their content, and the slices with their size."""
    columns = events.columns
    rest = [c for c in columns if c not in (*keys, start, end)]
    if few_copies:
        rows = events.withColumns({"_chunk": F.lit(0).cast("long"), "_size": F.lit(1).cast("long")})
    else:
        counted = events.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
        chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES_PER_CHUNK))
        rows = counted.withColumn("_chunk", F.explode(chunks)).withColumn(
            "_size", F.least(F.lit(COPIES_PER_CHUNK), F.col("_n") - F.col("_chunk") * COPIES_PER_CHUNK)
        )
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*rest, "_chunk"), F.lit(INTERVAL_SLICES)))
    return rows.groupBy(*keys, start, end, "_part").agg(F.sum("_size").alias("_copies")), rows


def _copies_placed(
    rows: DataFrame, numbered: DataFrame, keys: Sequence[str], start: str, end: str, few_copies: bool
) -> DataFrame:
    """Rows with the facts of their slice and ``_j``, their place in it (0-based), one for each copy."""
    fields = [*keys, start, end, "_part"]
    added = ("_chunk", "_size", "_part", "_n")
    rest = [c for c in rows.columns if c not in (*fields, *added)]
    # A slice is matched by one struct, whose equality treats NULL dates as
    # equal, behind its hash, which settles almost every comparison.
    slice_key = {"_hash": F.xxhash64(*fields), "_slice": F.struct(*fields)}
    facts = [c for c in numbered.columns if c not in fields]
    # A row's place in its slice, ahead of the join: both use one sort.
    within = W.partitionBy(*slice_key).orderBy(*rest, "_chunk")
    placed = rows.withColumns(slice_key).withColumn(
        "_before",
        F.sum("_size").over(within.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_size"),
    )
    joined = placed.join(numbered.withColumns(slice_key).select(*slice_key, *facts), list(slice_key)).drop(*slice_key)
    if few_copies:
        return joined.withColumn("_j", F.col("_before"))
    return joined.withColumn("_j", F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("_size") - 1)))


def number_episodes(
    events: DataFrame,
    keys: Sequence[str] = ("beneID", "state"),
    start: str = "StartDate",
    end: str = "EndDate",
    gap_days: int = 1,
    rule: str = "previous",
    episode: str = "episode",
    overlap: str | None = "ovlp",
    few_copies: bool = False,
) -> DataFrame:
    """Every event with its episode number (from 1) and overlap label.

    Row-level form. Without labels (``overlap=None``), events take their number
    from their day (``_number_by_days``) and move once. With labels, identical
    rows are counted, an interval's rows are spread over slices by a hash of
    their content, the ordered pass numbers the slices, and each row takes its
    number and label from its slice. No task holds more than one slice of one
    interval.

    ``few_copies`` skips counting identical rows. The result is the same; use
    it where rows carry an identifier, so that copies of one row stay few.
    """
    columns, keys = events.columns, list(keys)
    if overlap is None:
        return _number_by_days(events, keys, start, end, gap_days, rule, episode, few_copies)
    slices, rows = _sliced(events, keys, start, end, few_copies)
    numbered = _number_intervals(slices, keys, start, end, ["_part"], gap_days, rule, labels=True)
    copies = _copies_placed(rows, numbered, keys, start, end, few_copies)
    number = F.when(F.col("_repeats"), F.col("_last") - (F.col("_copies") - 1 - F.col("_j"))).otherwise(F.col("_last"))
    label = F.when(F.col("_j") == 0, F.col("_first_label")).otherwise(F.col("_copy_label"))
    return copies.select(*columns, number.alias(episode), label.alias(overlap))


def collapse_episodes(
    events: DataFrame,
    maxima: Sequence[str],
    keys: Sequence[str] = ("beneID", "state"),
    start: str = "StartDate",
    end: str = "EndDate",
    gap_days: int = 1,
    rule: str = "previous",
    episode: str = "episode",
    members: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per episode: maximum of each measure, first start, last end.

    Equals numbering every event and grouping by the number. The measures are
    combined per interval before anything is ordered: the events cross the
    network once, partly aggregated, and only intervals are sorted. Attaching
    ``members`` (one row per key) happens between the two, at interval grain;
    its columns ``carry`` come along. Numbering and grouping share one sort.
    """
    keys = list(keys)
    begin, finish = F.col(start), F.col(end)
    alone = _starts_new(begin, finish, gap_days)
    # Codes group, numbers combine: a maximum of texts would make Spark sort the
    # events before the shuffle, while numbers stay in its hash aggregate.
    types = dict(events.dtypes)
    coded = [c for c in maxima if types[c] == "string"]
    combined = [c for c in maxima if c not in coded]
    # Copies of a normal interval merge; those that may stand alone keep their measures.
    apart = F.when(alone, F.struct(*combined)) if combined else F.lit(None).cast("string")
    intervals = (
        events.withColumns({"_apart": apart, "_alone": alone.cast("int")})
        .groupBy(*keys, start, end, *coded, "_apart")
        .agg(
            F.count(F.lit(1)).alias("_copies"),
            F.max("_alone").alias("_alone"),
            *[F.max(c).alias(c) for c in combined],
        )
    )
    if members is not None:
        intervals = intervals.join(members.select(*keys, *carry), keys, "inner")
    numbered = _number_intervals(intervals, keys, start, end, [*coded, "_apart"], gap_days, rule)
    # A copy of an interval that stands alone is an episode of its own; only the
    # first copy may belong to the one before. Copies are written out in chunks,
    # so that no row holds a long array, and in the same pass as everything else.
    further = F.when(F.col("_repeats"), F.col("_copies") - 1).otherwise(F.lit(0).cast("long"))
    chunks = F.sequence(F.lit(0).cast("long"), F.ceil(further / COPIES_PER_CHUNK))
    first_copy = F.array(F.lit(0).cast("long"))
    chunk_copies = F.sequence((F.col("_chunk") - 1) * COPIES_PER_CHUNK + 1, F.least(F.col("_chunk") * COPIES_PER_CHUNK, F.col("_further")))
    linked = (
        numbered.withColumn("_further", further)
        .withColumn("_chunk", F.explode(chunks))
        .withColumn("_copy", F.explode(F.when(F.col("_chunk") == 0, first_copy).otherwise(chunk_copies)))
        .withColumn(episode, F.col("_last") - F.col("_further") + F.col("_copy"))
    )
    return linked.groupBy(*keys, *carry, episode).agg(
        *[F.max(c).alias(c) for c in maxima], F.min(start).alias(start), F.max(end).alias(end)
    )
