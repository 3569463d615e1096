"""Visit classification: avoidable or not, inpatient or emergency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import flag, total

VISIT_FLAGS = (
    "allCauseEdVisit", "avoidEdVisit", "nonAvoidEdVisit",
    "allCauseIpVisit", "avoidIpVisit", "nonAvoidIpVisit",
)
CLASSES = ("non_avoid_ip", "avoid_ip", "non_avoid_ed", "avoid_ed")


def score_avoidable(
    lookup: DataFrame,
    code: str = "dx",
    parts: Sequence[str] = codes.ED_SCORE_PARTS,
    threshold: float = codes.ED_THRESHOLD,
    out: str = "avoidableEdVisit",
) -> DataFrame:
    """One flag per diagnosis: 1 when its probabilities sum above the threshold.

    A diagnosis listed twice counts as avoidable if either row says so.
    """
    return lookup.groupBy(F.col(code)).agg(F.max(flag(total(parts) > threshold)).alias(out))


def threshold_counts(
    lookup: DataFrame,
    parts: Sequence[str] = codes.ED_SCORE_PARTS,
    thresholds: Sequence[float] = codes.ED_THRESHOLDS,
    certain: float = 1.0,
) -> DataFrame:
    """How many diagnoses each cut-off would call avoidable, in one pass."""
    score = total(parts)
    counts = [F.count_if(score > t).alias(f"above_{t:g}".replace(".", "_")) for t in thresholds]
    return lookup.agg(
        F.count(F.lit(1)).alias("codes"), *counts, F.count_if(score == certain).alias("certain")
    )


def lookup_flag(events: DataFrame, lookup: DataFrame, code: str, flag_column: str, out: str | None = None) -> DataFrame:
    """Left lookup of a 0/1 flag; a diagnosis that is absent or NULL gets 0.

    The lookup is keyed by code (one row each). Its size decides the join: below
    Spark's broadcast threshold it is sent to the tasks, above it the join
    shuffles and adaptive execution splits a frequent diagnosis.
    """
    out = out or flag_column
    right = lookup.select(F.col(code), F.col(flag_column).alias("_flag"))
    joined = events.drop(out).join(right, code, "left")
    return joined.withColumn(out, F.coalesce(F.col("_flag"), F.lit(0)).cast("int")).drop("_flag")


def lookup_member(events: DataFrame, listed: DataFrame, code: str, out: str) -> DataFrame:
    """1 when the diagnosis is in the list."""
    once = listed.select(F.col(code)).distinct().withColumn(out, F.lit(1))
    return lookup_flag(events, once, code, out)


def lookup_with_prefix(events: DataFrame, lookup: DataFrame, code: str, flag_column: str, length: int = 3, out: str | None = None) -> DataFrame:
    """Larger of the flags found for the full diagnosis and for its leading characters."""
    out = out or flag_column
    exact = lookup_flag(events, lookup, code, flag_column, "_exact")
    short = lookup.select(F.col(code).alias("_prefix"), F.col(flag_column).alias("_short"))
    joined = exact.withColumn("_prefix", F.substring(F.col(code), 1, length)).join(
        short, "_prefix", "left"
    )
    value = F.greatest(F.col("_exact"), F.coalesce(F.col("_short"), F.lit(0))).cast("int")
    return joined.withColumn(out, value).drop("_prefix", "_exact", "_short")


def visit_flags(events: DataFrame, ed: str = "EDvisit", ip: str = "inpatientVisit", avoid_ed: str = "avoidableEdVisit", avoid_ip: str = "avoidableIpVisit") -> DataFrame:
    """Six 0/1 columns: all-cause, avoidable and other, for each kind of visit."""
    is_ed, is_ip = F.col(ed) == 1, F.col(ip) == 1
    return events.withColumns(
        {
            "allCauseEdVisit": flag(is_ed),
            "avoidEdVisit": flag(is_ed & (F.col(avoid_ed) == 1)),
            "nonAvoidEdVisit": flag(is_ed & (F.col(avoid_ed) == 0)),
            "allCauseIpVisit": flag(is_ip),
            "avoidIpVisit": flag(is_ip & (F.col(avoid_ip) == 1)),
            "nonAvoidIpVisit": flag(is_ip & (F.col(avoid_ip) == 0)),
        }
    )


def inpatient_over_ed(episodes: DataFrame) -> DataFrame:
    """Episode flags where an inpatient stay outranks its emergency visits."""
    no_stay = F.col("allCauseIpVisit") == 0
    return episodes.withColumns(
        {
            "allCauseIp": flag(F.col("allCauseIpVisit") == 1),
            "avoidIp": flag(F.col("avoidIpVisit") == 1),
            "nonAvoidIp": flag(F.col("nonAvoidIpVisit") == 1),
            "allCauseEd": flag(no_stay & (F.col("allCauseEdVisit") == 1)),
            "avoidableEd": flag(no_stay & (F.col("avoidEdVisit") == 1)),
            "nonAvoidableEd": flag(no_stay & (F.col("nonAvoidEdVisit") == 1)),
        }
    )


def first_match(rules: Sequence[tuple[str, Column]]) -> dict[str, Column]:
    """Exclusive 0/1 columns: each rule counts only where no earlier one holds."""
    out, taken = {}, F.lit(False)
    for name, condition in rules:
        out[name] = flag(condition & ~taken)
        taken = taken | condition
    return out


def hierarchy(episodes: DataFrame) -> DataFrame:
    """Exactly one of four classes per episode."""
    rules = (
        ("non_avoid_ip", F.col("nonAvoidIp") == 1),
        ("avoid_ip", F.col("avoidIp") == 1),
        ("non_avoid_ed", F.col("nonAvoidableEd") == 1),
        ("avoid_ed", F.col("avoidableEd") == 1),
    )
    return episodes.withColumns(first_match(rules))


def lead_diagnosis(events: DataFrame, code: str) -> DataFrame:
    """Diagnosis of the lines that make an episode avoidable, for the category roll-up."""
    return events.withColumns(
        {
            "_ip_dx": F.when(F.col("avoidIpVisit") == 1, F.col(code)),
            "_ed_dx": F.when(F.col("avoidEdVisit") == 1, F.col(code)),
        }
    )


def top_categories(episodes: DataFrame, categories: DataFrame, code: str, category: str) -> DataFrame:
    """Avoidable episodes per diagnosis category and kind, unlisted diagnoses under NULL.

    ``episodes`` carries the maximum of the two columns of ``lead_diagnosis``.
    Diagnoses are counted before the lookup, so the join sees one row per code.
    """
    kind = F.when(F.col("avoid_ip") == 1, "ip").when(F.col("avoid_ed") == 1, "ed")
    diagnosis = F.when(F.col("avoid_ip") == 1, F.col("_ip_dx")).otherwise(F.col("_ed_dx"))
    counted = (
        episodes.where((F.col("avoid_ip") == 1) | (F.col("avoid_ed") == 1))
        .groupBy(kind.alias("kind"), diagnosis.alias(code))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        counted.join(categories.select(code, category), code, "left")
        .groupBy("kind", category)
        .agg(F.sum("_n").alias("episodes"))
    )
