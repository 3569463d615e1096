"""Distributions across units and variation within groups.

Quantiles are Spark's mergeable percentile summaries: each task condenses its
rows, so a group of any size reaches the final task as one bounded summary.
``accuracy`` bounds the rank error by 1/accuracy; a value above the group size
makes the result exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from .relational import names

DEFAULT_ACCURACY = 10_000


def distribution(
    df: DataFrame,
    columns: Sequence[str],
    points: Sequence[float] = codes.QUARTILES,
    accuracy: int = DEFAULT_ACCURACY,
) -> DataFrame:
    """(measure, point, value) for each measure and quantile point, in one pass."""
    summary = df.agg(
        *[F.percentile_approx(c, list(points), accuracy).alias(c) for c in columns]
    )
    cells = [
        cell
        for c in columns
        for i, p in enumerate(points)
        for cell in (F.lit(c), F.lit(float(p)), F.get(F.col(c), F.lit(i)).cast("double"))
    ]
    return summary.select(
        F.stack(F.lit(len(columns) * len(points)), *cells).alias("measure", "point", "value")
    )


def spread(
    df: DataFrame,
    by: str | Sequence[str],
    measures: Mapping[str, str],
    accuracy: int = DEFAULT_ACCURACY,
) -> DataFrame:
    """Quartiles, extremes, range and inter-quartile range of each measure per group.

    ``measures`` maps a column suffix to its source, e.g. ``{"rate": "avoid_ed"}``
    gives p25_rate, p75_rate, min_rate, max_rate, range_rate and iqr_rate.
    """
    by = names(by)
    aggregates = []
    for label, column in measures.items():
        aggregates += [
            F.percentile_approx(column, [0.25, 0.75], accuracy).alias(f"_q_{label}"),
            F.min(column).alias(f"min_{label}"),
            F.max(column).alias(f"max_{label}"),
        ]
    grouped = df.groupBy(*by).agg(*aggregates)
    out = []
    for label in measures:
        p25, p75 = F.get(f"_q_{label}", F.lit(0)), F.get(f"_q_{label}", F.lit(1))
        out += [
            p25.alias(f"p25_{label}"),
            p75.alias(f"p75_{label}"),
            F.col(f"min_{label}"),
            F.col(f"max_{label}"),
            (F.col(f"max_{label}") - F.col(f"min_{label}")).alias(f"range_{label}"),
            (p75 - p25).alias(f"iqr_{label}"),
        ]
    return grouped.select(*by, *out)


# Rate and share pairs described together, by kind of care.
CARE_MEASURES = {
    "acute": {"rate": "non_emergent_acute", "percent": "acute_percent"},
    "ed": {"rate": "avoid_ed", "percent": "ed_percent"},
    "ip": {"rate": "avoid_ip", "percent": "ip_percent"},
}


def size_summary(
    df: DataFrame,
    column: str,
    extra: Sequence[float] = (0.9, 0.95, 0.99),
    accuracy: int = 1_000_000,
) -> DataFrame:
    """min, quartiles, upper percentiles and max of one column as (summary, value) rows."""
    points = {"25%": 0.25, "50%": 0.5, "75%": 0.75, **{f"{p:.0%}": p for p in extra}}
    summary = df.agg(
        F.min(column).alias("_min"),
        F.max(column).alias("_max"),
        F.percentile_approx(column, list(points.values()), accuracy).alias("_q"),
    )
    cells = [F.lit("min"), F.col("_min").cast("double"), F.lit("max"), F.col("_max").cast("double")]
    for i, label in enumerate(points):
        cells += [F.lit(label), F.get("_q", F.lit(i)).cast("double")]
    return summary.select(F.stack(F.lit(len(points) + 2), *cells).alias("summary", column))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum as one row."""
    return df.agg(
        F.count(column).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev(column).alias("stddev"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
