"""Exact quantiles by narrowing: rows are counted in bins, the bin of a rank is divided again.

A pass is one aggregate over the rows of the intervals still open, combined on
the map side to (interval, bin). Only counts and the limits of bins reach the
driver, BINS + 4 of them for each open interval, however many rows there are.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes

BINS = 1024
#: Intervals wider than this are divided by logarithms, so a few huge values don't cost passes.
WIDE = 1e6

_INTERVALS = "interval int, measure string, low double, high double, least double, most double, begin double, width double, logged boolean"


def rank_of(point: float, rows: int) -> int:
    """Rank (from 1) of the smallest value that at least this part of the rows doesn't exceed."""
    return max(1, rows - math.floor(rows - point * rows))


def _logged(value: float) -> float:
    return math.copysign(math.log1p(abs(value)), value)


def _interval(number: int, measure: str, low: float, high: float, least: float, most: float) -> tuple:
    """`low` and `high` hold all rows of the interval, `least` and `most` its finite values."""
    logged = math.isinf(most - least) or (most - least > WIDE and _logged(most) - _logged(least) > 1)
    begin, end = (_logged(least), _logged(most)) if logged else (least, most)
    return number, measure, low, high, least, most, begin, (end - begin) or 1.0, logged


def _bin() -> Column:
    """Bins rise with the value; the least and the most finite value, and what lies beyond, have bins of their own."""
    value = F.col("value")
    scaled = F.when(F.col("logged"), F.signum(value) * F.log1p(F.abs(value))).otherwise(value)
    inner = F.floor(F.greatest(F.lit(0.0), F.least((scaled - F.col("begin")) / F.col("width"), F.lit(1.0))) * BINS)
    return (
        F.when(value < F.col("least"), 0).when(value == F.col("least"), 1)
        .when(value > F.col("most"), BINS + 3).when(value == F.col("most"), BINS + 2)
        .otherwise(F.least(inner, F.lit(BINS - 1)).cast("int") + 2)
    )


def exact_quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float] = codes.QUARTILES) -> DataFrame:
    """(measure, point, value): the value of rank ceil(point * rows) of each column, exact at any size.

    Columns are read as doubles; null and NaN are left out, infinite values
    count. A column without values gives null. `df` is read once for each pass,
    about three for amounts in cents, so store it first if it is costly.
    """
    spark = df.sparkSession
    cells = [cell for c in columns for cell in (F.lit(c), F.col(c).cast("double"))]
    values = df.select(F.stack(F.lit(len(columns)), *cells).alias("measure", "value")).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    finite = F.when(F.abs("value") < math.inf, F.col("value"))
    sizes = values.groupBy("measure").agg(
        F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.coalesce(F.min(finite), F.lit(0.0)).alias("least"), F.coalesce(F.max(finite), F.lit(0.0)).alias("most"),
    )
    found: dict[tuple[str, float], float] = {}
    todo = [
        ((s.measure, s.low, s.high, s.least, s.most), [(rank_of(p, s.rows), p) for p in dict.fromkeys(map(float, points))])
        for s in sizes.collect()
    ]
    while todo:
        intervals = [_interval(i, *limits) for i, (limits, _) in enumerate(todo)]
        counted = (
            values.join(F.broadcast(spark.createDataFrame(intervals, _INTERVALS)), "measure")
            .where("value between low and high")
            .select("interval", "value", _bin().alias("bin"))
            .groupBy("interval", "bin")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
        )
        bins = defaultdict(list)
        for row in counted.collect():
            bins[row.interval].append((row.bin, row.rows, row.low, row.high))
        following = defaultdict(list)
        for i, ((measure, *_), wanted) in enumerate(todo):
            for rank, point in wanted:
                for _, rows, low, high in sorted(bins[i]):
                    if rank <= rows:
                        break
                    rank -= rows
                if low == high:
                    found[measure, point] = low
                else:
                    following[measure, low, high, low, high].append((rank, point))
        todo = list(following.items())
    return spark.createDataFrame(
        [(c, float(p), found.get((c, float(p)))) for c in columns for p in points], "measure string, point double, value double"
    )
