"""Age composition and regression adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.columns import flag, share, total
from ..sources.writers import shared_folder


def one_hot(df: DataFrame, column: str, levels: Sequence[str], prefix: str = "") -> DataFrame:
    """A 0/1 column per level of a fixed list."""
    return df.withColumns({f"{prefix}{level}": flag(F.col(column) == level) for level in levels})


def composition(
    members: DataFrame,
    by: str = "state",
    column: str = "ageCat",
    levels: Sequence[str] = codes.COHORT_AGE_LEVELS,
) -> DataFrame:
    """Percent of each group's members in each level, and the sum of those percents."""
    counts = members.groupBy(by).agg(
        *[F.count_if(F.col(column) == level).alias(f"sum_{level}") for level in levels]
    )
    sized = counts.withColumn("total", total([f"sum_{level}" for level in levels]))
    percents = [f"sum_{level}_percentage" for level in levels]
    return sized.select(
        by, "total", *[share(f"sum_{level}", "total").alias(p) for level, p in zip(levels, percents)]
    ).withColumn("total_percentage", total(percents))


def fit_adjustment(
    rates: DataFrame,
    composition: DataFrame,
    label: str,
    by: str = "state",
    levels: Sequence[str] = codes.COHORT_AGE_LEVELS,
    features: Sequence[str] | None = None,
    tolerance: float = 1e-6,
):
    """Linear model of a rate on the composition: (model, rows with a prediction).

    The rows, one per group, are stored first, so that the passes of the fit and
    the prediction don't repeat the chain of claims behind them. ``tolerance``
    matters where the columns are dependent and the exact solver gives way to
    the iterative one.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    inputs = list(features or [f"sum_{level}_percentage" for level in levels])
    path = shared_folder(rates.sparkSession, "adjustment")
    rates.join(composition, by, "left").write.parquet(path)
    joined = rates.sparkSession.read.parquet(path)
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(joined)
    model = LinearRegression(featuresCol="features", labelCol=label, tol=tolerance).fit(assembled)
    return model, model.transform(assembled)


def adjusted(rates: DataFrame, composition: DataFrame, label: str, by: str = "state", **options) -> DataFrame:
    """Predicted rate per group."""
    _, predicted = fit_adjustment(rates, composition, label, by, **options)
    return predicted.select(by, "prediction")
