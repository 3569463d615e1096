"""Exact quantiles against a sorted list, on values that defeat equal bins, ties and hard rows."""

from __future__ import annotations

import math
import random

from claimloom.operators import selection

POINTS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0)


def plain(values: list[float | None], point: float) -> float | None:
    kept = sorted(v for v in values if v is not None and not math.isnan(v))
    return kept[selection.rank_of(point, len(kept)) - 1] if kept else None


def check(df, columns, points=POINTS) -> None:
    table = df.select(*columns).collect()
    found = {(r.measure, r.point): r.value for r in selection.exact_quantiles(df, columns, points).collect()}
    assert found == {(c, p): plain([None if r[c] is None else float(r[c]) for r in table], p) for c in columns for p in points}


def test_against_sorting(spark):
    draw = random.Random(1)
    rows = [
        (
            round(draw.lognormvariate(4, 3), 2),
            draw.random() ** 40,
            float(draw.choice([0, 0, 0, 0, 7, 100])),
            draw.randrange(-(10**9), 10**9),
            10.0 ** draw.uniform(-300, 300) * draw.choice([1, -1]),
            1e15 + draw.randrange(1000) / 8,
        )
        for _ in range(20_000)
    ]
    check(spark.createDataFrame(rows, "cents double, small double, ties double, whole long, wide double, near double").repartition(7), ["cents", "small", "ties", "whole", "wide", "near"])


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1.0, None, 5.0, inf, -inf, 1.7e308), (2.0, None, 5.0, -inf, -inf, -1.7e308), (nan, None, 5.0, 3.0, inf, 0.0),
        (None, None, 5.0, nan, inf, -0.0), (-0.0, None, 5.0, -3.0, None, 5e-324), (0.0, None, None, 1e300, nan, -5e-324),
    ]
    df = spark.createDataFrame(rows, "a double, empty double, same double, mixed double, ends double, extremes double")
    check(df, ["a", "empty", "same", "mixed", "ends", "extremes"])
    check(df.limit(0), ["a", "empty"])
    check(df, ["a"], (0.5,))


def test_only_counts_reach_the_driver(spark, monkeypatch):
    """The rows collected depend on bins and intervals, not on the input; each pass divides the open bins."""
    collected = []
    real = type(spark.range(1)).collect

    def counting(df):
        out = real(df)
        collected.append(len(out))
        return out

    df = spark.range(200_000).selectExpr("rand(3) * 1000 x")
    df.write.mode("overwrite").saveAsTable("uniform_rows")
    stored = spark.table("uniform_rows")
    monkeypatch.setattr(selection, "BINS", 64)
    monkeypatch.setattr(type(spark.range(1)), "collect", counting)
    result = selection.exact_quantiles(stored, ["x"], (0.5,))
    monkeypatch.undo()
    assert result.first().value == plain([r.x for r in stored.collect()], 0.5)
    assert max(collected) <= 68 and len(collected) <= 6
