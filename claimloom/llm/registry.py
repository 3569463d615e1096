"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def reachable(spark: SparkSession) -> None:
    """Let this session's Python workers find the package where it is not installed but lies on a shared path."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            reachable(spark)
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return function

    return register
