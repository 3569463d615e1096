"""Connected components of a link table by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(links: DataFrame) -> DataFrame:
    """The smallest node that every node of `links` (a, b: long) can reach: node, root.

    In turn, every node ties its larger neighbours and then its smaller ones to
    its smallest neighbour, until nothing changes; that takes about log(n)
    rounds. Each round is joins and grouped minima over a stored table, so a
    node with very many neighbours is split like any frequent join key.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("least"))
        small = (
            large.join(low, "u").select("v", "least").where("v <> least").toDF("u", "v")
            .unionByName(low.toDF("u", "v")).distinct()
        )
        edges = stored(small, "links")
        # the sum tells two rounds apart: every step only ever lowers the smaller ends
        now = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            return edges.toDF("node", "root").unionByName(edges.select("v", "v").distinct().toDF("node", "root"))
        seen = now
