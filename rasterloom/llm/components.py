"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import join_spread, stored


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least of u and its partners, also for a u with very many partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join_spread(pairs, least, ["u"])


def components(links: DataFrame, purpose: str) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``links`` (u, v); nothing for an empty table.

    A large-star round links the greater partners of each node to its least one,
    a small-star round does so for the smaller partners. Each round is stored.
    Rounds end when a round changes nothing; every node then points at its least.
    """
    links = stored(links.filter("u != v").distinct(), purpose)
    before = None
    while True:
        total, mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (total, mark) == before or not total:
            break
        before = (total, mark)
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), purpose)
        small = _least(large)
        down = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = small.filter("u != m").select("u", F.col("m").alias("v"))
        links = stored(down.unionByName(own).distinct(), purpose)
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
