"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut


def _least_neighbour(both: DataFrame) -> DataFrame:
    """u and the least of u and its neighbours; a partial aggregate, so a node with very many links is no hot task."""
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least_neighbour(down), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row.n, row.h


def connected_components(links: DataFrame) -> DataFrame:
    """links: u, v (long; loops and repeats allowed). One row (node, component) per linked node, component its least node.

    Each round is written to the shared checkpoint folder. An empty table gives an empty result.
    """
    links = cut(links.where("u <> v").distinct())
    state = _state(links)
    while state[0]:
        links = cut(_small_star(_large_star(links)))
        after = _state(links)
        if after == state:
            break
        state = after
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
