"""Distributed union-find over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import free_shuffles, keep_only, mark, written


#: A graph of at most so many edges is small: a node's least neighbour (16 bytes a node, two nodes an edge) is broadcast
#: instead of joined by shuffle, and what its aggregates give is read by so many tasks, however many partitions the session deals.
SMALL_EDGES, SMALL_TASKS = 200_000, 8


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """Label the nodes of an undirected graph: columns node, component (the smallest node it reaches).

    Alternating large-star and small-star rounds: every round is a min aggregate with map-side combine and an
    equi-join, so no node's neighbourhood is ever gathered in one place, and the rounds grow with the logarithm
    of the longest path. No round has more edges than the first, whose count tells whether the graph is small. Each
    round is written to the shared scratch folder, and the round before deleted. Loops and nulls are ignored; nodes
    without an edge to another node do not appear. An empty table gives an empty table.
    """
    spark, began = edges.sparkSession, mark()
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))).distinct()
    e = written(e, "edges")
    was = _state(e)
    few = was[0] <= SMALL_EDGES
    fit = lambda df: df.coalesce(SMALL_TASKS) if few else df
    side = lambda df: F.broadcast(df) if few else df
    for turn in range(most_rounds):
        if not was[0]:
            break
        e = fit(e)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(side(fit(least)), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = fit(large)
        least = fit(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = written(fit(small), "edges")
        del both, least, large, small
        keep_only(spark, began, e)
        if turn % 3 == 2:
            free_shuffles(spark)
        now = _state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("connected_components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
