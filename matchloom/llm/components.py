"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.skew import hot_limit, split_join
from matchloom.session import discard, materialize


def components(edges: DataFrame, name: str = "components", rows: int | None = None) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b; ``rows``, if that is known): the smallest id reachable.

    Each round links every node's larger neighbours to its smallest neighbour (large
    star), then its smaller ones (small star), until the edges are stars. Rounds grow
    with the logarithm of the longest chain. Each round is written to the shared
    folder; the driver sees two numbers a round. A minimum has partial aggregation,
    only edges, never a node's neighbourhood, are rows, and those of a node with very
    many neighbours are met by many tasks.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e, f"{name}-edges", rows)
    n = e.count()
    before, limit = None, hot_limit(n)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = split_join(both.where("v > u"), least, "u", "c", limit).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"{name}-large", n)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = materialize(small, f"{name}-small", n)
        state = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(large, e)
        e = small
        if tuple(state) == before:
            break
        before = tuple(state)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
