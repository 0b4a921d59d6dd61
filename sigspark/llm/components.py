"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(edges: DataFrame) -> tuple:
    pair = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(pair)).first())


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(a, b) links to (id, component): the smallest id that links lead to.

    Ids without a link don't appear. Each node's smallest neighbour is found by a pre-aggregated
    ``groupBy`` and joined back, so that no task ever holds the neighbours of a node. Every round is
    written to the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    links = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = materialise(links)
    before = _state(links)
    for _ in range(max_rounds if before[0] else 0):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
        )
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
        small = materialise(small)
        discard(links, large)
        links = small
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    found = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return found.unionByName(roots)
