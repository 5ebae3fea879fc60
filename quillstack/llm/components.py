"""Connected components of a table of links, by alternating large and small stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, new_folder, written


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """v, root of every vertex of `links` (a, b): root is the smallest vertex that v can reach.

    A large star links the larger neighbours of a vertex with the least of its neighbours and itself, a small star does so with the
    smaller ones and itself; alternating, every component becomes a star in O(log^2) rounds. Each round is written to the shared folder,
    which the next round's then replaces, and the number of links never grows. Null ends are left out; loops and repeated links do no harm; no links give no rows.
    """
    pairs = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    at = new_folder(links.sparkSession, "links")
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), at=at)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    for _ in range(most_rounds if before[0] else 0):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, at = at, new_folder(links.sparkSession, "stars")
        edges = written(small.where(F.col("u") != F.col("v")).distinct(), at=at)
        dropped(links.sparkSession, old)
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).union(edges.select("v", F.col("v").alias("root")).distinct())
