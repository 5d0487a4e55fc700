"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): every vertex of the edges with the least id it is connected to.

    Alternates large-star and small-star steps, which settle in a logarithmic number of rounds for
    any shape of graph, where passing labels on takes as many rounds as the longest path. Every
    round is a checkpoint in the shared folder. Loops and repeated edges count once; null ends
    are dropped; an empty table gives none.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    vertices = e.select(F.col("u").alias("id")).unionByName(e.select(F.col("v").alias("id"))).distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def large_star(x: DataFrame) -> DataFrame:
        both = x.unionByName(x.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small_star(x: DataFrame) -> DataFrame:
        x = x.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = x.groupBy("u").agg(F.min("v").alias("m"))
        j = x.join(least, "u")
        return j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    def mark(x: DataFrame):
        return x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(e)
    for _ in range(max_rounds):
        e = cut(small_star(large_star(e)))
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components have not settled after {max_rounds} rounds")
    root = e.groupBy("u").agg(F.min("v").alias("component"))
    return vertices.join(root, vertices["id"] == root["u"], "left").select("id", F.coalesce("component", "id").alias("component"))
