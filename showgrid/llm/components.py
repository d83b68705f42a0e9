"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showgrid.llm.common import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id of ``edges``; ``component`` is the smallest id that is reachable.

    Each round hangs every neighbour above a node onto the smallest neighbour (large star) and then the
    node and its smaller neighbours likewise (small star). The minimum per node is a partial aggregate and the
    star itself a join, so the neighbours of a hub are never gathered in one row. Rounds grow with the
    logarithm of the longest chain; the loop ends when a round changes no edge. Null ids are left out.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u is not null and v is not null and u <> v").distinct())
    e = cut_lineage(e)
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        star = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    return found.union(roots)
