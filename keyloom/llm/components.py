"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import attach, cut


def _print(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b).cast("decimal(20,0)")  # sums of longs would overflow


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node with a link to another: root is the least node of its component.

    Large stars hang the larger neighbours of each node on its least neighbour, small stars the smaller ones; by turns they
    leave a star for each component after about log2(nodes) rounds. Links never leave the cluster; each round is cut, so
    that a lost executor repeats one round at most. Null ends and loops count for nothing; an empty table gives none.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        total = 2 * edges.count()
        large = attach(both, least, "u", "n", total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = attach(large, least, "u", "n", total)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(_print(F.col("u"), F.col("v")))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
