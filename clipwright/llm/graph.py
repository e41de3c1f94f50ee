"""Connected components on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipwright.llm.common import cut, drop_cut


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph whose edges are the rows (a, b), two columns of type long.

    Returns (node, root): a row for each node that has an edge to another; root is the smallest
    node it reaches. Null ends, loops and repeated edges count for nothing; no edges give no rows.

    Large-star and small-star steps alternate until every edge leads to a root. Each step is a
    grouped minimum, which is combined before the shuffle, and a join back, whose hot keys Spark
    can split. Each round is cut off from its lineage, and the one before it deleted; two numbers reach the driver.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, seen = cut(now), None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, cut(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        drop_cut(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
