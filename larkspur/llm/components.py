"""Connected components over an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import materialize


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """edges (a long, b long), any direction. Returns (node, root): root is the least node of the component.

    Alternates large-star and small-star steps until nothing changes. Every step aggregates to one minimum a node, which is
    written down before it joins: the join's side of minima has one row a node, so that Spark can split the edges of a hub
    over several tasks.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, "cc-0")
    step = 0
    mark = None
    while True:
        # large star: each larger neighbour links to the least of the neighbourhood
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), folder, f"cc-least-{step}")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, folder, f"cc-large-{step}")
        # small star: smaller neighbours and the node link to the least of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), folder, f"cc-small-{step}")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step += 1
        new = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), folder, f"cc-{step}")
        seen = new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.count_distinct("u").alias("k")).first()
        if tuple(seen) == mark and seen.n == seen.k:
            break
        mark, now = tuple(seen), new
    roots = new.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
