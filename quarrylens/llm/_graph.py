"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarrylens.llm._shared import materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Alternates large-star and small-star steps until every edge points at a root; each round is written, so a lost
    executor repeats one round at most. Minima are aggregated map-side, and the joins that hand them out can be
    split by adaptive execution, so one node may have any share of the edges.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        seen = Observation()
        now = materialize(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
        if state == seen.get:
            break
        state = seen.get
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    root = now.groupBy("a").agg(F.min("b").alias("root"))
    return root.select(F.col("a").alias("node"), "root").unionByName(root.select(F.col("root").alias("node"), "root").distinct())
