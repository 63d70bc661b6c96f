"""Connected components by repeated contraction, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node of ``edges`` (columns a, b: long).

    Each round every node points to the neighbour of highest degree (itself
    included; the hash decides among equals), edges move to the nodes pointed
    to, and loops vanish.  So a star is gone after one round, and a chain shrinks
    by a constant factor, as the hash changes with the round.  Round tables are written to the shared folder; nothing is collected
    but row counts.  Self loops, repeated and reversed edges are harmless.
    """
    current = materialise(edges.select("a", "b").filter("a <> b").distinct())
    most = current.count()  # edges never increase; nodes are at most twice as many
    pointers: list[DataFrame] = []
    for round_ in range(most_rounds):
        if current.isEmpty():
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("degree"))
        ranked = both.unionByName(degree.select(F.col("b").alias("a"), "b")).join(degree, "b")
        best = F.min(F.struct(-F.col("degree"), F.xxhash64("b", F.lit(round_)), F.col("b").alias("root")))["root"]
        pointed = materialise(ranked.groupBy(F.col("a").alias("node")).agg(best.alias("root")), 2 * most)
        pointers.append(pointed)
        left = pointed.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = pointed.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = current.join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        current = materialise(moved.filter("a <> b").distinct(), most)
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    if not pointers:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = pointers[0]
    for pointed in pointers[1:]:
        step = pointed.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return materialise(roots.join(least, "root").select("node", "component"), 2 * most)
