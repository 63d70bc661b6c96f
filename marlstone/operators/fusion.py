"""Merging ranked lists.  ``hits``: query_id, channel, key, rank (1-based), score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def _weight(weights: dict[str, float]) -> Column:
    return reduce(lambda out, item: F.when(F.col("channel") == item[0], F.lit(item[1])).otherwise(out), weights.items(), F.lit(1.0))


def _worst_ranks(hits: DataFrame) -> DataFrame:
    """A key repeated within a channel keeps its last rank."""
    return hits.groupBy("query_id", "key", "channel").agg(F.max("rank").alias("rank"))


def reciprocal_rank_fusion(hits: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """query_id, key, rrf_score, rank, ranks: sum of weight / (k + rank); ties by the ranks in channel order."""
    each = _worst_ranks(hits).withColumn("part", _weight(weights) / (k + F.col("rank")))
    own = [F.min(F.when(F.col("channel") == c, F.col("rank"))).alias(f"rank_{c}") for c in weights]
    fused = each.groupBy("query_id", "key").agg(F.round(F.sum("part"), 9).alias("rrf_score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("ranks"), *own)
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), *[F.asc_nulls_last(f"rank_{c}") for c in weights], "key")
    return fused.withColumn("rank", F.row_number().over(order)).drop(*[f"rank_{c}" for c in weights])


def explain_fusion(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, key, channel, contribution (without weights) and its percentage of the key's sum."""
    each = _worst_ranks(hits).withColumn("contribution", 1 / (k + F.col("rank")))
    total = F.sum("contribution").over(Window.partitionBy("query_id", "key"))
    return each.select("query_id", "key", "channel", F.round("contribution", 9).alias("contribution"), F.round(100 * F.col("contribution") / total, 6).alias("percent"))


def weighted_merge(vector: DataFrame, lexical: DataFrame, k: int, vector_weight: float = 0.5, lexical_weight: float = 0.5, add: bool = False) -> DataFrame:
    """query_id, key, vector_score, bm25_score, hybrid_score, source_type, rank.

    Inputs: query_id, key, score, rank.  Repeated vector keys keep the last one
    (or, with ``add``, their sum); repeated lexical keys add up.  Scores are taken as they are.
    """
    last = F.sum("score") if add else F.max_by("score", "rank")
    v = vector.groupBy("query_id", "key").agg(last.alias("vector_score"))
    b = lexical.groupBy("query_id", "key").agg(F.sum("score").alias("bm25_score"))
    both = v.join(b, ["query_id", "key"], "full_outer")
    kind = F.when(F.col("bm25_score").isNull(), "vector").when(F.col("vector_score").isNull(), "bm25").otherwise("hybrid")
    both = both.withColumn("source_type", kind).fillna(0.0, ["vector_score", "bm25_score"])
    both = both.withColumn("hybrid_score", F.round(vector_weight * F.col("vector_score") + lexical_weight * F.col("bm25_score"), 6))
    return _rank(both, "hybrid_score", k)


def max_merge(vector: DataFrame, lexical: DataFrame, k: int, vector_weight: float, lexical_weight: float) -> DataFrame:
    """The larger weighted score of either channel."""
    both = vector.select("query_id", "key", (F.col("score") * vector_weight).alias("s")).unionByName(lexical.select("query_id", "key", (F.col("score") * lexical_weight).alias("s")))
    return _rank(both.groupBy("query_id", "key").agg(F.round(F.max("s"), 6).alias("score")), "score", k)


def detailed_hits(vector: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Either channel's hits, lexical ones scored by their rank, 1 / (1 + place); a key found by both is hybrid and keeps the vector score."""
    v = vector.groupBy("query_id", "key").agg(F.max("score").alias("v"))
    b = lexical.groupBy("query_id", "key").agg((1 / F.min("rank")).alias("b"))
    both = v.join(b, ["query_id", "key"], "full_outer")
    kind = F.when(F.col("b").isNull(), "vector").when(F.col("v").isNull(), "bm25").otherwise("hybrid")
    return _rank(both.select("query_id", "key", F.round(F.coalesce("v", "b"), 6).alias("score"), kind.alias("source")), "score", k)


def _rank(scored: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "key")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def definition_boost(question: Column, text: Column, indicators: tuple[str, ...], strong: tuple[str, ...] = ()) -> Column:
    """1 + 0.2 for each definition indicator in the text, 0.5 more for a strong one; 1 unless the question asks for a definition."""
    some = reduce(lambda a, b: a + b, [F.contains(text, F.lit(i)).cast("int") for i in indicators])
    more = reduce(lambda a, b: a + b, [F.contains(text, F.lit(i)).cast("int") for i in strong], F.lit(0))
    asks = F.exists(F.array(*[F.lit(i) for i in (*indicators, *strong)]), lambda i: F.contains(question, i))
    return F.when(asks, 1 + 0.2 * some + 0.5 * more).otherwise(F.lit(1.0))
