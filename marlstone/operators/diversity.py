"""Source diversity: caps, bonuses and balance.  ``scored``: query_id, chunk_id, source, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X


def lexical_relevance(question: Column, content: Column, low: int = 200, high: int = 800, floor: float = 0.6, least: float = 0.4, fall: int = 1500, most_bonus: float = 0.2, lower: bool = True) -> Column:
    """Share of the question's words found, by a length factor, with a bonus for words near the front; at most 1."""
    question, content = (F.lower(question), F.lower(content)) if lower else (question, content)
    words = F.array_distinct(X.whitespace_words(question))
    have = F.array_distinct(X.whitespace_words(content))
    share = F.size(F.array_intersect(words, have)) / F.size(words)
    n = F.length(content)
    factor = F.when(n < low, floor + n / low * (1 - floor)).when(n <= high, 1.0).otherwise(F.greatest(F.lit(least), 1 - (n - high) / fall))
    early = F.size(F.filter(words, lambda w: (F.position(w, content) > 0) & (F.position(w, content) - 1 < n * 0.3)))
    score = share * factor + F.least(0.1 * early, F.lit(most_bonus))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.least(score, F.lit(1.0)))


def select_diverse(scored: DataFrame, k: int, cap: int = 2) -> DataFrame:
    """At most ``cap`` of a source, up to 2k in order; where fewer than k are found, one more of each source."""
    order = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "chunk_id")
    placed = scored.withColumn("of_source", F.row_number().over(order))
    first = placed.withColumn("pass", F.when(F.col("of_source") <= cap, 1).when(F.col("of_source") == cap + 1, 2)).filter("pass is not null")
    enough = F.count_if(F.col("pass") == 1).over(Window.partitionBy("query_id")) >= k
    usable = first.withColumn("enough", enough).filter((F.col("pass") == 1) | ~F.col("enough"))
    rank = Window.partitionBy("query_id").orderBy("pass", F.desc("score"), "chunk_id")
    taken = usable.withColumn("rank", F.row_number().over(rank))
    return taken.filter(F.col("rank") <= F.when(F.col("enough"), 2 * k).otherwise(k)).select("query_id", "chunk_id", "source", "score", "rank")


def diversity_bonus(scored: DataFrame, weight: float = 0.3) -> DataFrame:
    """score * (1 - weight) + weight / hits of the source within the question."""
    same = F.count("*").over(Window.partitionBy("query_id", "source"))
    out = scored.withColumn("diverse_score", F.round(F.col("score") * (1 - weight) + weight / same, 6))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("diverse_score"), "chunk_id")))


def balanced_rerank(scored: DataFrame, k: int, cap: int = 2) -> DataFrame:
    """The first ``cap`` of each source come first, then a further one of each, in order of score."""
    of_source = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "chunk_id"))
    tier = F.when(F.col("of_source") <= cap, 1).when(F.col("of_source") == cap + 1, 2)
    placed = scored.withColumn("of_source", of_source).withColumn("tier", tier).filter("tier is not null")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "chunk_id")))
    return ranked.filter(F.col("rank") <= k).drop("of_source", "tier")


def source_balance(hits: DataFrame) -> DataFrame:
    """A row per question: most, fewest and mean hits of a source, most over fewest, number of sources."""
    each = hits.groupBy("query_id", "source").agg(F.count("*").alias("n"))
    return each.groupBy("query_id").agg(F.max("n").alias("max_count"), F.min("n").alias("min_count"), F.round(F.avg("n"), 6).alias("avg_count"), F.round(F.max("n") / F.min("n"), 6).alias("bias_ratio"), F.count("*").alias("source_count"))
