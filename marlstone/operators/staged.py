"""Multi-stage retrieval: candidates of two channels are merged, reranked by a model, restricted and boosted.

``hits``: query_id, channel ('vector' or 'bm25'), chunk_id, rank, score, source, text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import models


def best(scored: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def merge_candidates(hits: DataFrame, k: int, alpha: Column | float = 0.5, key: Sequence[Column] | None = None) -> DataFrame:
    """query_id, chunk_id, source_type, hybrid_score, rank of the k best keys.

    A key is the source and the first 100 characters, unless ``key`` says otherwise.  Of a
    key's vector hits the last one counts, its lexical hits add up; scores are taken as they are and
    weighted by alpha and 1 - alpha, where alpha may be a column of the question.
    """
    parts = list(key or (F.col("source"), F.substring("text", 1, 100)))
    named = hits.select("query_id", "channel", "chunk_id", "rank", "score", F.lit(alpha).alias("alpha") if isinstance(alpha, float) else alpha.alias("alpha"), *[p.alias(f"key{i}") for i, p in enumerate(parts)])
    is_vector = F.col("channel") == "vector"
    grouped = named.groupBy("query_id", *[f"key{i}" for i in range(len(parts))]).agg(
        F.first("alpha").alias("alpha"),
        F.max(F.when(is_vector, F.struct("rank", "chunk_id", "score"))).alias("v"),
        F.min(F.when(~is_vector, F.struct("rank", "chunk_id"))).alias("b"),
        F.sum(F.when(~is_vector, F.col("score"))).alias("lexical"),
    )
    kind = F.when(F.col("b").isNull(), "vector").when(F.col("v").isNull(), "bm25").otherwise("hybrid")
    score = F.col("alpha") * F.coalesce("v.score", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("lexical", F.lit(0.0))
    merged = grouped.select("query_id", F.coalesce("v.chunk_id", "b.chunk_id").alias("chunk_id"), kind.alias("source_type"), F.round(score, 6).alias("hybrid_score"))
    return best(merged, "hybrid_score", k)


def model_rerank(candidates: DataFrame, k: int, load: Callable[[], models.PairScorer] = models.overlap_scorer, score: str = "score") -> DataFrame:
    """Adds model_score and final_score = 0.6 model + 0.4 ``score``; the k best of each question.

    ``candidates``: query_id, chunk_id, question, text and ``score``.
    """
    scored = candidates.withColumn("model_score", F.round(models.pair_score(F.col("question"), F.col("text"), load), 6))
    return best(scored.withColumn("final_score", F.round(0.6 * F.col("model_score") + 0.4 * F.col(score), 6)), "final_score", k)


def two_stage_rerank(candidates: DataFrame, relevance: Column, first: int = 50, k: int = 10, load: Callable[[], models.PairScorer] = models.overlap_scorer) -> DataFrame:
    """The ``first`` best by a rule, of them the k best by the model; k candidates or fewer go straight to the model."""
    few = F.count("*").over(Window.partitionBy("query_id")) <= k
    ruled = candidates.withColumn("stage_score", F.when(few, F.col("score")).otherwise(relevance))
    return model_rerank(best(ruled, "stage_score", first).drop("rank"), k, load, "stage_score")


def file_matches(source: Column, pattern: str) -> Column:
    """A glob is matched as a whole, other patterns anywhere in the name; an empty one never."""
    if not pattern:
        return F.lit(False)
    return source.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else rf"\Q{c}\E" for c in pattern) + "$") if "*" in pattern else F.contains(source, F.lit(pattern))


def boosted_first(hits: DataFrame, match: Column, k: int, boost: float = 2.0) -> DataFrame:
    """Hits that match before the others, either in their order of rank; adds matches and match_score."""
    marked = hits.withColumn("matches", F.coalesce(match, F.lit(False)))
    order = Window.partitionBy("query_id").orderBy(F.desc("matches"), "rank")
    placed = marked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return placed.withColumn("match_score", F.when(F.col("matches"), boost).otherwise(1.0)).drop("rank").withColumnRenamed("place", "rank")


def within_files(ranked: DataFrame, keyworded: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, mode, rank: the base retriever's hits in a question's target files; if there are none, keyword
    hits in those files; without target files, the base retriever's hits as they are.

    ``ranked`` (3 k hits of each question) and ``keyworded``: query_id, chunk_id, score, source; ``targets``: query_id, source.
    """
    asked = targets.select("query_id").distinct()
    inside = best(ranked.join(targets.select("query_id", "source").distinct(), ["query_id", "source"], "left_semi"), "score", k).withColumn("mode", F.lit("targeted"))
    missed = asked.join(inside.select("query_id").distinct(), "query_id", "left_anti")
    words = keyworded.join(targets.select("query_id", "source").distinct(), ["query_id", "source"], "left_semi").join(missed, "query_id", "left_semi")
    others = best(ranked.join(asked, "query_id", "left_anti"), "score", k).withColumn("mode", F.lit("global"))
    columns = ["query_id", "chunk_id", "mode", "rank"]
    return inside.select(*columns).unionByName(best(words, "score", k).withColumn("mode", F.lit("keyword")).select(*columns)).unionByName(others.select(*columns))


def topped_up(scored: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, inside, score, rank: the k best rows ``inside``; where they are fewer than k // 2, the other rows among the k less their number best of all follow."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    n = F.count_if("inside").over(Window.partitionBy("query_id"))
    placed = scored.withColumn("n_inside", n).withColumn("place", F.row_number().over(best))
    kept = placed.filter(F.col("inside") | ((F.col("n_inside") < k // 2) & (F.col("place") <= k - F.col("n_inside"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("inside"), F.desc("score"), "chunk_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "inside", "score", "rank")


def merge_adding(hits: DataFrame, boost: Column, k: int, vector_weight: float = 0.4, lexical_weight: float = 0.6) -> DataFrame:
    """query_id, chunk_id, source_type, boosted, rank: hits merged by source and first 100 characters; repeats add up on both sides, then ``boost`` multiplies.

    hits: query_id, channel, chunk_id, rank, score, source, text and what ``boost`` needs; the text that a key met first, vector hits before lexical ones, stands for it.
    """
    weight = F.when(F.col("channel") == "vector", vector_weight).otherwise(lexical_weight)
    met = F.struct((F.col("channel") != "vector").alias("late"), "rank", "chunk_id")
    keyed = hits.withColumns({"key": F.md5(F.concat(F.coalesce("source", F.lit("unknown")), F.lit("_"), F.substring("text", 1, 100))), "boost": boost})
    summed = keyed.groupBy("query_id", "key").agg(F.min_by("chunk_id", met).alias("chunk_id"), F.min_by("boost", met).alias("boost"), F.sum(F.col("score") * weight).alias("score"), F.max(F.col("channel") == "vector").alias("v"), F.max(F.col("channel") != "vector").alias("b"))
    kind = F.when(F.col("v") & F.col("b"), "hybrid").when(F.col("v"), "vector").otherwise("bm25")
    scored = summed.select("query_id", "chunk_id", kind.alias("source_type"), F.round(F.col("score") * F.col("boost"), 6).alias("boosted"))
    order = Window.partitionBy("query_id").orderBy(F.desc("boosted"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
