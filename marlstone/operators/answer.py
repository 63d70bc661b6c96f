"""The traditional answer chain: an answer from what was found, its validation, and replies where steps fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_sources(questions: DataFrame, sources: DataFrame, lead: str = "根据相关文档，找到以下信息：\n\n", most: int = 5, each: int = 800, chars: int = 500) -> DataFrame:
    """query_id, question, answer, n_sources of the questions with sources (group, place, text): ``lead`` and the beginnings of the first ``most``, cut at ``chars``."""
    first = sources.filter(F.col("place") <= most).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("place", F.substring("text", 1, each).alias("part")))).alias("parts"))
    counted = sources.groupBy("group").agg(F.count("*").alias("n_sources")).join(first, "group")
    told = F.concat(F.lit(lead), F.substring(F.array_join("parts.part", "\n\n"), 1, chars), F.lit("..."))
    return questions.join(counted.withColumnRenamed("group", "query_id"), "query_id").select("query_id", "question", told.alias("answer"), "n_sources")


def with_fallback(questions: DataFrame, said: DataFrame, checked: DataFrame, no_hit: str = "抱歉，没有找到相关信息") -> DataFrame:
    """query_id, status, n_sources, answer, confidence, hallucination of every question: answered, or a fixed reply of no confidence where nothing was found."""
    judged = said.select("query_id", "answer", "n_sources").join(checked.select("query_id", "confidence", "hallucination"), "query_id")
    rows = questions.select("query_id").join(judged, "query_id", "left")
    return rows.select("query_id", F.when(F.col("answer").isNull(), "no_hits").otherwise("answered").alias("status"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("answer", F.lit(no_hit)).alias("answer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("hallucination", F.lit(False)).alias("hallucination"))
