"""Rule-based reranking of candidates (query_id, chunk_id, question, text, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators.diversity import lexical_relevance


def simple_relevance(question: Column, content: Column) -> Column:
    return lexical_relevance(question, content, low=100, high=1000, floor=0.5, least=0.3, fall=2000, most_bonus=0.3, lower=False)


def fallback_score(relevance: Column, original: Column) -> Column:
    return F.round(0.7 * relevance + 0.3 * original, 6)


def _add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def entity_bonus(question: Column, content: Column, entities: dict[str, float]) -> Column:
    """Weight times a tenth of the occurrences (at most 1) of entities in both; at most 2."""
    parts = [F.when(F.contains(question, F.lit(e)) & F.contains(content, F.lit(e)), w * F.least(X.occurrences(content, e) * 0.1, F.lit(1.0))).otherwise(0.0) for e, w in entities.items()]
    return F.least(_add(parts), F.lit(2.0))


def matched_terms(question: Column, content: Column, terms: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(question, t) & F.contains(content, t))


def task_relevance(question: Column, content: Column, indicators: dict[str, float]) -> Column:
    """Weight times a tenth of the occurrences (at most 0.5) of indicators in both; 0.3 more for three; at most 1.5."""
    parts = [F.when(F.contains(question, F.lit(i)), w * F.least(X.occurrences(content, i) * 0.1, F.lit(0.5))).otherwise(0.0) for i, w in indicators.items()]
    several = F.when(F.size(matched_terms(question, content, tuple(indicators))) >= 3, 0.3).otherwise(0.0)
    return F.least(_add(parts) + several, F.lit(1.5))


def _ten_character_runs(text: Column) -> Column:
    """Every run of ten characters, one for each start."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{10}))."), F.lit(1))


def enhanced_relevance(question: Column, content: Column) -> Column:
    """Occurrences of the question's words, and of its ten-character runs, by length; at most 2."""
    words = F.filter(X.whitespace_words(question), lambda w: F.length(w) > 1)
    by_word = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.least(X.occurrences(content, w) * 0.1, F.lit(0.5)))
    # Runs of both sides meet in a hash set; a lambda's variable holds the common ones, so that they are made once a pair.
    runs = _ten_character_runs(question)
    common = F.array(F.array_intersect(runs, _ten_character_runs(content)))
    found = F.get(F.transform(common, lambda c: F.size(F.filter(runs, lambda r: F.array_contains(c, r)))), 0)
    by_run = F.when(F.length(question) > 10, 0.3 * found).otherwise(0.0)
    return F.least((by_word + by_run) / (F.length(content) / 1000 + 1), F.lit(2.0))


def enhanced_rerank(candidates: DataFrame, entities: dict[str, float], indicators: dict[str, float], k: int, model_score: Column | None = None) -> DataFrame:
    """final = 0.5 model (or rule relevance) + 0.2 original + 0.3 entity bonus + 0.2 task relevance; best k."""
    q, t = F.col("question"), F.col("text")
    scored = candidates.withColumns({"relevance": F.round(model_score if model_score is not None else enhanced_relevance(q, t), 6), "entity_bonus": F.round(entity_bonus(q, t, entities), 6), "task_relevance": F.round(task_relevance(q, t, indicators), 6)})
    final = F.round(0.5 * F.col("relevance") + 0.2 * F.col("score") + 0.3 * F.col("entity_bonus") + 0.2 * F.col("task_relevance"), 6)
    scored = scored.withColumn("final_score", final)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "chunk_id")))
    return ranked.filter(F.col("rank") <= k)


def rerank_stats(reranked: DataFrame, before: str = "score", after: str = "final_score") -> DataFrame:
    """Mean and population deviation of the scores before and after, and the mean gain, of each question."""
    return reranked.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg(before), 6).alias("mean_before"), F.round(F.avg(after), 6).alias("mean_after"), F.round(F.stddev_pop(after), 6).alias("std_after"), F.round(F.avg(F.col(after) - F.col(before)), 6).alias("gain"))


def term_frequency_in_hits(reranked: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """term, documents: in how many hits a term matched both sides."""
    found = reranked.select(F.explode(matched_terms(F.col("question"), F.col("text"), terms)).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("documents"))


def context_relevance(question_type: Column, context: Column, keywords: dict[str, tuple[tuple[str, ...], float]], section_tag: str = "", keyword_tag: str = "") -> tuple[Column, Column]:
    """Score and matched keywords of a context for a question type: weight per keyword, 0.2 and 0.3 for tags (an empty one is not looked for)."""
    score, hits = F.lit(0.0), F.lit(0)
    for kind, (terms, weight) in reversed(keywords.items()):
        n = reduce(lambda a, b: a + b, [F.contains(context, F.lit(t)).cast("int") for t in terms])
        score, hits = F.when(question_type == kind, weight * n).otherwise(score), F.when(question_type == kind, n).otherwise(hits)
    for tag, points in ((section_tag, 0.2), (keyword_tag, 0.3)):
        if tag:
            score = score + F.when(F.contains(context, F.lit(tag)), points).otherwise(0.0)
    return F.round(score, 6), hits


def answer_quality(question_type: Column, answer: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    """0.2 for more than 20 characters, 0.2 for each term of the question's type; at most 1."""
    hits = F.lit(0)
    for kind, words in reversed(terms.items()):
        hits = F.when(question_type == kind, reduce(lambda a, b: a + b, [F.contains(answer, F.lit(w)).cast("int") for w in words])).otherwise(hits)
    return F.round(F.least(F.when(F.length(answer) > 20, 0.2).otherwise(0.0) + 0.2 * hits, F.lit(1.0)), 6)


def prompt_effectiveness(relevance: Column, quality: Column, says_not_found: Column, least: float = 0.2) -> tuple[Column, Column]:
    """Whether 'not found' was said exactly where the context is irrelevant, and the mean of relevance and quality."""
    return says_not_found == (relevance < least), F.round((relevance + quality) / 2, 6)
