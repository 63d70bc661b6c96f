"""Grounding of answers in their contexts.  Tables: answer_id, question, answer, context."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import lexicons as L
from marlstone.functions import text as X
from marlstone.operators.chunking import sentences


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def unigram_overlap(answer: Column, context: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Share of the answer's distinct tokens that the context holds."""
    own = F.array_distinct(X.tokens(answer, least=1, stopwords=stopwords))
    return _share(F.size(F.array_intersect(own, F.array_distinct(X.tokens(context, least=1, stopwords=stopwords)))), F.size(own))


def bigrams(text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    words = X.tokens(text, least=1, stopwords=stopwords)
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>")))


def bigram_overlap(answer: Column, context: Column, stopwords: tuple[str, ...] = ()) -> Column:
    own = bigrams(answer, stopwords)
    return _share(F.size(F.array_intersect(own, bigrams(context, stopwords))), F.size(own))


def character_overlap(answer: Column, context: Column) -> Column:
    """Share of the answer's distinct characters, blanks and line feeds aside, that the context holds."""
    def characters(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[ \n]", ""), ""), lambda x: x != ""))

    own = characters(answer)
    return _share(F.size(F.array_intersect(own, characters(context))), F.size(own))


def facts(text: Column, patterns: tuple[str, ...] = L.FACT_PATTERNS, indicators: str = L.FACT_INDICATORS, delimiters: str = "。！？\n") -> Column:
    """Distinct matches of the patterns in their order, then the factual sentences."""
    own = lambda p: p if re.compile(p).groups else f"({p})"  # noqa: E731  a pattern's group, if it has one, is the fact
    matched = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(own(p)), F.lit(1)) for p in patterns]))
    return F.concat(F.transform(matched, X.strip), F.filter(sentences(text, delimiters), lambda s: s.rlike(indicators)))


def confidence(rouge: Column, bleu: Column, overlap: Column, n_facts: Column, n_supported: Column, is_date: Column) -> Column:
    """Overlap and fact support by branch, less a penalty for unsupported facts, raised for high overlap; 0 to 1."""
    weighted = 0.3 * rouge + 0.2 * bleu + 0.5 * overlap
    high, good = overlap >= 0.8, weighted >= 0.6
    date_high = overlap >= 0.5

    def branch(a: float, b: float, c: float, d: float, e: float) -> Column:
        return F.when(is_date & date_high, a).when(is_date, b).when(high, c).when(good, d).otherwise(e)

    fact_weight = branch(0.1, 0.2, 0.15, 0.2, 0.35)
    support = F.when(n_facts > 0, n_supported / n_facts * fact_weight).otherwise(fact_weight)
    penalty = (n_facts - n_supported) * branch(0.01, 0.02, 0.02, 0.03, 0.05)
    base = F.greatest(F.lit(0.0), weighted * branch(0.9, 0.8, 0.85, 0.8, 0.65) + support - penalty)
    raised = F.when(is_date & date_high, base * 1.2).when(high, base * 1.15).when(weighted >= 0.7, base * 1.1).otherwise(base)
    return F.least(F.lit(1.0), raised)


def missing_information(kind: Column, answer: Column, context: Column, rules: dict[str, tuple[str, str]]) -> Column:
    """What the context has and the answer lacks; rules: question type -> (label, pattern)."""
    out = F.lit(None).cast("string")
    for name, (label, pattern) in rules.items():
        out = F.when((kind == name) & ~answer.rlike(pattern) & context.rlike(pattern), label).otherwise(out)
    return out


def contradicts(answer: Column, context: Column, pairs: tuple[tuple[str, str], ...] = L.CONTRADICTIONS, shared: int = 3) -> Column:
    both = F.size(F.array_intersect(F.array_distinct(X.tokens(answer, lower=False, least=1)), F.array_distinct(X.tokens(context, lower=False, least=1))))
    found = reduce(lambda a, b: a | b, [F.contains(answer, F.lit(n)) & F.contains(context, F.lit(p)) for n, p in pairs])
    return found & (both > shared)


def complete(question: Column, answer: Column, uncertain: tuple[str, ...] = L.UNCERTAIN, least: int = 10, share: float = 0.3) -> Column:
    asked, said = F.array_distinct(X.tokens(question, lower=False)), F.array_distinct(X.tokens(answer, lower=False))
    hedged = F.exists(F.array(*[F.lit(u) for u in uncertain]), lambda u: F.contains(answer, u))
    return (F.length(answer) >= least) & ~hedged & (F.size(F.array_intersect(asked, said)) >= share * F.size(asked))


def validation_stats(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count("*").alias("answers"), F.round(F.avg(F.col("hallucination").cast("double")), 6).alias("hallucination_rate"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if(F.col("confidence") < 0.5).alias("low"))
