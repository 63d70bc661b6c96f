"""Rule-based classification and rewriting of questions and texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import text as X


def best_category(text: Column, categories: Mapping[str, Sequence[str]], least: float = 1, weight: float = 1.0) -> Column:
    """The category of most occurrences times length of its terms; the first on a tie; null below ``least``."""
    low = F.lower(text)
    scores = {name: reduce(lambda a, b: a + b, [X.occurrences(low, t.lower()) * len(t) for t in terms]) * F.lit(weight) for name, terms in categories.items()}
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.lit(None).cast("string")
    for name, score in reversed(scores.items()):
        out = F.when(score == top, name).otherwise(out)
    return F.when(top >= least, out)


def weighted_type(text: Column, rules: Mapping[str, tuple[Sequence[str], Sequence[str]]], default: str, keyword: float = 0.3, pattern: float = 0.5, least: float = 0.3) -> tuple[Column, Column]:
    """Type and confidence: points for keywords and patterns; the share of the best, or (default, 0.5) below ``least``."""
    scores = {name: F.round(reduce(lambda a, b: a + b, [F.contains(text, F.lit(k)).cast("int") * keyword for k in words] + [text.rlike(p).cast("int") * pattern for p in patterns]), 6) for name, (words, patterns) in rules.items()}
    top, total = F.greatest(*scores.values()), reduce(lambda a, b: a + b, scores.values())
    kind = F.lit(default)
    for name, score in reversed(scores.items()):
        kind = F.when(score == top, name).otherwise(kind)
    share = F.try_divide(top, total)
    sure = F.coalesce(share >= least, F.lit(False)) & (top > 0)
    return F.when(sure, kind).otherwise(default), F.round(F.when(sure, share).otherwise(0.5), 6)


def drop_fillers(question: Column, fillers: Sequence[str]) -> Column:
    """Remove fillers one after another while enough of the question is left; collapse blanks."""
    for word in fillers:
        question = F.when(F.contains(question, F.lit(word)) & (F.length(question) > len(word) + 5), F.trim(F.replace(question, F.lit(word), F.lit("")))).otherwise(question)
    return F.regexp_replace(question, r"\s+", " ")


def rewrite(question: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The replacement of the first pattern found; the question itself if none is."""
    out = question
    for pattern, replacement in reversed(rules):
        out = F.when(question.rlike(pattern), F.lit(replacement)).otherwise(out)
    return out


def retrieval_strategy(confidence: Column) -> Column:
    sure = F.struct(F.lit(0.3).alias("alpha"), F.lit(15).alias("vector_k"), F.lit(35).alias("bm25_k"))
    even = F.struct(F.lit(0.5).alias("alpha"), F.lit(20).alias("vector_k"), F.lit(30).alias("bm25_k"))
    return F.when(confidence > 0.3, sure).otherwise(even)


def _first_best(scores: Mapping[str, Column], default: Column) -> tuple[Column, Column]:
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = default
    for name, score in reversed(scores.items()):
        out = F.when(score == top, name).otherwise(out)
    return F.when(top > 0, out).otherwise(default), top


def points_category(text: Column, rules: Mapping[str, tuple[Sequence[str], Sequence[str]]], default: str) -> tuple[Column, Column]:
    """Category and points: one for each keyword in the text, two for each pattern; the first on a tie."""
    scores = {name: reduce(lambda a, b: a + b, [F.contains(text, F.lit(k)).cast("int") for k in words] + [2 * text.rlike(p).cast("int") for p in patterns]) for name, (words, patterns) in rules.items()}
    return _first_best(scores, F.lit(default))


def named_type(question: Column, names: Mapping[str, Sequence[str]]) -> tuple[Column, Column]:
    """The best name and its confidence, points / 3 up to 1: 2 points for a keyword, else 0.5 for one of its parts, 3 for the name."""
    low, scores = F.lower(question), {}
    for name, keywords in names.items():
        points = F.when(F.contains(question, F.lit(name)), 3.0).otherwise(0.0)
        for keyword in keywords:
            some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in keyword.split()])
            points = points + F.when(F.contains(question, F.lit(keyword)), 2.0).when(some, 0.5).otherwise(0.0)
        scores[name] = points
    name, top = _first_best(scores, F.lit(None).cast("string"))
    return name, F.round(F.least(top / 3, F.lit(1.0)), 6)


def asks_for_ideas(kind: Column, keywords: Column, kinds: Sequence[str], words: Sequence[str]) -> Column:
    """Whether a question is of an open type or has one of the words among its keywords."""
    return kind.isin(*kinds) | F.arrays_overlap(keywords, F.array(*[F.lit(w) for w in words]))
