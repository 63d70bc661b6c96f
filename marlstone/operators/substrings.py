"""Substring rules as tables: terms meet the texts that hold them through runs of a few letters, and are then compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _runs(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))


def grams(text: Column) -> Column:
    """Distinct runs of one to GRAM letters."""
    pieces = [F.when(F.length(text) >= n, _runs(text, n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*pieces))


def first_gram(term: Column) -> Column:
    """The run by which a term is found: whatever holds the term holds it."""
    return F.substring(term, 1, GRAM)


def holding(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """text, term of every text that holds a term.

    texts: text; terms: term; either without repeats.  Null and empty terms are held by nothing.  No text meets a term whose first run it lacks.
    """
    keyed = terms.filter("term <> ''").select("term", first_gram(F.col("term")).alias("gram"))
    return texts.select("text", F.explode(grams(F.col("text"))).alias("gram")).join(keyed, "gram").filter(F.contains("text", F.col("term"))).select("text", "term")


def named_files(questions: DataFrame, words: Column, keywords: DataFrame, least: float = 0.6) -> DataFrame:
    """query_id, source, score of files whose keywords a question names.

    questions: query_id, question; ``words``: its tokens; keywords: source, term.  A keyword counts 2 for each
    of its letters where the question holds it, 1 as a token, half where a token holds it or it holds a token; the score is the share of 2 for each letter.
    """
    asked = questions.select("query_id", "question", words.alias("words"))
    tokens = asked.select("query_id", F.explode(F.array_distinct("words")).alias("text"))
    said = asked.select("query_id", F.col("question").alias("text"), F.lit(True).alias("direct")).unionByName(tokens.withColumn("direct", F.lit(False)))
    terms = keywords.select("term").distinct()
    held = holding(said.select("text").distinct(), terms).join(said, "text")
    weight = F.when(F.col("direct"), 2.0).when(F.col("text") == F.col("term"), 1.0).otherwise(0.5)
    within = holding(terms.withColumnRenamed("term", "text"), tokens.select(F.col("text").alias("term")).distinct())
    around = within.select(F.col("text").alias("keyword"), F.col("term").alias("text")).join(tokens, "text").select("query_id", F.col("keyword").alias("term"), F.lit(0.5).alias("weight"))
    best = held.select("query_id", "term", weight.alias("weight")).unionByName(around).groupBy("query_id", "term").agg(F.max("weight").alias("weight"))
    total = keywords.groupBy("source").agg(F.sum(2.0 * F.length("term")).alias("total"))
    got = best.join(keywords, "term").groupBy("query_id", "source").agg(F.sum(F.col("weight") * F.length("term")).alias("got"))
    return got.join(total, "source").select("query_id", "source", F.round(F.col("got") / F.col("total"), 6).alias("score")).filter(F.col("score") >= least)
