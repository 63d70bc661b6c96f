"""Reporting aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corpus_report(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("languages"), F.round(F.avg(F.length("text")), 6).alias("mean_characters"))


def source_counts(rows: DataFrame, source: str = "source") -> DataFrame:
    return rows.groupBy(source).agg(F.count("*").alias("n"))


def run_report(runs: DataFrame, seconds: Column, features: dict[str, Column]) -> DataFrame:
    return runs.agg(F.count("*").alias("runs"), F.round(F.sum(seconds), 6).alias("total"), F.round(F.avg(seconds), 6).alias("mean"), F.round(F.min(seconds), 6).alias("least"), F.round(F.max(seconds), 6).alias("most"), *[F.count_if(c).alias(n) for n, c in features.items()])


def usage_flags(rows: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """For each key, whether any of its rows has the feature."""
    return rows.groupBy(key).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()])


def grade(score: Column, ready: Column, seconds: Column) -> Column:
    return F.when((score >= 0.9) & ready & (seconds < 10), "A+").when((score >= 0.8) & ready, "A").when(score >= 0.6, "B").otherwise("C")


def answer_records(answers: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Numbers answers Q0001, Q0002, ... and shows n_sources / 10 as confidence with two decimals.

    A number needs the order of all rows: ranges are numbered side by side and
    shifted by the rows before them, so that no task sorts the whole.
    """
    ranged = answers.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    within = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = within.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = within.join(sizes.select("__part", before.alias("__before")), "__part")
    number = (F.col("__n") + F.col("__before")).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return shifted.select(*answers.columns, F.concat(F.lit("Q"), padded).alias("number"), F.format_string("%.2f", F.least(F.col("n_sources") / 10, F.lit(1.0))).alias("confidence"))
