"""A corpus pipeline of four stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.

Contract of all stages: an empty table gives an empty table.  Null, empty and
blank texts fail the base rules, so the first stage drops them; the later ones
by themselves keep them (toxicity: scored by the bias; near duplicates: linked
with nothing; packing: the end token alone).  Rows without an id are judged
like others and never dropped as copies.  Repeated rows share their fate in the
first two stages; the third keeps one of them.  Ties between linked documents
go to the least id.  Extra columns stay as they are through the first three
stages, whatever their names, and are left out of the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import jaccard, quality, toxicity
from marlstone.llm.common import bounded, materialise, table
from marlstone.llm.queries import packed_documents


@bounded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@bounded
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on those left, predicts clean."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates."""
    return jaccard.keep_one(docs)


@bounded
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, packed into sequences."""
    return packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", pack_sequences),
]

#: Thresholds, a fitted machine and a tokenizer are beyond SQL.
ORACLE_SQL = None


@bounded
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
