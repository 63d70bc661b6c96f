"""Reading the input tables and writing intermediate and result tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer file splits than cores is dealt to all of them, as it may be one row group, which one task reads; a larger one stays."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, doc_id, source, lang, text: each document is a chunk, its source plays the file."""
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("chunk_id"), "doc_id", "source", "lang", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question: the benchmark's items."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer_id, question, answer, context: each assistant turn, the user turn before it, all user turns as context."""
    rows = table(spark, sf_dir, "conversations")
    said = rows.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    asked = rows.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    context = rows.filter("role <> 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c")).select("conv_id", F.array_join("c.text", "\n").alias("context"))
    joined = said.join(asked, ["conv_id", "turn"]).join(context, "conv_id")
    return joined.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "question", "answer", "context")


def answer_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(answer_id, group, question, answer) and (group, place, text): the answers of ``answers`` and the turns of their context, as rows."""
    rows = table(spark, sf_dir, "conversations")
    said = rows.filter("role = 'assistant'").select(F.col("conv_id").alias("group"), "turn", F.col("text").alias("answer"))
    asked = rows.filter("role = 'user'").select(F.col("conv_id").alias("group"), (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    joined = said.join(asked, ["group", "turn"]).select((F.col("group") * 1000 + F.col("turn")).alias("answer_id"), "group", "question", "answer")
    return joined, rows.filter("role <> 'assistant'").select(F.col("conv_id").alias("group"), F.col("turn").alias("place"), "text")


def shared_path(spark: SparkSession) -> str:
    """A new path below the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/marlstone-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the folder that all executors share and read back; this cuts the lineage."""
    spark, path = df.sparkSession, shared_path(df.sparkSession)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_files(spark: SparkSession, folder: str, patterns: Sequence[str] = ("*",), recursive: bool = False) -> DataFrame:
    """path, size, modified, content of the files below a folder that match any pattern, each once."""
    glob = patterns[0] if len(patterns) == 1 else "{" + ",".join(patterns) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def write_answers(records: DataFrame, path: str, kind: str = "parquet") -> None:
    """The batch result: number, question, answer, confidence, n_sources."""
    out = records.select("number", "question", "answer", "confidence", "n_sources")
    out.write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def read_questions(spark: SparkSession, path: str, column: str = "question", kind: str = "csv") -> DataFrame:
    """question: the non-blank cells of a column of a question sheet, as CSV with a header or as any other format."""
    sheet = spark.read.format(kind).options(**({"header": "true", "multiLine": "true", "escape": '"'} if kind == "csv" else {})).load(path)
    return sheet.select(F.trim(F.col(f"`{column}`").cast("string")).alias("question")).filter("question <> ''")
