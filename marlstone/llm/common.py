"""Small helpers shared by the operators: tables, shared folder, column names."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder that driver and executors share.

    ``spark.checkpoint.dir`` names that folder; where it is unset, on a local
    master only, the warehouse folder of the session serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/marlstone-{uuid.uuid4().hex}"


#: Most rows of an Arrow batch.  Whole texts go through Python, and a worker holds a batch at a time.
ARROW_ROWS = 2048


def bounded(query: Callable) -> Callable:
    """The query, run with Arrow batches of no more than ARROW_ROWS rows."""

    @wraps(query)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        rows = int(spark.conf.get(name))
        if rows <= 0 or rows > ARROW_ROWS:
            spark.conf.set(name, str(ARROW_ROWS))
        return query(spark, *args, **kwargs)

    return run


#: Rows of a narrow table that one file of it holds, about.
FILE_ROWS = 100_000


def materialise(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: losing an executor afterwards costs a re-read of
    files, never the recomputation of the plan above.  ``most_rows``, if it is
    known, keeps a small table from being written as many tiny files.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if most_rows is not None:
        df = df.coalesce(max(8, -(-most_rows // FILE_ROWS)))
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a few numbers each that are broadcast: some 10 MB.
BROADCAST_ROWS = 1 << 18


def small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if its row count allows it; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= most_rows else df


def crc_mod(col: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(modulus))
