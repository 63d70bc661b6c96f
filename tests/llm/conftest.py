import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank and long texts, a repeated row, extra columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and the dog sat on the log", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "en"), (5, "word " * 30000, "fr"),
        (6, "Ein Wort, zwei Wörter – 3² <|endoftext|> it's 中文 😀\n\nline\nline\n", "de"), (6, "Ein Wort, zwei Wörter – 3² <|endoftext|> it's 中文 😀\n\nline\nline\n", "de"), (7, "a" * 5000, "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = {n: F.lit(n) for n in ("source", "node", "n", "row", "piece", "length", "score", "kept", "ids", "word", "part", "m", "p", "a", "b")}
    return df.withColumns(extra).withColumn("n_chars", F.length("text"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
