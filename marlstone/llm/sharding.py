"""Shards by rendezvous hashing of stable record keys.

A record's key meets every shard: the digest of "shard:key" gives a number u in
(0, 1), the score of the shard is weight / -ln(u), and the best score wins.  So
the key and the weights alone decide, a shard gets rows in proportion to its
weight, and a shard that is added (or removed) moves only the rows that it wins
(or held).  All of it is column expressions; whole texts never travel unless
``write_shards`` writes them.

Defined results: a null id is keyed by its text's digest, so such rows spread
over the shards and equal texts among them meet; a null text has no bytes; rows
of one id share a shard, whatever their texts; repeated rows get a slot each;
weights must be positive; an empty table gives an empty one.  Extra columns are
left out of the placement and kept by ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise

#: Hexadecimal digits of the digest that a score uses: 52 bits, which a double holds exactly.
DIGITS = 13


def record_key(doc_id: Column, text: Column) -> Column:
    """The id as text; rows without one are keyed by their text's digest."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def _score(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat(F.lit(f"{shard}:"), key).cast("binary"))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(1 << (4 * DIGITS)))
    return F.lit(float(weight)) / -F.log(u)


def winner(scores: Sequence[Column]) -> Column:
    """The place of the best score; the later place among equals."""
    return F.greatest(*[F.struct(score.alias("score"), F.lit(i).alias("shard")) for i, score in enumerate(scores)])["shard"] if len(scores) > 1 else F.lit(0)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among shards 0 to len(weights) - 1."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    return winner([_score(key, shard, weight) for shard, weight in enumerate(weights)])


def _assigned(rows: DataFrame, weights: Sequence[float], next_weight: float) -> DataFrame:
    """Add shard and grown_shard; the scores are computed once and serve both."""
    if not weights or min(*weights, next_weight) <= 0:
        raise ValueError("every shard needs a positive weight")
    scored = rows.withColumn("scores", F.array(*[_score(F.col("key"), shard, weight) for shard, weight in enumerate([*weights, next_weight])]))
    parts = [F.col("scores")[i] for i in range(len(weights) + 1)]
    return scored.withColumns({"shard": winner(parts[:-1]), "grown_shard": winner(parts)}).drop("scores", "key")


def place(docs: DataFrame, weights: Sequence[float], next_weight: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard of every row.

    ``size`` is the text's UTF-8 bytes and 8 more; ``slot`` counts the rows of a
    shard from 0 without gaps, by doc_id, text_crc32 and size; ``grown_shard`` is
    the shard if one more of ``next_weight`` (as heavy as the last, by default) were there.

    The narrow rows are sorted by range of (shard, id, digest) with a salt, so
    that rows of one id or one text can lie in many parts, and written with their
    places.  A part's first place and row count by shard, at most parts + shards
    rows in all, then turn places into slots: no shard is ever one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), record_key(F.col("doc_id"), F.col("text")).alias("key"))
    rows = _assigned(rows, weights, weights[-1] if next_weight is None else next_weight)
    order = ["shard", "doc_id", "text_crc32", "size", "salt"]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)))
    placed = materialise(salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    runs = placed.groupBy("part", "shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select("part", "shard", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    # parts + shards rows at most, whatever the table's size
    slots = placed.join(F.broadcast(starts), ["part", "shard"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str) -> None:
    """Write whole records below path/shard=N, in the order of their slots; a shard is as many files as its ranges.

    The only step that moves texts, and it moves each once.  All columns are kept; a column ``shard`` of the input is replaced.
    """
    rows = docs.withColumn("shard", rendezvous(record_key(F.col("doc_id"), F.col("text")), weights))
    digest = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))
    # The order's columns have names that no input can have by chance.
    names = {"__digest": digest, "__bytes": F.octet_length(F.coalesce("text", F.lit(""))), "__salt": salt}
    order = ["shard", "doc_id", *names]
    rows.withColumns(names).repartitionByRange(*order).sortWithinPartitions(*order).drop(*names).write.mode("error").partitionBy("shard").parquet(path)


def balance(placed: DataFrame, weights: Sequence[float]) -> DataFrame:
    """shard, n_rows, bytes, share of the rows, expected share by weight, n_moved (rows that one more shard takes); a row per shard, empty ones included."""
    spark, total = placed.sparkSession, float(sum(weights))
    shards = spark.createDataFrame([(i, w / total) for i, w in enumerate(weights)], "shard int, expected double")
    moved = F.sum((F.col("grown_shard") != F.col("shard")).cast("long"))
    found = placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"), moved.alias("n_moved"))
    out = shards.join(found, "shard", "left").na.fill(0, ["n_rows", "bytes", "n_moved"])
    share = F.try_divide(F.col("n_rows").cast("double"), F.sum("n_rows").over(Window.partitionBy()))  # a row per shard
    return out.select("shard", "n_rows", "bytes", share.alias("share"), "expected", "n_moved")
