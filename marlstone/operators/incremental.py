"""Snapshots, fingerprints and versions of documents.  Everything is a join of an old and a new table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fingerprints(files: DataFrame) -> DataFrame:
    """path, hash, size of (path, text)."""
    return files.select("path", F.md5(F.coalesce("text", F.lit(""))).alias("hash"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status: new, modified, unchanged or deleted."""
    a = old.select("path", F.col("hash").alias("old_hash"), F.col("size").alias("old_size"))
    b = new.select("path", F.col("hash").alias("new_hash"), F.col("size").alias("new_size"))
    same = F.col("old_hash").eqNullSafe(F.col("new_hash")) & F.col("old_size").eqNullSafe(F.col("new_size"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def changed_files(stored: DataFrame, files: DataFrame) -> DataFrame:
    """The files (path, text) that are new or whose text differs from the stored (path, hash, size)."""
    seen = fingerprints(files).join(stored, ["path", "hash", "size"], "left_anti").select("path")
    return files.join(seen, "path", "left_semi")


#: Rows of an index that a task sorts, about.
ROWS = 1 << 20


def upsert_index(index: DataFrame, stored: DataFrame, files: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An index (path, ...) brought up to date: rows of unchanged files stay as they are, those of changed and missing
    files go, and only new and changed files pass through ``build``.  With an empty index this is a rebuild.  A task gets some ROWS rows of the index, however
    many there are: dealt by their compressed size, as Spark does by itself, they are many times as large in memory."""
    same = fingerprints(files).join(stored, ["path", "hash", "size"], "left_semi").select("path")
    parts = max(1, -(-index.count() // ROWS))
    return index.repartition(parts, "path").join(same.repartition(parts, "path"), "path", "left_semi").unionByName(build(changed_files(stored, files)))


def new_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks (path, chunk_hash) that their file did not hold before."""
    return new.join(old.select("path", "chunk_hash").distinct(), ["path", "chunk_hash"], "left_anti")


def version_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, hash, version, created_at, updated_at: a changed file gets the next version and keeps its creation time.

    old: path, hash, version, created_at, updated_at; new: path, hash, seen_at.
    """
    both = old.select("path", F.col("hash").alias("oh"), "version", "created_at", "updated_at").join(new, "path", "full_outer")
    changed = F.col("hash").isNotNull() & ~F.col("oh").eqNullSafe(F.col("hash"))
    return both.select("path", F.coalesce("hash", "oh").alias("hash"), (F.coalesce("version", F.lit(0)) + changed.cast("int")).alias("version"), F.coalesce("created_at", "seen_at").alias("created_at"), F.when(changed, F.col("seen_at")).otherwise(F.col("updated_at")).alias("updated_at"))


def without_missing(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """Stored rows whose file is still listed."""
    return stored.join(listing.select("path").distinct(), "path", "left_semi")


def content_hash(chunks: DataFrame) -> DataFrame:
    """path, chunk_count, content_hash: digest of the chunk hashes in order."""
    gathered = chunks.groupBy("path").agg(F.count("*").alias("chunk_count"), F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_hash"))).alias("c"))
    return gathered.select("path", "chunk_count", F.md5(F.array_join("c.chunk_hash", "")).alias("content_hash"))


def debounced(changes: DataFrame, quiet_seconds: int = 60) -> DataFrame:
    """Updates (key, updated_at, changes): a burst of changes is one update, made when it has been quiet; none is lost."""
    order = Window.partitionBy("key").orderBy("ts", "id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order).cast("timestamp"))
    placed = changes.withColumn("starts", F.coalesce((gap >= quiet_seconds * 1_000_000).cast("int"), F.lit(1)))
    placed = placed.withColumn("burst", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.groupBy("key", "burst").agg(F.max("ts").alias("updated_at"), F.count("*").alias("changes"))
