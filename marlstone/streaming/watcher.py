"""Folder watching as Structured Streaming.

New, changed and deleted files are found by a snapshot comparison in each
micro-batch.  A file source starts one only when a new path arrives, so the
stream is a source that ticks: one row, and so one comparison, a trigger.  The
state is a versioned table: a batch writes a new version and only then names it
current, so that a failed batch is repeated from the one before.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators import incremental
from marlstone.sources.tables import read_files

Update = Callable[[DataFrame, int], None]


STATE = "path string, hash string, size long, modified timestamp"
#: Changed files that are named one by one to the reader; beyond that the folder is read.
MOST_PATHS = 10_000


def file_state(spark: SparkSession, folder: str, pattern: str = "*", before: DataFrame | None = None) -> DataFrame:
    """path, hash, size, modified of the files of a folder.  A file of the size and time that it had ``before`` keeps its hash and is not read."""
    listing = read_files(spark, folder, (pattern,)).select("path", "size", "modified")
    if before is None:
        before = spark.createDataFrame([], STATE)
    same = listing.join(before.select("path", "hash", "size", "modified"), ["path", "size", "modified"])
    paths = [r.path for r in listing.join(before, ["path", "size", "modified"], "left_anti").select("path").limit(MOST_PATHS + 1).collect()]
    if not paths:
        return same.select("path", "hash", "size", "modified")
    if len(paths) <= MOST_PATHS:
        files = spark.read.format("binaryFile").load([quote(p) for p in paths]).select("path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    else:
        files = read_files(spark, folder, (pattern,)).join(same.select("path"), "path", "left_anti")
    return same.select("path", "hash", "size", "modified").unionByName(files.select("path", F.md5("content").alias("hash"), "size", "modified"))


def quote(path: str) -> str:
    """A path whose letters no glob takes for its own."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def watch(
    spark: SparkSession, folder: str, state: str, on_change: Update, pattern: str = "*", checkpoint: str | None = None, once: bool = False, interval: str = "30 seconds",
    quiet: float = 0.0, clock: Callable[[], float] = time.time,
) -> StreamingQuery:
    """Compare the folder with the stored state at every trigger; ``on_change`` gets (path, status) rows, if there are any.

    With ``quiet`` seconds, changes are told only when there has been none for as long: a burst is one update, of what
    differs from the files last told of, and nothing is lost.  Every batch is keyed by its id: the files of batch n are
    written to ``state/n``, when they last changed and which batch was told last to ``state/n-told``; a repeated batch starts from the same state and overwrites its own.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    none = spark.createDataFrame([], STATE)

    def compare(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{state}/{batch_id - 1}") if batch_id else none
        told = spark.read.parquet(f"{state}/{batch_id - 1}-told").first() if batch_id else None
        told_batch, changed_at = (told["batch"], told["changed_at"]) if told else (-1, 0.0)
        # The folder is listed once: a file that changes from here on differs from this state at the next trigger.
        file_state(spark, folder, pattern, before).write.mode("overwrite").parquet(f"{state}/{batch_id}")
        new = spark.read.parquet(f"{state}/{batch_id}")
        now = clock()
        if not incremental.snapshot_diff(before, new).filter("status <> 'unchanged'").isEmpty():
            changed_at = now
        if now - changed_at >= quiet:
            old = spark.read.parquet(f"{state}/{told_batch}") if told_batch >= 0 else none
            changes = incremental.snapshot_diff(old, new).filter("status <> 'unchanged'")
            if not changes.isEmpty():
                on_change(changes, batch_id)
            told_batch = batch_id
        spark.createDataFrame([(told_batch, changed_at)], "batch long, changed_at double").coalesce(1).write.mode("overwrite").parquet(f"{state}/{batch_id}-told")

    writer = ticks.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint or f"{state}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


class Watcher:
    """A folder's watch with its life: start, stop, a check on demand, status and file list."""

    def __init__(self, spark: SparkSession, folder: str, state: str, on_change: Update, **options) -> None:
        self.spark, self.state, self._arguments, self._options = spark, state.rstrip("/"), (folder, state, on_change), options
        self.query: StreamingQuery | None = None

    def start(self) -> None:
        """Watch on until ``stop``; a watch that runs already goes on."""
        if not (self.query and self.query.isActive):
            self.query = watch(self.spark, *self._arguments, **self._options)

    def stop(self) -> None:
        if self.query:
            self.query.stop()

    def check(self) -> None:
        """Compare once, now; only while it is stopped."""
        if self.query and self.query.isActive:
            raise RuntimeError("the watch is running")
        watch(self.spark, *self._arguments, once=True, **self._options).awaitTermination()

    def _batches(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.state)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix("-told")) for n in names if n.endswith("-told"))

    def status(self) -> dict:
        """running, checks (so far), files, waiting (changes not yet told)."""
        batches = self._batches()
        told = self.spark.read.parquet(f"{self.state}/{batches[-1]}-told").first() if batches else None
        return {"running": bool(self.query and self.query.isActive), "checks": len(batches), "files": self.files().count() if batches else 0, "waiting": bool(told and told["batch"] != batches[-1])}

    def files(self) -> DataFrame:
        """path, size, modified, short_hash at the last check, the latest first."""
        batches = self._batches()
        rows = self.spark.read.parquet(f"{self.state}/{batches[-1]}") if batches else self.spark.createDataFrame([], STATE)
        return rows.select("path", "size", "modified", F.substring("hash", 1, 8).alias("short_hash")).orderBy(F.desc("modified"), "path")


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Change events by window and kind, late ones within the watermark included."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("changes"))
