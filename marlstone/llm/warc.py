"""Operator 9: Merkle fixity audit of WARC replicas, with DataFrame functions only.

Method: every record is hashed; records in key order are the leaves of a tree.
A leaf's mark hashes the record's digest and its offset range in the archive
file; an inner node's mark those of up to sixteen children (neighbouring
records) and the range that they span, from the first offset to the last end.  Two replicas are compared at the root;
below a mismatch only the children of mismatching nodes are read, down to the
records that differ.  A record whose bytes are the same but whose offset is not
has moved; offsets start anew in each file, so a loss moves no other file.

Contract: a record's key is its page id; rows that share one are one leaf of
all their contents.  Rows without an id are not part of an archive.  Null urls
and contents are empty.  An empty replica has no root: every record of the
other one is missing or extra.  Extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialise

FAN_OUT_BITS = 4
FILE_RECORDS = 1000


def record_bytes(page_id: Column, url: Column, content: Column) -> Column:
    """A WARC/1.0 response record as binary."""
    body = F.encode(F.coalesce(content, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def records(pages: DataFrame) -> DataFrame:
    """key, file, length and hash of the record of every page."""
    whole = pages.filter(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("key"), record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return whole.select("key", F.floor(F.col("key") / FILE_RECORDS).alias("file"), F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))


def offsets(leaves: DataFrame) -> DataFrame:
    """Leaves with their offset in the archive file they belong to (a bounded range of keys)."""
    before = Window.partitionBy("file").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


class Tree:
    """levels[0]: leaves (node, hash, length, file, offset, mark); levels[i]: nodes whose marks hash those below."""

    def __init__(self, pages: DataFrame) -> None:
        # Repeated contents of a key are counted before they are gathered.
        distinct = records(pages).groupBy("key", "file", "hash").agg(F.count("*").alias("times"), F.sum("length").alias("length"))
        content = F.transform(F.array_sort(F.collect_list(F.struct("hash", "times"))), lambda x: F.concat(x["hash"], F.lit("x"), x["times"].cast("string")))
        leaves = distinct.groupBy("key", "file").agg(F.sha2(F.array_join(content, ","), 256).alias("hash"), F.sum("length").alias("length"))
        end = (F.col("offset") + F.col("length")).alias("end")
        mark = F.sha2(F.concat_ws(":", "hash", F.col("file").cast("string"), F.col("offset").cast("string"), end.cast("string")), 256)
        ranges = F.struct("file", "offset").alias("first"), F.struct("file", end).alias("last")
        level = materialise(offsets(leaves).select(F.col("key").alias("node"), "hash", "length", "file", "offset", mark.alias("mark"), *ranges))
        self.levels = [level]
        edges = level.agg(F.min("node").alias("low"), F.max("node").alias("high")).first()
        low, high = edges.low or 0, edges.high or 0
        while low != high and (low, high) != (-1, 0):
            children = F.transform(F.array_sort(F.collect_list(F.struct("node", "mark"))), lambda x: F.concat_ws(":", x["node"].cast("string"), x["mark"]))
            parent = F.shiftright("node", FAN_OUT_BITS)
            spans = level.groupBy(parent.alias("node")).agg(F.array_join(children, ",").alias("below"), F.min("first").alias("first"), F.max("last").alias("last"))
            span = [F.col(c).cast("string") for c in ("first.file", "first.offset", "last.file", "last.end")]
            level = materialise(spans.select("node", F.sha2(F.concat_ws("|", "below", *span), 256).alias("mark"), "first", "last"))
            self.levels.append(level)
            low, high = low >> FAN_OUT_BITS, high >> FAN_OUT_BITS


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, status (corrupt, missing, extra, moved), file, offset, length and found_offset of every record that differs.

    file, offset and length are the original's, null for an extra record;
    found_offset is the replica's, null for a missing one.  A corrupt record may have moved too.
    """
    a, b = Tree(original), Tree(replica)
    top = max(len(a.levels), len(b.levels)) - 1
    suspects: DataFrame | None = None
    for depth in range(top, -1, -1):
        sides = []
        for tree, name in ((a, "a"), (b, "b")):
            side = tree.levels[depth] if depth < len(tree.levels) else tree.levels[0].limit(0)
            side = side.select("node", *[F.col(c).alias(f"{c}_{name}") for c in (["mark"] if depth else _LEAF)])
            if suspects is not None:
                side = side.withColumn("parent", F.shiftright("node", FAN_OUT_BITS)).join(suspects.withColumnRenamed("node", "parent"), "parent", "left_semi").drop("parent")
            sides.append(side)
        both = sides[0].join(sides[1], "node", "full_outer")
        differing = both.filter(~F.col("mark_a").eqNullSafe(F.col("mark_b")))
        if depth:
            # A tree that is lower than the other has no node here: all of this level is suspect.
            whole = depth >= min(len(a.levels), len(b.levels))
            suspects = materialise((both if whole else differing).select("node"))
            if suspects.isEmpty():
                none = [tree.levels[0].limit(0).select("node", *[F.col(c).alias(f"{c}_{name}") for c in _LEAF]) for tree, name in ((a, "a"), (b, "b"))]
                return _located(none[0].join(none[1], "node"))
        else:
            return _located(differing)
    raise AssertionError("a tree has a level")


_LEAF = ("mark", "hash", "file", "offset", "length")


def _located(differing: DataFrame) -> DataFrame:
    same = F.col("hash_a") == F.col("hash_b")
    status = F.when(F.col("mark_b").isNull(), "missing").when(F.col("mark_a").isNull(), "extra").when(same, "moved").otherwise("corrupt")
    return differing.select(
        F.col("node").alias("page_id"), status.alias("status"), F.col("file_a").alias("file"), F.col("offset_a").alias("offset"), F.col("length_a").alias("length"), F.col("offset_b").alias("found_offset")
    )
