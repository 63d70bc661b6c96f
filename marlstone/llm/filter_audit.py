"""What filters do to each other, in every order, from one table of counts.

Each row fails or passes each of five filters.  Spark counts rows by part and
by the 32 combinations; a part's counts, reshaped to 2 x 2 x 2 x 2 x 2, are then
contracted along each axis with a vector that selects pass, fail or all.  So
what each step of each of the 120 orders keeps and removes follows from at most
32 numbers a part, without reading a document again.

Defined results: a null text is the empty text; a null source is the part '';
rows without an id never count as later copies, nor make others copies; rows
that repeat an id and a text are no copies of each other, as none has a smaller
id; labels of one id count if any of them is 1; extra columns are ignored; an
empty table gives no parts, hence an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, small

LETTERS = "ABCDE"
#: Filters that look at a text alone; E needs the whole table.
ALONE = LETTERS[:4]


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that one text decides."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 50,
        "B": 100 * distinct.cast("long") < 65 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


#: A text that holds more than one row in so many of the table is hot; so at most this many texts are.
HOT_SHARE = 4096


def _later_copies(rows: DataFrame) -> DataFrame:
    """Add ``copy``: a smaller id has the same text.

    Only digests held twice matter.  Those held by more than one row in
    HOT_SHARE are at most HOT_SHARE and are broadcast, so no group of copies,
    however large, is one task's; the others meet by digest.
    """
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    firsts = materialise(firsts)
    hot = rows.count() // HOT_SHARE
    often = F.broadcast(firsts.filter(F.col("n") > hot).select("digest", F.col("first").alias("hot_first")))
    seldom = small(firsts.filter(F.col("n") <= hot).select("digest", "first"))
    met = rows.join(often, "digest", "left")
    # a hot text's rows have found their group, and have no need to meet in the second join
    met = met.withColumn("digest", F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary")))))
    met = met.join(seldom, "digest", "left")
    return met.withColumn("copy", F.coalesce(F.col("doc_id") > F.coalesce("hot_first", "first"), F.lit(False))).drop("digest", "first", "hot_first")


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: fails LETTERS[i]), n, good, toxic: at most 32 rows a part.

    Texts stay beside the scan: what travels is a digest, an id and a mask.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = reduce(lambda a, b: a + b, [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures(text).values())])
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), mask.alias("mask"))
    rows = _later_copies(materialise(rows))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(small(materialise(known)), "doc_id", "left")
    mask = F.col("mask") + F.when(F.col("copy"), 1 << len(ALONE)).otherwise(0)
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in ("good", "toxic")]
    return rows.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), *sums)


PASS, FAIL, ALL = np.array([1, 0], np.int64), np.array([0, 1], np.int64), np.array([1, 1], np.int64)
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def contract(counts: np.ndarray, chosen: dict[str, np.ndarray]) -> np.ndarray:
    """Sums of counts[part, kind, a, b, c, d, e] where each axis is selected by its vector; axes not named count whole."""
    return np.einsum("pkabcde,a,b,c,d,e->pk", counts, *[chosen.get(letter, ALL) for letter in LETTERS])


def steps(counts: np.ndarray) -> Iterator[dict]:
    """A column set per step of each order, over all parts at once; counts: parts x (all, good, toxic) x 2 x 2 x 2 x 2 x 2.

    What a step removes depends on the set of filters before it only, so
    5 x 16 contractions serve all 600 steps.
    """
    removed, kept = {}, {}
    for letter in LETTERS:
        for before in range(32):
            names = [x for i, x in enumerate(LETTERS) if before >> i & 1]
            if letter not in names:
                removed[letter, frozenset(names)] = contract(counts, {x: PASS for x in names} | {letter: FAIL})
    for before in range(1, 32):
        names = frozenset(x for i, x in enumerate(LETTERS) if before >> i & 1)
        kept[names] = contract(counts, {x: PASS for x in names})[:, 0]
    failing = {x: contract(counts, {x: FAIL})[:, 0] for x in LETTERS}
    alone = {x: contract(counts, {y: FAIL if y == x else PASS for y in LETTERS})[:, 0] for x in LETTERS}
    orders = list(permutations(LETTERS))
    shapley = {x: sum(removed[x, frozenset(o[: o.index(x)])][:, 0] for o in orders) for x in LETTERS}
    for order in orders:
        for i, letter in enumerate(order):
            gone = removed[letter, frozenset(order[:i])]
            yield {
                "filter_order": "".join(order), "step": i + 1, "kept": kept[frozenset(order[: i + 1])], "removed": gone[:, 0], "redundant": failing[letter] - gone[:, 0],
                "unique_fails": alone[letter], "good_lost": gone[:, 1], "toxic_lost": gone[:, 2], "shapley": shapley[letter],
            }


#: Parts whose 600 rows each are made at a time.
PARTS = 64


def _audited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), PARTS):
            some = batch.iloc[at : at + PARTS]
            counts = np.zeros((len(some), 3, 32), np.int64)
            for i, combinations in enumerate(some["combinations"]):
                for c in combinations:
                    counts[i, :, c["mask"]] = c["n"], c["good"], c["toxic"]
            # bit i of a mask is letter i, so reshaped axes run from E to A
            tensor = counts.reshape(len(some), 3, 2, 2, 2, 2, 2).transpose(0, 1, 6, 5, 4, 3, 2)
            yield pd.concat([pd.DataFrame({"part": some["part"].to_numpy()} | step) for step in steps(tensor)])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see AUDIT for the columns."""
    combinations = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("combinations")  # 32 at most
    return failure_counts(docs, labels).groupBy("part").agg(combinations).mapInPandas(_audited, AUDIT)
