"""Words that differ by one edit from a more frequent word.

Words are counted in the JVM.  Two words one edit apart share their first or
their last half, whichever the edit leaves alone; halves are hashed into
blocks of about BLOCK rows.  Within a block, words of adjacent lengths meet as
matrices of letter counts: a NumPy product gives all squared distances at
once, pairs at distance at most two are kept (an inserted letter is one, a
replaced letter two), and an exact comparison of the letters decides.

A block holds many halves, and a half that overflows its block is cut into
tiles, each pair of which is a group of its own, so no group grows with the
data.  Letters are folded into LETTERS counts; folding can only shorten a
distance, so no pair is lost.

Defined results: null and empty texts have no words; a null id counts as the
empty string in the hash; rows that repeat are counted each; words of any length
are compared whole; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise, small

#: Fixed values of the contract: shortest word, fewest occurrences, one run of a document in so many loses a letter.
SHORTEST, FEWEST, DAMAGED = 5, 3, 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, fewest: int = FEWEST) -> DataFrame:
    """word, n: what the runs of letters of the documents become, and how often.

    A run shorter than SHORTEST can't become a word, so the pattern skips it.
    """
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    digest = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(digest, F.length("run").cast("long")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(digest % DAMAGED == 0, damaged).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter((F.length("word") >= SHORTEST) & (F.col("n") >= fewest))


#: Rows of a block on average, and of a tile at most, about.
BLOCK, TILE = 4096, 8192
#: Rows of a matrix product's left side.
STRIP = 512
#: Counts of a letter vector.
LETTERS = 32


def _placed(vocabulary: DataFrame, blocks: int) -> DataFrame:
    """word, n, least (the shorter length of a pair it may form), side, half, block: four rows a word.

    In the class of least length L, a word of length L or L + 1 is cut after
    L // 2 letters (side 0: what is before), or before its last L - L // 2 (side 1: what is there).
    """
    length = F.length("word")
    classes = vocabulary.withColumn("least", F.explode(F.array(length, length - 1))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    head = F.floor(F.col("least") / 2).cast("int")
    tail = F.col("least") - head
    half = F.when(F.col("side") == 0, F.substring("word", F.lit(1), head)).otherwise(F.substring("word", F.length("word") - tail + 1, tail))
    return classes.select("word", "n", "least", "side", F.xxhash64("least", "side", half).alias("half")).withColumn("block", F.pmod("half", F.lit(blocks)))


def _vectors(letters: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    counts = np.bincount(rows * LETTERS + letters % LETTERS, minlength=n * LETTERS)
    return counts.reshape(n, LETTERS).astype(np.float32)


def candidates(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of letter vectors at squared distance at most two; the products are exact, as counts are whole numbers below 2^24."""
    squared = (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2 * (left @ right.T)
    return np.nonzero(squared <= 2)


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _compared(words_: list[str], rows: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """Places of near words among rows of one class and side."""
    lengths = np.fromiter(map(len, words_), np.int64, len(words_))
    letters = np.frombuffer("".join(words_).encode("utf-32-le"), np.uint32).astype(np.int64)
    vectors = _vectors(letters, np.repeat(np.arange(len(words_)), lengths), len(words_))
    least, side = int(rows["least"].iloc[0]), int(rows["side"].iloc[0])
    half, tile = rows["half"].to_numpy(), rows["tile"].to_numpy()
    both = rows["first"].iloc[0] != rows["second"].iloc[0]
    short = np.nonzero(lengths == least)[0]
    for at in range(0, len(short), STRIP):
        some = short[at : at + STRIP]
        i, j = candidates(vectors[some], vectors)
        i = some[i]
        # equal lengths meet from both sides, so keep one; two tiles of a pair meet across only, as each meets itself elsewhere
        keep = (half[i] == half[j]) & ((lengths[j] > least) | (i < j))
        if both:
            keep &= tile[i] != tile[j]
        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            a, b = words_[x], words_[y]
            # a pair that shares its first half too is found there
            if one_edit(a, b) and not (side == 1 and a[: least // 2] == b[: least // 2]):
                yield x, y


PAIRS = "word string, other string, n_other long"


def _near(rows: pd.DataFrame) -> pd.DataFrame:
    found: list[tuple[str, str, int]] = []
    for _, some in rows.groupby(["least", "side"], sort=False):
        words_, n = some["word"].tolist(), some["n"].tolist()
        for x, y in _compared(words_, some):
            found += [(words_[x], words_[y], n[y]), (words_[y], words_[x], n[x])]
    return pd.DataFrame(found, columns=["word", "other", "n_other"])


def near_words(vocabulary: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """word, other, n_other: each pair of words one edit apart, both ways, once.

    ``vocabulary`` has a row per word and is read twice, so it should be a written table.
    """
    blocks = max(1, -(-4 * vocabulary.count() // block))
    placed = _placed(vocabulary, blocks)
    crowded = placed.groupBy("block").agg(F.count("*").alias("held")).filter(F.col("held") > 2 * tile)
    crowded = materialise(crowded.select("block", F.ceil(F.col("held") / tile).cast("int").alias("tiles")))
    rows = placed.join(small(crowded), "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("word", "n", "least", "side", "half", "block", "tile", F.least("tile", "with").alias("first"), F.greatest("tile", "with").alias("second"))
    return rows.groupBy("block", "first", "second").applyInPandas(_near, PAIRS)


def follow(pointers: DataFrame, most_rounds: int = 12) -> DataFrame:
    """word, root: where the pointers (word, root) lead in the end; they must have no cycle.

    Each round doubles the steps taken.  A form is at least twice as frequent as
    its word, so a path has fewer than 64 steps, which seven rounds cover.
    """
    current = materialise(pointers.select("word", "root"))
    for _ in range(most_rounds):
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(current.join(small(ahead), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        current = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return current
    raise RuntimeError(f"pointers do not end after {most_rounds} rounds")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    vocabulary = materialise(words(docs))
    best = F.min(F.struct(-F.col("n_other"), F.col("other").alias("other")))
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, "word", "left")
    form_n = -F.col("best.col1")
    strong = form_n >= 2 * F.col("n")
    judged = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, form_n).alias("form_n")))
    roots = follow(judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    out = judged.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
