"""Operator 1: quality rules with risk-controlled thresholds.

Method: every rule compares one measured rate with a cutoff.  The labelled good
documents of each stratum that pass the base rules are dealt to two holdouts by
id hash, one to three.  The smaller only shapes the path: its maxima, with some slack, and then its
upper quantiles are settings of all cutoffs at once, from the loosest to the
strictest.  On the larger, for each setting in that order, the exact
(Clopper-Pearson) upper bound on the probability that any rule rejects a good
document must stay within the allowed risk.  So ``risk`` limits what ``kept``
does as a whole, beyond the base rules, which are fixed.  The order does not
depend on the second holdout and testing stops at the first failure, which
needs no correction; the error budget is split evenly over the strata
(Bonferroni).  A stratum with too few labels passes no setting and rejects
nothing beyond the base rules.

Contract: one row per input row.  A null text counts as empty: all features 0,
base_failed true.  A null language is a stratum of its own, apart from the
empty one.  Repeated rows give repeated results; documents without labels, an id
or a quality are judged, never learned from; a document labelled twice is good
if all its labels say so and counts once; labels naming no document are
ignored.  Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import spans as S
from marlstone.llm.common import materialise, small

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Counts measured on every text; the first five are the contract's.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_repeat_next", "n_marked")


@dataclass(frozen=True)
class Rule:
    """Rejects where ``rate`` (one count over another) lies above a cutoff."""

    name: str
    rate: str


#: Production rules.
RULES = (
    Rule("symbols", "n_symbols / n_words"),
    Rule("duplicate_lines", "n_dup_lines / n_lines"),
    Rule("upper_case", "n_upper / n_letters"),
    Rule("stuttered_words", "n_repeat_next / n_words"),
    Rule("marked_words", "n_marked / n_words"),
    Rule("long_words", "word_chars / n_words"),
)

#: False rejection of good documents allowed in each stratum, and the error probability of all of it.
RISK = 0.02
ERROR = 0.05
#: One in so many labelled good documents shapes the path; the others certify it.
SHAPING = 4
#: The path of settings: multiples of the greatest rate of the first holdout, then the shares of it beyond the cutoff.
SLACKS = (8.0, 4.0, 2.0, 1.5, 1.25, 1.1)
TAILS = (0.0, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03, 0.05, 0.1)


def _measure(piece: S.Slice) -> np.ndarray:
    """COUNTS of each text of the slice."""
    data, n = piece.data, piece.n
    out = np.zeros((len(COUNTS), n), np.int64)
    if not len(data):
        return out
    starts, ends = S.words(piece)
    docs = piece.doc_of(starts)
    hashes = piece.hashes(starts, ends)
    lead = (data & 0xC0) != 0x80
    word_count = piece.counts(starts)
    out[0] = word_count
    out[1] = piece.sums(lead & ~S._ASCII_SPACE[data])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    out[2] = piece.sums(symbol[data])
    upper, letter = np.zeros(256, bool), np.zeros(256, bool)
    upper[65:91] = letter[65:91] = letter[97:123] = True
    out[6], out[7] = piece.sums(upper[data]), piece.sums(letter[data])
    if len(starts) > 1:
        same = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
        out[8] = np.bincount(docs[1:][same], minlength=n)
    tail = np.zeros(256, bool)
    tail[list(b"#*$%&|<>!")] = True
    if len(starts):
        marked = tail[data[ends - 1]] & (tail[data[np.maximum(ends - 2, starts)]])
        out[9] = np.bincount(docs[marked], minlength=n)
    # Lines: spans between line feeds, each text's last one included.
    line_starts = np.unique(np.concatenate([piece.offsets[:-1], np.flatnonzero(data == 10) + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_ends = line_ends - (data[line_ends - 1] == 10)
    first_word = np.searchsorted(starts, line_starts)
    has_word = np.append(starts, len(data))[first_word] < line_ends
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_docs = piece.doc_of(line_starts)
    out[5] = np.bincount(line_docs, minlength=n)
    keys = S.mix(piece.hashes(line_starts, line_ends) ^ (line_docs.astype(S.U64) * S.U64(0x9E3779B97F4A7C15)))
    _, firsts = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[firsts] = False
    out[3] = np.bincount(line_docs[later], minlength=n)
    # Words covered by windows that occur twice or more in their text.
    runs, at = S.windows(hashes, docs, WINDOW)
    if len(runs):
        keys = S.mix(runs ^ (docs[at].astype(S.U64) * S.U64(0x9E3779B97F4A7C15)))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hit = at[twice[place] == keys]
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + WINDOW, -1)
            covered = np.cumsum(cover[:-1]) > 0
            out[4] = np.bincount(docs[covered], minlength=n)
    return out


def measure(text: Column) -> Column:
    """A struct of the counts of each whole text, by an Arrow UDF: only the texts go to Python."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [_measure(piece) for piece in S.slices(texts)]
        counts = np.concatenate(parts, axis=1) if parts else np.zeros((len(COUNTS), 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(c) for c in counts], names=list(COUNTS))

    return F.arrow_udf(run, T.StructType([T.StructField(n, T.LongType()) for n in COUNTS]))(text.cast("string"))


def upper_bound(rejected: int, n: int, error: float) -> float:
    """Exact binomial upper bound: the largest p at which ``rejected`` or fewer of n has probability >= error."""
    if n == 0 or rejected >= n:
        return 1.0

    def below(p: float) -> float:
        terms = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p) for k in range(rejected + 1)]
        top = max(terms)
        return top + log(sum(np.exp(np.array(terms) - top)))

    low, high = rejected / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if p <= 0 or below(p) > log(error) else (low, p)
    return high


def rate_columns(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """The rate of each rule, to three places; a rate over nothing is 0."""
    out = {}
    for rule in rules:
        over, under = rule.rate.split(" / ")
        out[f"rate_{rule.name}"] = F.round(F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0)), 3)
    return out


def settings(shaping: DataFrame, rules: tuple[Rule, ...] = RULES, stratum: str = "lang") -> DataFrame:
    """stratum and per rule path_<rule>: its cutoff at each step.  The exact quantiles are over rates of three places."""
    paths = []
    for rule in rules:
        rate = F.col(f"rate_{rule.name}")
        slack = F.array(*[F.max(rate) * k for k in SLACKS])
        paths.append(F.concat(slack, F.percentile(rate, F.array(*[F.lit(1 - t) for t in TAILS]))).alias(f"path_{rule.name}"))
    return shaping.groupBy(F.col(stratum).alias("stratum")).agg(*paths)


def select_cutoffs(shaping: DataFrame, holdout: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR, stratum: str = "lang") -> DataFrame:
    """stratum, n, step and per rule cut_<rule>: the strictest certified setting; null where there is none.

    Both frames hold the rates of good documents.  Rejections are counted by the
    first step that rejects (a row per stratum and step); the bounds are then
    computed beside the data, a row per stratum at a time.
    """
    steps = len(SLACKS) + len(TAILS)
    paths = settings(shaping, rules, stratum)
    paths = materialise(paths)
    met = holdout.withColumnRenamed(stratum, "__stratum").join(small(paths), F.col("__stratum").eqNullSafe(F.col("stratum")))
    # Settings only get stricter, so the first one that rejects a document tells all that do (0: none).
    broken = lambda i: F.array_max(F.array(*[F.col(f"rate_{r.name}") > F.get(f"path_{r.name}", i) for r in rules]))
    first = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), broken), True)
    some = [F.any_value(f"path_{r.name}").alias(f"path_{r.name}") for r in rules]
    tally = met.groupBy("stratum", first.alias("first")).agg(F.count("*").alias("k"), *some)
    table = tally.groupBy("stratum").agg(F.sum("k").alias("n"), F.collect_list("first").alias("first"), F.collect_list("k").alias("k"), *some)
    # The error is split over all strata that have a path, tested or not.
    strata = paths.agg(F.count("*").alias("strata"))
    schema = T.StructType([T.StructField("stratum", holdout.schema[stratum].dataType), T.StructField("n", T.LongType()), T.StructField("step", T.IntegerType()), *[T.StructField(f"cut_{r.name}", T.DoubleType()) for r in rules]])

    def certify(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                certified = None
                rejected = np.cumsum(np.bincount(row["first"], row["k"], minlength=steps + 1)[1:])
                for i in range(steps):
                    if upper_bound(int(rejected[i]), int(row["n"]), error / row["strata"]) > risk:
                        break
                    certified = i
                rows.append((row["stratum"], row["n"], certified, *[None if certified is None else float(row[f"path_{r.name}"][certified]) for r in rules]))
            yield pd.DataFrame(rows, columns=schema.names).astype({"step": "Int32"})

    # The right side is one row: the number of strata.
    return table.join(F.broadcast(strata)).mapInPandas(certify, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, lang and the counts, written to the shared folder as a narrow table."""
    return materialise(docs.select("doc_id", "lang", measure(docs[text]).alias("m")).select("doc_id", "lang", "m.*"))


def holdouts(measured: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """The rates of the labelled good documents that pass the base rules, dealt to the two holdouts."""
    # A document counts once however often its label or its row is repeated.
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    rates = measured.filter(~base_failed()).withColumns(rate_columns(rules))
    rates = rates.join(good, "doc_id", "left_semi").select("doc_id", F.struct("lang", *rate_columns(rules)).alias("r"))
    # Of several texts under one id the least in this order counts, in every run the same.
    rates = rates.groupBy("doc_id").agg(F.min("r").alias("r")).select("doc_id", "r.*")
    side = F.pmod(F.xxhash64("doc_id"), F.lit(SHAPING))
    return rates.filter(side == 0), rates.filter(side != 0)


def _cutoffs(measured: DataFrame, labels: DataFrame, rules: tuple[Rule, ...], risk: float, error: float) -> DataFrame:
    chosen = select_cutoffs(*holdouts(measured, labels, rules), rules, risk, error)
    return materialise(chosen.select(F.col("stratum").alias("__lang"), *[f"cut_{r.name}" for r in rules]))


def _failed(rules: tuple[Rule, ...]) -> Column:
    broken = F.array(*[F.when(F.col(f"rate_{r.name}") > F.col(f"cut_{r.name}"), r.name) for r in rules])
    return F.filter(broken, lambda x: x.isNotNull())


def judge(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR, text: str = "text") -> DataFrame:
    """doc_id, lang, the counts, base_failed, failed_rules and kept for every document."""
    measured = _measured(docs, text)
    cutoffs = small(_cutoffs(measured, labels, rules, risk, error))  # a row per language
    rated = measured.withColumns(rate_columns(rules)).join(cutoffs, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    out = rated.select("doc_id", "lang", *COUNTS, base_failed().alias("base_failed"), _failed(rules).alias("failed_rules"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    Texts are measured twice and never shuffled: once for the thresholds, once
    beside the row that is kept or dropped.
    """
    cutoffs = small(_cutoffs(_measured(docs, "text"), labels, rules, risk, error))  # a row per language
    rows = docs.select(F.struct("*").alias("__row"), F.col("lang").alias("__own"), measure(docs["text"]).alias("__m"))
    rated = rows.select("__row", "__own", "__m.*").withColumns(rate_columns(rules)).join(cutoffs, F.col("__own").eqNullSafe(F.col("__lang")), "left")
    return rated.filter(~base_failed() & (F.size(_failed(rules)) == 0)).select("__row.*")
