"""Operator 5: toxicity by a factorization machine over hashed terms.

Method: the terms of a text are its letter runs, lower-cased, and their
beginnings of four to six bytes, hashed into 2^18 columns and taken as present
or absent.  score = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>): the factors
v let a pair of terms (an insult beside the mention of a group) weigh more, or
less, than the two alone.  The machine is fitted with AdaGrad on a bounded
sample of labelled rows (``SAMPLE_ROWS``, the lowest id hashes).  A column that a likelihood-ratio test
finds unrelated to the label carries no weight w; it keeps its factors if it is
related to the label among the texts that hold a term which speaks for it, for
a mention may say nothing alone and everything beside an insult.  w is kept
non-negative with an L1 pull, so that a long text's neutral words cannot
outvote what is toxic in it.  Scoring covers every whole text.

Contract: one row per input row; empty and null texts are scored by the bias
alone.  A document without an id is not held out and not learned from.  Labels, language, source and id are never inputs of a score.  A row
labelled twice counts with its highest label; null labels and labels naming no
document are ignored; without any label every score is that of ``NO_LABELS``.
Repeated rows give repeated results; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import spans as S
from marlstone.llm.common import crc_mod

BITS = 18
FACTORS = 8
#: Most labelled rows that the fit reads.
SAMPLE_ROWS = 12_000
EPOCHS = 12
#: Least likelihood ratio of a column, and samples that hold it.
LEAST_G2, LEAST_SEEN = 12.0, 3
L1 = 2e-4
#: Spread of the factors at first, their learning rate, and their pull to zero.
FACTOR_START, FACTOR_STEP, FACTOR_DECAY = 0.07, 0.05, 1e-4
THRESHOLD = 0.3
NO_LABELS = -3.0
HELD_OUT = (4, 2)


@dataclass(frozen=True)
class Machine:
    """bias, w[columns], v[columns, factors]: about 9 MB whatever the corpus."""

    bias: float
    w: np.ndarray
    v: np.ndarray


def _terms(piece: S.Slice, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text index and column of every distinct term, ascending; of active columns if those are given."""
    low = S.lowered(piece)
    kind, _ = S.byte_classes(low.data)
    inside = kind == S.LETTER
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = low.starts_flag()
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    docs = low.doc_of(starts)
    keys = []
    for salt, size in ((1, None), (2, 4), (3, 5), (4, 6)):
        stop = ends if size is None else np.minimum(starts + size, ends)
        column = (S.mix(low.hashes(starts, stop) + S.U64(salt)) >> S.U64(64 - BITS)).astype(np.int64)
        if active is None:
            keys.append(docs << BITS | column)
        else:
            some = active[column]
            keys.append(docs[some] << BITS | column[some])
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def term_columns(text: Column) -> Column:
    """The sorted distinct hashed terms of each whole text."""

    def run(texts: pa.Array) -> pa.Array:
        lists = []
        for piece in S.slices(texts):
            docs, columns = _terms(piece)
            offsets = np.searchsorted(docs, np.arange(piece.n + 1)).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(columns.astype(np.int32))))
        return pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(text.cast("string"))


def _raw(machine: Machine, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """The machine's sum for rows of (row, column) pairs in row order."""
    out = np.full(n, machine.bias)
    if not len(rows):
        return out
    heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    vectors = machine.v[columns]
    linear = np.add.reduceat(machine.w[columns], heads)
    sums = np.add.reduceat(vectors, heads, axis=0)
    squares = np.add.reduceat(np.einsum("ij,ij->i", vectors, vectors), heads)
    out[rows[heads]] += linear + 0.5 * ((sums**2).sum(axis=1) - squares)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _g2(samples: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column, the likelihood ratio of the 2 x 2 table of its presence and the label, signed by its direction; samples that hold it."""
    size, n, p = 1 << BITS, len(labels), labels.sum()
    seen, hits = np.zeros(size), np.zeros(size)
    for at in range(0, n, 500):  # some samples at a time, to keep the driver small
        flat = np.concatenate(samples[at : at + 500])
        seen += np.bincount(flat, minlength=size)
        hits += np.bincount(flat, np.repeat(labels[at : at + 500], [len(s) for s in samples[at : at + 500]]), minlength=size)
    g2 = np.zeros(size)
    for observed, expected in ((hits, seen * p / max(n, 1)), (seen - hits, seen * (n - p) / max(n, 1)), (p - hits, (n - seen) * p / max(n, 1)), (n - seen - p + hits, (n - seen) * (n - p) / max(n, 1))):
        g2 += np.where(observed > 0, 2 * observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12)), 0)
    return np.where(hits * n >= seen * p, g2, -g2), seen


def related(samples: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which columns go with the label alone, and which do so beside one that speaks for it."""
    g2, seen = _g2(samples, labels)
    alone = (np.abs(g2) >= LEAST_G2) & (seen >= LEAST_SEEN)
    speaking = (g2 >= LEAST_G2) & alone
    beside = np.array([bool(speaking[s].any()) for s in samples])
    g2, seen = _g2([s for s, some in zip(samples, beside, strict=True) if some], labels[beside])
    return alone, (np.abs(g2) >= LEAST_G2) & (seen >= LEAST_SEEN)


def fit(samples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """AdaGrad over shuffled batches of 64 samples (each the columns of one text)."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    full = Machine(NO_LABELS, np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    if not len(labels):
        return full
    alone, beside = related(samples, labels)
    active = np.flatnonzero(alone | beside)
    place = np.full(size, -1, np.int32)
    place[active] = np.arange(len(active))
    samples = [place[s][place[s] >= 0] for s in samples]
    w, v, alone = np.zeros(len(active)), rng.normal(0, FACTOR_START, (len(active), FACTORS)), alone[active]
    bias, gb = NO_LABELS, 1e-6
    gw, gv = np.full(len(active), 1e-6), np.full((len(active), FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            sizes = np.array([len(samples[i]) for i in batch])
            columns = np.concatenate([samples[i] for i in batch]).astype(np.int64)
            rows = np.repeat(np.arange(len(batch)), sizes)
            error = (_sigmoid(_raw(Machine(bias, w, v), rows, columns, len(batch))) - labels[batch]) / len(batch)
            used, back = np.unique(columns, return_inverse=True)
            vectors = v[columns]
            sums = np.stack([np.bincount(rows, vectors[:, f], minlength=len(batch)) for f in range(FACTORS)], axis=1)
            e = error[rows]
            step_w = np.bincount(back, e, minlength=len(used)) + L1
            pull = e[:, None] * (sums[rows] - vectors)
            step_v = np.stack([np.bincount(back, pull[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1) + FACTOR_DECAY * v[used]
            gw[used] += step_w**2
            gv[used] += step_v**2
            gb += error.sum() ** 2
            w[used] = np.where(alone[used], np.maximum(w[used] - 0.3 * step_w / np.sqrt(gw[used]), 0), 0)
            v[used] -= FACTOR_STEP * step_v / np.sqrt(gv[used])
            bias -= float(0.1 * error.sum() / np.sqrt(gb))
    full.w[active], full.v[active] = w, v
    return Machine(bias, full.w, full.v)


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = HELD_OUT, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> Machine:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), held_out[0]) != held_out[1]))
    marked = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # bounded by the parameter
    # The bounded sample is the only broadcast side; terms are hashed beside the scan, before any shuffle.
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", term_columns(F.col("text")).alias("terms"))
    found = rows.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    lists = found.column("terms").combine_chunks()
    if not found.num_rows:
        return fit([], np.zeros(0))
    flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    return fit([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], found.column("toxic").to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, text: str = "text") -> Column:
    """The probability of label 1 of each whole text."""
    used = np.flatnonzero((machine.w != 0) | (machine.v != 0).any(axis=1))  # most columns carry nothing
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    # Fixed size, see Machine.
    shipped = docs.sparkSession.sparkContext.broadcast((place, Machine(machine.bias, machine.w[used], machine.v[used])))

    def run(texts: pa.Array) -> pa.Array:
        place, machine = shipped.value
        parts = [np.zeros(0)]
        for piece in S.slices(texts):
            rows, columns = _terms(piece, place >= 0)
            parts.append(_sigmoid(_raw(machine, rows, place[columns], piece.n)))
        return pa.array(np.concatenate(parts))

    return F.arrow_udf(run, T.DoubleType())(docs[text].cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    machine = train(docs, labels, held_out)
    out = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), held_out[0]) == held_out[1], F.lit(False)).alias("held_out"), score(docs, machine).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted clean, with the columns they came with."""
    machine = train(docs, labels)
    scored = docs.select(F.struct("*").alias("__row"), score(docs, machine).alias("__score"))
    return scored.filter(F.col("__score") < threshold).select("__row.*")
