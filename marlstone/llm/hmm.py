"""Operator 10: a hidden Markov language model.

Method: words fall into 2^15 classes by hash (the end of a text is a class of
its own).  Hidden states follow one another and emit classes; a class emits its
words by their corpus counts:

    log P(text) = log P_HMM(classes) + sum over words of log P(word | class)
    P(word | class) = (c + 0.5) / (N_class + 0.5 (V_class + 1))

The last slot of a class is for words never seen, so the whole is a proper
distribution.  Baum-Welch expectations are computed per partition from all
training texts, summed by the shuffle, and the maximisation runs on sums whose
size does not depend on the corpus.  Both training and scoring run the scaled
recursions over each whole text; where a batch of texts is too long to keep all
forward shares, those at some steps are kept and the rest are computed again.
The classes of the training texts are written once, two bytes a token, and read
by every iteration.  Word counts stay a distributed table: the ``HOT_WORDS`` most frequent
words travel to the tasks, all other words meet their counts in a join.

Contract: one row per input row.  Null and empty texts are the end token alone.
Ids only decide the fold; a document without an id is neither trained on nor held out.
Repeated rows count and are scored each; extra columns do not matter; with no
training text every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import spans as S
from marlstone.llm.common import crc_mod, materialise

CLASS_BITS = 15
CLASSES = 1 << CLASS_BITS  # the end token is class CLASSES
STATES = 8
ITERATIONS = 4
HOT_WORDS = 1 << 17
#: Weight, in tokens, of the corpus-wide class shares in each state's emissions, and of even transitions.
PRIOR_TOKENS, PRIOR_STEPS = 200.0, 5.0
HELD_OUT = (5, 1)
#: Bytes of text whose sequences advance together in scoring, and tokens of those in training.
BATCH_BYTES, BATCH_TOKENS = 4 << 20, 1 << 20
#: Tokens whose forward shares are kept at once.
KEPT_TOKENS = 1 << 20


@dataclass(frozen=True)
class Model:
    """start: state shares at the first token; step[i, j]; emit[class, state]."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


@dataclass(frozen=True)
class Tokens:
    """Texts as words: hash, class, and the number of words of each text."""

    hashes: np.ndarray
    classes: np.ndarray
    counts: np.ndarray


def _classes(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> S.U64(64 - CLASS_BITS)).astype(np.int32)


def tokens(texts: pa.Array) -> Iterator[tuple[int, Tokens]]:
    """Batches of texts as (first row, tokens)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    first = rows = size = 0
    for piece in S.slices(texts):
        low = S.lowered(piece)
        starts, ends = S.words(low)
        held.append((low.hashes(starts, ends), low.counts(starts)))
        rows += piece.n
        size += len(piece.data)
        if size >= BATCH_BYTES:
            hashes = np.concatenate([h for h, _ in held])
            yield first, Tokens(hashes, _classes(hashes), np.concatenate([c for _, c in held]))
            first, size, held = first + rows, 0, []
            rows = 0
    if held:
        hashes = np.concatenate([h for h, _ in held])
        yield first, Tokens(hashes, _classes(hashes), np.concatenate([c for _, c in held]))


def _with_ends(classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes with each text's end, and the lengths of the sequences."""
    return np.insert(classes, np.cumsum(counts), CLASSES), counts + 1


def _by_step(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes ordered by step, longest sequence first; sequences alive at each step; their order."""
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), side="right")
    offset = np.cumsum(alive) - alive
    step = np.arange(len(classes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.empty(len(classes), classes.dtype)
    out[offset[step] + np.repeat(rank, lengths)] = classes
    return out, alive, order


def log_likelihood(model: Model, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each text's classes, by the scaled forward recursion."""
    sequence, lengths = _with_ends(classes, counts)
    ordered, alive, order = _by_step(sequence, lengths)
    scales = np.empty(len(ordered))
    at = 0
    alpha = np.repeat(model.start[None, :], len(lengths), axis=0)
    for t, n in enumerate(alive.tolist()):
        alpha = (alpha[:n] if t == 0 else alpha[:n] @ model.step) * model.emit[ordered[at : at + n]]
        scale = alpha.sum(axis=1)
        scales[at : at + n] = scale
        alpha /= scale[:, None]
        at += n
    rank = np.concatenate([np.arange(n) for n in alive]) if len(alive) else np.zeros(0, np.int64)
    out = np.empty(len(lengths))
    out[order] = np.bincount(rank, np.log(scales), minlength=len(lengths))
    return out


def expectations(model: Model, sequence: np.ndarray, lengths: np.ndarray, kept: int = KEPT_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected emissions [class, state], steps [state, state] and first states of whole sequences of classes.

    Steps are taken in blocks of about ``kept`` tokens.  The forward pass keeps
    the shares at each block's start; the backward pass computes a block's
    again (but the last one's, which are still at hand) before it goes through it.
    """
    ordered, alive, _ = _by_step(sequence, lengths)
    k = len(model.start)
    emit, step = model.emit.astype(np.float32), model.step.astype(np.float32)
    offset = np.concatenate([[0], np.cumsum(alive)])
    starts = [0]
    for t in range(1, len(alive)):
        if offset[t + 1] - offset[starts[-1]] > kept:
            starts.append(t)
    bounds = [*starts, len(alive)]

    def forward(alpha: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        base = offset[first]
        emitted = emit[ordered[base : offset[last]]]
        alphas, scales = np.empty_like(emitted), np.empty(len(emitted), np.float32)
        for t in range(first, last):
            n, at = int(alive[t]), int(offset[t] - base)
            alpha = (alpha[:n] if t == 0 else alpha[:n] @ step) * emitted[at : at + n]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            alphas[at : at + n], scales[at : at + n] = alpha, scale
        return alpha, emitted, alphas, scales

    alpha = np.repeat(model.start.astype(np.float32)[None, :], len(lengths), axis=0)
    before = []  # the shares before each block
    block = None
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        before.append(alpha)
        alpha, *block = forward(alpha, first, last)
    steps, emissions = np.zeros((k, k)), np.zeros((CLASSES + 1, k))
    beta = np.ones((len(lengths), k), np.float32)
    for i in range(len(starts) - 1, -1, -1):
        first, last = bounds[i], bounds[i + 1]
        if block is None:
            _, *block = forward(before[i], first, last)
        emitted, alphas, scales = block
        block, base = None, offset[first]
        for t in range(last - 1, first - 1, -1):
            n, at = int(alive[t]), int(offset[t] - base)
            ahead = emitted[at : at + n] * beta[:n] / scales[at : at + n, None]
            alphas[at : at + n] *= beta[:n]  # now the state shares at this step
            if t > 0:
                earlier = before[i][:n] if t == first else alphas[at - int(alive[t - 1]) :][:n]
                steps += earlier.T @ ahead
                beta[:n] = ahead @ step.T
        own = ordered[base : offset[last]]
        emissions += np.stack([np.bincount(own, alphas[:, j], minlength=CLASSES + 1) for j in range(k)], axis=1)
    return emissions, steps * model.step, alphas[: len(lengths)].sum(axis=0, dtype=np.float64)


def first_model(share: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    """Class shares with a random tilt for each state; states that tend to stay."""
    rng = np.random.default_rng(seed)
    emit = share[:, None] * np.exp(rng.normal(0, 0.7, (len(share), states)))
    emit[CLASSES] = share[CLASSES]
    emit[:CLASSES] *= (1 - share[CLASSES]) / emit[:CLASSES].sum(axis=0)
    step = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return Model(even, step, emit)


def _word_counts(training: DataFrame) -> DataFrame:
    """word (hash) and c over all training texts; the end token is not among them."""
    schema = T.StructType([T.StructField("word", T.LongType()), T.StructField("c", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in tokens(batch.column(0)):
                word, c = np.unique(part.hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c)], names=schema.names)

    return training.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("c").alias("c"))


def _class_rows(training: DataFrame) -> DataFrame:
    """classes: each training text's classes and its end as little-endian 16-bit numbers, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in tokens(batch.column(0)):
                sequence, lengths = _with_ends(part.classes, part.counts)
                offsets = np.concatenate([[0], np.cumsum(2 * lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(sequence.astype("<u2"))])], names=["classes"])

    return materialise(training.select("text").mapInArrow(run, "classes binary"))


def _class_column(word: str = "word") -> F.Column:
    return F.shiftrightunsigned(F.col(word), 64 - CLASS_BITS).cast("int")


def _gather_expectations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all training texts.  Rows: a class or, beyond, a state's steps, then the first states."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # CLASSES * STATES numbers
    k = len(model.start)
    schema = T.StructType([T.StructField("bin", T.IntegerType()), *[T.StructField(f"s{j}", T.FloatType()) for j in range(k)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 1 + k + 1, k))

        def add(held: list[np.ndarray]) -> None:
            emissions, steps, first = expectations(shipped.value, np.concatenate(held), np.array([len(h) for h in held]))
            total[: CLASSES + 1] += emissions
            total[CLASSES + 1 : -1] += steps
            total[-1] += first

        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                held.append(np.frombuffer(value.as_buffer(), "<u2"))
                size += len(held[-1])
                if size >= BATCH_TOKENS:
                    add(held)
                    held, size = [], 0
        if held:
            add(held)
        bins = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int32)), *(pa.array(total[bins, j].astype(np.float32)) for j in range(k))], names=schema.names)

    sums = rows.mapInArrow(run, schema).groupBy("bin").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toArrow()
    total = np.zeros((CLASSES + 1 + k + 1, k))
    if sums.num_rows:
        total[sums.column("bin").to_numpy()] = np.stack([sums.column(f"s{j}").to_numpy() for j in range(k)], axis=1)
    return total[: CLASSES + 1], total[CLASSES + 1 : -1], total[-1]


def maximise(emissions: np.ndarray, steps: np.ndarray, first: np.ndarray, share: np.ndarray) -> Model:
    emit = emissions + PRIOR_TOKENS * share[:, None]
    step = steps + PRIOR_STEPS
    start = first + 1.0
    return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(training: DataFrame, share: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch: each iteration reads all training texts once."""
    model, rows = first_model(share, states), _class_rows(training)
    for _ in range(iterations):
        model = maximise(*_gather_expectations(rows, model), share)
    return model


def score_documents(docs: DataFrame, held_out: tuple[int, int] = HELD_OUT, states: int = STATES, iterations: int = ITERATIONS, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    apart = crc_mod(F.col("doc_id"), held_out[0]) == held_out[1]
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(apart, F.lit(False)).alias("held_out"))
    training = docs.filter(F.col("doc_id").isNotNull() & ~F.col("held_out"))
    counts = materialise(_word_counts(training))
    n_docs = training.count()
    # Sums per class: CLASSES rows at most.
    by_class = counts.groupBy(_class_column().alias("class")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    if by_class.num_rows:
        at = by_class.column("class").to_numpy()
        n_class[at], v_class[at] = by_class.column("n").to_numpy(), by_class.column("v").to_numpy()
    weight = n_class + 0.5 * (v_class + 1)
    n_all = int(n_class.sum()) + n_docs
    v_all = int(v_class.sum()) + (n_docs > 0)
    share = np.append(weight, n_docs + 0.5)
    share /= share.sum()
    model = train(training, share, states, iterations)
    hot = counts.orderBy(F.desc("c"), "word").limit(hot_words).toArrow()  # bounded by the parameter
    hot_keys = hot.column("word").to_numpy().view(np.uint64)
    hot_counts = hot.column("c").to_numpy()
    order = np.argsort(hot_keys)
    shipped = docs.sparkSession.sparkContext.broadcast((model, hot_keys[order], hot_counts[order], np.log10(weight), n_all, v_all, n_docs))
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([*docs.select("doc_id", "held_out").schema.fields, T.StructField("n_tokens", long), T.StructField("n_known", long), T.StructField("base_score", double), T.StructField("score", double), T.StructField("rare", T.ArrayType(long)), T.StructField("rare_n", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, key_counts, log_weight, n_all, v_all, n_docs = shipped.value
        table = S.SpanTable(max(len(keys), 1))
        table.add(keys, np.arange(len(keys), dtype=np.int32))
        under = np.log10(n_all + 0.5 * (v_all + 1))
        for batch in batches:
            for start, part in tokens(batch.column(2)):
                n = len(part.counts)
                doc = np.repeat(np.arange(n), part.counts)
                entry = table.find(part.hashes)
                known = entry >= 0
                logs = np.log10(key_counts[entry[known]] + 0.5)
                class_logs = logs - log_weight[part.classes[known]]
                n_known = np.bincount(doc[known], minlength=n)
                base = np.bincount(doc[known], logs, minlength=n).astype(float) - n_known * under
                score = np.bincount(doc[known], class_logs, minlength=n).astype(float)
                base += np.log10(n_docs + 0.5) - under
                score += log_likelihood(model, part.classes, part.counts) / np.log(10)
                n_known = n_known + (n_docs > 0)
                # Words outside the hot table, each once per text, for the join.
                rest = ~known
                words, docs_ = part.hashes[rest], doc[rest]
                by = np.lexsort((words, docs_))
                words, docs_ = words[by], docs_[by]
                heads = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (docs_[1:] != docs_[:-1])])) if len(words) else np.zeros(0, np.int64)
                times = np.diff(np.append(heads, len(words))).astype(np.int32)
                offsets = np.searchsorted(docs_[heads], np.arange(n + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words[heads].view(np.int64)))
                rare_n = pa.ListArray.from_arrays(pa.array(offsets), pa.array(times))
                own = [batch.column(i).slice(start, n) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(part.counts + 1), pa.array(n_known), pa.array(base), pa.array(score), rare, rare_n], names=schema.names)

    scored = materialise(docs.select("doc_id", "held_out", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("times"))
    weights = docs.sparkSession.createDataFrame(pa.table({"class": pa.array(np.arange(CLASSES, dtype=np.int32)), "log_weight": np.log10(weight)}))
    under = float(np.log10(n_all + 0.5 * (v_all + 1)))
    c = F.coalesce("c", F.lit(0))
    logs = F.log10(c + F.lit(0.5))
    joined = rare.join(counts, "word", "left").withColumn("class", _class_column()).join(F.broadcast(weights), "class")  # CLASSES rows
    sums = joined.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * (logs - F.lit(under))).alias("base"), F.sum(F.col("times") * (logs - F.col("log_weight"))).alias("own"))
    zero = F.lit(0.0)
    out = scored.drop("rare", "rare_n").join(sums, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", zero)).alias("base_score"), (F.col("score") + F.coalesce("own", zero)).alias("score"),
    )
