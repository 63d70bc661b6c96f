"""Operator 6: best-fit packing with certified lower bounds.

Method: pieces are dealt at random to partitions of bounded size; each runs
best-fit decreasing.  Dual feasible functions give a lower bound of the bins of
any set of lengths, so a partition whose bin count equals its bound is
certified and stays as it is.  Partitions with a gap exchange documents: the
pieces of their unfilled bins are pooled, dealt anew and packed again, until
the whole is certified or an exchange gains nothing.

Contract: one row per piece.  A null or empty text is a document of the end
token alone.  A document longer than a sequence is cut into full pieces, the
first may be shorter; full pieces are sequences of their own.  Repeated rows
are packed each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import bpe
from marlstone.llm import spans as S
from marlstone.llm.common import materialise

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs at a time.
PART_PIECES = 40_000


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, longest first into the fullest bin with room; the number of bins."""
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    n = 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            b, room = n, capacity
            n += 1
        bins[i], offsets[i] = b, capacity - room
        room -= size
        if room:
            by_room[room].append(b)
            open_rooms |= 1 << room
    return bins, offsets, n


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing needs; counts[x] items have length x (0 <= x <= capacity).

    The greatest bound of two families of dual feasible functions: items over
    capacity - a count whole and items below a not at all; and the rounding
    functions floor((k + 1) x / capacity) / k.
    """
    x = np.arange(capacity + 1)
    if not counts[1:].any():
        return 0
    best = -(-int((counts * x).sum()) // capacity)
    number, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * x)])
    for a in range(capacity // 2 + 1):
        whole = number[capacity + 1] - number[capacity - a + 1]
        half = number[capacity - a + 1] - number[capacity // 2 + 1]
        middle = volume[capacity - a + 1] - volume[a]
        best = max(best, int(whole + max(half, -(-int(middle) // capacity))))
    for k in range(1, 33):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        share = np.where(exact, scaled * k, (scaled // capacity) * (k + 1) * capacity)  # over k (k + 1) capacity
        best = max(best, -(-int((counts * share).sum()) // (k * (k + 1) * capacity)))
    return best


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece of every document."""
    model = bpe.merges_file_model(tokenizer_json)
    special = [t["content"].encode() for t in json.loads(tokenizer_json).get("added_tokens", [])]
    shipped = docs.sparkSession.sparkContext.broadcast((model, tokenizer_json))  # a fixed vocabulary
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, library = bpe.worker_encoder(shipped.value[0]), None
        for batch in batches:
            for part in S.slices(batch.column(1)):
                ids, sizes = encoder.encode(part, *S.byte_level_pretokens(part))
                raw = part.data.tobytes()
                literal = [i for s in special if s in raw for i in range(part.n) if s in raw[part.offsets[i] : part.offsets[i + 1]]]
                if literal:  # the library cuts these texts at its special tokens
                    if library is None:
                        from tokenizers import Tokenizer

                        library = Tokenizer.from_str(shipped.value[1])
                    rows = np.split(ids, np.cumsum(sizes)[:-1])
                    for i in set(literal):
                        rows[i] = np.array(library.encode(raw[part.offsets[i] : part.offsets[i + 1]].decode(), add_special_tokens=False).ids, np.int32)
                    sizes = np.array([len(r) for r in rows])
                    ids = np.concatenate(rows).astype(np.int32)
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                sizes = sizes + 1
                n_pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(part.n), n_pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                head = sizes - (n_pieces - 1) * capacity
                start = np.where(number == 0, 0, head[doc] + (number - 1) * capacity)
                length = np.where(number == 0, head[doc], capacity)
                own = batch.column(0).slice(part.first, part.n).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([own, pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), bpe._binary(ids.astype("<u4"), length)], names=schema.names)

    return docs.select(docs[doc_id], docs[text].cast("string").alias("__text")).mapInArrow(run, schema)


_PLACED = "sequence_id long, offset long, gap boolean, filled boolean"


def _pack_parts(open_pieces: DataFrame, parts: int, round_: int, capacity: int) -> DataFrame:
    """Deal the pieces to ``parts`` and pack each; gap: the part's bins exceed its bound; filled: the bin is full."""
    schema = T.StructType([*[f for f in open_pieces.schema.fields], *T.StructType.fromDDL(_PLACED).fields])

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop(columns="part").sort_values("row", kind="stable", ignore_index=True)
        lengths = group["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        gap = n > lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, lengths, minlength=n).astype(np.int64)
        base = (round_ << 52) + (int(key[0]) << 28)
        return group.assign(sequence_id=base + bins, offset=offsets, gap=gap, filled=(fill == capacity)[bins])

    dealt = open_pieces.withColumn("part", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").applyInPandas(pack, schema)


def _bins(placed: DataFrame) -> int:
    return placed.filter(F.col("offset") == 0).count()


def pack(cut: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, max_exchanges: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (a column ``length``, 1 to capacity, is needed).

    Every exchange but the last saves a bin at least, so exchanges end without a limit; one may be set.
    """
    columns = cut.columns
    # A row's number is only for dealing; it is fixed by the written table.
    cut = materialise(cut.withColumn("row", F.monotonically_increasing_id()))
    full = cut.filter(F.col("length") == capacity).select(*columns, (F.lit(-1) - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = cut.filter(F.col("length") < capacity)
    n = todo.count()
    done: list[DataFrame] = [full]
    current: DataFrame | None = None
    current_bins = 0
    for round_ in count():
        if not n or (max_exchanges is not None and round_ > max_exchanges):
            break
        parts = -(-n // part_pieces)
        packed = materialise(_pack_parts(todo, parts, round_, capacity))
        bins = _bins(packed)
        if current is not None and bins >= current_bins:
            break  # the exchange gained nothing: the placement before it stands
        if current is not None:
            done[-1] = done[-1].filter(~_pooled())  # those pieces have new places
        done.append(packed)
        pool = packed.filter(_pooled())
        n, current_bins, current = pool.count(), _bins(pool), packed
        counts = np.zeros(capacity + 1, np.int64)
        for length, k in pool.groupBy("length").count().collect():  # at most ``capacity`` rows
            counts[length] = k
        if current_bins <= lower_bound(counts, capacity):
            break
        todo = pool.drop("sequence_id", "offset", "gap", "filled")
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df.select(*columns, "sequence_id", "offset"))
    return out


def _pooled() -> Column:
    """Pieces that a partition with a gap offers for exchange: those of its unfilled bins."""
    return F.col("gap") & ~F.col("filled")
