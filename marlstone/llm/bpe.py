"""Operator 8: byte-level BPE encoding and decoding.

Method: the pre-tokens that a worker has not met yet are laid out, by length
bucket, as padded matrices of symbol ids.  In each round every row merges its
leftmost pair of minimum rank; pair ranks come from a hashed table, finished
rows leave the matrix (compaction).  Known pre-tokens come from a bounded
table of span hashes (96 bits, two independent hashes), so that a word is
merged once per worker, not once per occurrence.

Rounds of one merge cost the square of a row's length.  Rows of more than
``WIDEST`` bytes make the same merges in the same order, leftmost pair of least
rank first, from a heap of pairs over a linked list, so that a pre-token of any
length costs no more than its length times the heap's depth.

Contract of :func:`encode`: one row per input row; a null or empty text has no
ids (empty binary, n_tokens 0).  Repeated rows give repeated results.  Extra
columns are dropped unless named in ``keep``; output names are fixed.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm import spans as S

NEVER = np.int32(2**31 - 1)
#: Rows wider than this are merged one by one, from a heap.
WIDEST = 256
#: Entries of a worker's table of known pre-tokens; beyond it the table starts anew.
TABLE_LIMIT = 1 << 18


@dataclass(frozen=True)
class BpeModel:
    """Merge rules as flat arrays, small enough to ship with a task (a few MB).

    pair_keys: left << 32 | right, with the rank of each; merged[rank] is the new id.
    first: id of each byte; last: id of each byte where it ends a word (the same
    unless the vocabulary marks word ends).  token_bytes: the bytes of every id.
    digest: names the model, a digest of all it was read from.
    """

    digest: str
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    merged: np.ndarray
    first: np.ndarray
    last: np.ndarray
    token_bytes: tuple[bytes, ...]


def rank_file_model(path: str) -> BpeModel:
    """From a file of base64 tokens and ranks; the rank is the id."""
    with open(path, "rb") as file:
        content = file.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    keys, order = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                order.append(rank)
    size = max(ranks.values()) + 1
    back = {v: k for k, v in ranks.items()}
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    return BpeModel(hashlib.sha256(content).hexdigest(), np.array(keys, np.uint64), np.array(order, np.int32), np.arange(size, dtype=np.int32), single, single, tuple(back.get(i, b"") for i in range(size)))


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merges_file_model(text: str, word_end: str = "") -> BpeModel:
    """From a tokenizer's JSON with ``model.vocab`` and ``model.merges``."""
    model = json.loads(text)["model"]
    vocab, alphabet = model["vocab"], byte_alphabet()
    keys, merged = [], []
    for entry in model["merges"]:
        left, right = entry.split(" ") if isinstance(entry, str) else entry
        keys.append(vocab[left] << 32 | vocab[right])
        merged.append(vocab[left + right])
    back = {c: b for b, c in alphabet.items()}
    plain = [""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        plain[i] = token.removesuffix(word_end) if word_end else token
    as_bytes = tuple(bytes(back[c] for c in token) if all(c in back for c in token) else b"" for token in plain)
    first = np.array([vocab[alphabet[b]] for b in range(256)], np.int32)
    last = np.array([vocab[alphabet[b] + word_end] for b in range(256)], np.int32)
    digest = hashlib.sha256(f"{len(word_end)}{word_end}{text}".encode()).hexdigest()
    return BpeModel(digest, np.array(keys, np.uint64), np.arange(len(keys), dtype=np.int32), np.array(merged, np.int32), first, last, as_bytes)


class MatrixBpe:
    """Merges many words at once."""

    def __init__(self, model: BpeModel) -> None:
        self.model = model
        self.pairs = S.SpanTable(max(len(model.pair_keys), 1))
        self.pairs.add(S.mix(model.pair_keys + np.uint64(1)), model.pair_ranks)
        self._rank_of: dict[int, int] | None = None  # for long rows only

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) + np.uint64(1)
        rank = self.pairs.find(S.mix(key).ravel()).reshape(key.shape)
        return np.where(rank < 0, NEVER, rank)

    def _bucket(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the rows of a padded matrix; returns the matrix and the sizes after it."""
        out, left = symbols, sizes.copy()
        rows = np.arange(len(symbols))
        work = symbols.copy()
        width = work.shape[1]
        ranks = self._ranks(work[:, :-1], work[:, 1:])
        ranks[np.arange(1, width)[None, :] >= sizes[:, None]] = NEVER
        cols = np.arange(width)
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            live = best != NEVER
            if not live.all():  # compaction: finished rows leave
                out[rows[~live]] = work[~live]
                rows, work, ranks, at, best = rows[live], work[live], ranks[live], at[live], best[live]
            if not len(rows):
                return out, left
            line = np.arange(len(rows))
            take = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            work = np.take_along_axis(work, take, axis=1)
            work[line, at] = self.model.merged[best]
            left[rows] -= 1
            size = left[rows]
            keep = np.minimum(cols[None, :-1] + (cols[None, :-1] > at[:, None]), width - 2)
            ranks = np.take_along_axis(ranks, keep, axis=1)
            ranks[cols[None, 1:] >= size[:, None]] = NEVER
            for shift in (-1, 0):
                j = at + shift
                ok = (j >= 0) & (j + 1 < size)
                r, c = line[ok], j[ok]
                ranks[r, c] = self._ranks(work[r, c], work[r, c + 1])

    def _long(self, row: np.ndarray) -> np.ndarray:
        """One long row: pairs wait in a heap by rank and place; a pair that has changed since is passed over."""
        if self._rank_of is None:
            self._rank_of = dict(zip(self.model.pair_keys.tolist(), self.model.pair_ranks.tolist(), strict=True))
        rank_of, merged = self._rank_of, self.model.merged
        ids = row.tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self._ranks(row[:-1], row[1:])
        some = np.flatnonzero(ranks != NEVER)
        heap = list(zip(ranks[some].tolist(), some.tolist(), strict=True))
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = int(merged[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n:
                    made = rank_of.get(ids[x] << 32 | ids[after[x]])
                    if made is not None:
                        heapq.heappush(heap, (made, x))
        return np.array([v for v in ids if v >= 0], np.int32)

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as bytes one after another -> their ids one after another, ids per word."""
        starts = np.cumsum(sizes) - sizes
        ids = self.model.first[data]
        some = sizes > 0
        ends = (starts + sizes - 1)[some]
        ids[ends] = self.model.last[data[ends]]
        after = sizes.copy()
        results: list[tuple[np.ndarray, np.ndarray]] = []
        low = 1
        for high in (*(w for w in (2, 3, 4, 6, 8, 10, 12, 16, 24, 48, 96) if w < WIDEST), WIDEST):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for part in np.array_split(rows, max(1, len(rows) * high // (1 << 18))):
                if len(part):
                    cols = np.arange(high)
                    at = np.minimum(starts[part][:, None] + cols, len(ids) - 1)
                    matrix, left = self._bucket(ids[at], sizes[part])
                    after[part] = left
                    results.append((part, matrix))
        for i in np.flatnonzero(sizes > WIDEST):
            row = self._long(ids[starts[i] : starts[i] + sizes[i]])
            after[i] = len(row)
            results.append((np.array([i]), row[None, :]))
        out_starts = np.cumsum(after) - after
        out = np.zeros(int(after.sum()), np.int32)
        ones = np.flatnonzero(sizes == 1)
        out[out_starts[ones]] = ids[starts[ones]]
        for part, matrix in results:
            cols = np.arange(matrix.shape[1])[None, :]
            inside = cols < after[part][:, None]
            out[(out_starts[part][:, None] + cols)[inside]] = matrix[inside]
        return out, after


class SpanEncoder:
    """Ids of spans, each distinct span merged once; bounded memory."""

    def __init__(self, model: BpeModel, limit: int = TABLE_LIMIT) -> None:
        self.bpe, self.limit = MatrixBpe(model), limit
        self._clear()

    def _clear(self) -> None:
        self.table = S.SpanTable(self.limit, checked=True)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int32)

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])

    def lookup(self, piece: S.Slice, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of every span."""
        hashes, checks = piece.checked_hashes(starts, ends)
        entry = self.table.find(hashes, checks)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            at = missing[S.distinct(hashes[missing], checks[missing])[0]]
            if self.table.full(len(at)):
                limit = max(self.limit, 2 * len(at))
                if self.table.count:
                    self._clear()
                    at, _ = S.distinct(hashes, checks)
                    limit = max(self.limit, len(at))
                if limit > self.limit:
                    self.table = S.SpanTable(limit, checked=True)
            ids, sizes = self.bpe.merge(S.gather(piece.data, starts[at], ends[at] - starts[at]), (ends - starts)[at])
            n, used = self.table.count, self.used
            self.table.add(hashes[at], np.arange(n, n + len(at), dtype=np.int32), checks[at])
            self.starts, self.sizes = self._room(self.starts, n + len(at)), self._room(self.sizes, n + len(at))
            self.pool = self._room(self.pool, used + len(ids))
            self.starts[n : n + len(at)] = used + np.cumsum(sizes) - sizes
            self.sizes[n : n + len(at)] = sizes
            self.pool[used : used + len(ids)] = ids
            self.used += len(ids)
            entry = self.table.find(hashes, checks)
        return entry

    def encode(self, piece: S.Slice, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice, and the number of ids of each text."""
        entry = self.lookup(piece, starts, ends)
        sizes = self.sizes[entry].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = S.gather(self.pool, self.starts[entry], sizes)
        return ids, np.diff(total[np.searchsorted(starts, piece.offsets)])


_ENCODERS: dict[str, SpanEncoder] = {}


def worker_encoder(model: BpeModel) -> SpanEncoder:
    """The encoder of this Python worker, kept between its tasks."""
    if model.digest not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model.digest] = SpanEncoder(model)
    return _ENCODERS[model.digest]


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value per size, cut from ``values``."""
    width = values.dtype.itemsize
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * width
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def encode(docs: DataFrame, model: BpeModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens long, ids binary (little-endian unsigned 32-bit ids)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a fixed vocabulary: a few MB
    kept = list(keep)
    schema = T.StructType([*_fields(docs, kept), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shipped.value)
        for batch in batches:
            for piece in S.slices(batch.column(len(kept))):
                ids, sizes = encoder.encode(piece, *S.byte_level_pretokens(piece))
                own = [batch.column(i).slice(piece.first, piece.n) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes), _binary(ids.astype("<u4"), sizes)], names=schema.names)

    return docs.select(*kept, docs[text].cast("string").alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: BpeModel, ids: str = "ids", keep: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """``keep`` columns and decoded binary: the bytes that the ids stand for (null ids: empty)."""
    shipped = encoded.sparkSession.sparkContext.broadcast(model)
    kept = list(keep)
    schema = T.StructType([*_fields(encoded, kept), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shipped.value.token_bytes
        sizes = np.array([len(t) for t in tokens], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                rows = [np.frombuffer(x, "<u4") for x in (v or b"" for v in part.column(len(kept)).to_pylist())]
                counts = np.array([len(r) for r in rows])
                all_ids = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
                total = np.concatenate([[0], np.cumsum(sizes[all_ids])])
                lengths = np.diff(total[np.concatenate([[0], np.cumsum(counts)])])
                out = S.gather(flat, starts[all_ids], sizes[all_ids])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], _binary(out, lengths)], names=schema.names)

    return encoded.select(*kept, encoded[ids].alias("__ids")).mapInArrow(run, schema)
