"""Operator 4: token counts by the whole-token shortcut.

Method: ``prove_whole_tokens`` runs the merges over every vocabulary string
once, on the driver, and keeps those that end as exactly one token.  Pre-tokens
that match one of them count 1 by a table lookup; only the rest are merged, and
each distinct one once per worker (bounded table).

Contract: one row per input row; null and empty texts have 0 bytes and tokens.
Texts that hold the literal of a special token go to the library itself, as its
default handling of those strings cuts the text before normalisation.
Repeated rows give repeated results; extra columns are dropped unless in ``keep``.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.llm import bpe
from marlstone.llm import spans as S

WORD_END = "</w>"


def prove_whole_tokens(model: bpe.BpeModel) -> list[bytes]:
    """The byte strings that the merges turn into a single token."""
    known = sorted({t for t in model.token_bytes if t})
    sizes = np.array([len(t) for t in known], np.int64)
    _, after = bpe.MatrixBpe(model).merge(np.frombuffer(b"".join(known), np.uint8), sizes)
    return [t for t, n in zip(known, after, strict=True) if n == 1]


def normalise(text: str) -> str:
    """NFC, then lower case character by character (no final-sigma rule)."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class SpanCounter:
    """Tokens of spans; whole tokens are known from the start, the rest is learned within a bound."""

    def __init__(self, model: bpe.BpeModel, whole: list[bytes], limit: int = bpe.TABLE_LIMIT) -> None:
        self.bpe, self.limit = bpe.MatrixBpe(model), limit
        ends = np.cumsum([len(t) for t in whole])
        piece = S.Slice(0, np.frombuffer(b"".join(whole), np.uint8), np.array([0, ends[-1] if len(ends) else 0]))
        hashes, checks = piece.checked_hashes(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64))
        first, _ = S.distinct(hashes, checks)
        self.whole = hashes[first], checks[first]
        self._clear(limit)

    def _clear(self, limit: int) -> None:
        hashes, checks = self.whole
        self.table = S.SpanTable(max(limit, 2 * len(hashes)), checked=True)
        self.table.add(hashes, np.ones(len(hashes), np.int32), checks)

    def count(self, piece: S.Slice, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each text of the slice."""
        hashes, checks = piece.checked_hashes(starts, ends)
        tokens = self.table.find(hashes, checks)
        rest = np.flatnonzero(tokens < 0)
        if len(rest):
            where, back = S.distinct(hashes[rest], checks[rest])
            at = rest[where]
            _, sizes = self.bpe.merge(S.gather(piece.data, starts[at], ends[at] - starts[at]), (ends - starts)[at])
            if self.table.full(len(at)):
                self._clear(max(self.limit, len(self.whole[0]) + 2 * len(at)))
            self.table.add(hashes[at], sizes.astype(np.int32), checks[at])
            tokens[rest] = sizes[back]
        total = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
        return np.diff(total[np.searchsorted(starts, piece.offsets)])


_COUNTERS: dict[str, SpanCounter] = {}


def worker_counter(model: bpe.BpeModel, whole: list[bytes]) -> SpanCounter:
    """The counter of this Python worker, kept between its tasks."""
    if model.digest not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[model.digest] = SpanCounter(model, whole)
    return _COUNTERS[model.digest]


def count_tokens(docs: DataFrame, tokenizer_json: str, limit: int = 2048, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    model = bpe.merges_file_model(tokenizer_json, WORD_END)
    special = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])]
    shipped = docs.sparkSession.sparkContext.broadcast((model, prove_whole_tokens(model), tokenizer_json))  # fixed size
    kept = list(keep)
    schema = T.StructType([*[T.StructField(n, docs.schema[n].dataType, True) for n in kept], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter, library = worker_counter(*shipped.value[:2]), None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = pc.fill_null(part.column(len(kept)), "")
                n_bytes = pc.binary_length(texts.cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(np.int64)
                rows, literal = [], []
                for i, value in enumerate(texts.to_pylist()):
                    if any(s in value for s in special):
                        literal.append((i, value))
                        value = ""
                    rows.append(normalise(value))
                counts = [counter.count(piece, *S.lone_pretokens(piece)) for piece in S.slices(pa.array(rows, pa.large_string()))]
                n_tokens = np.concatenate(counts)
                for i, value in literal:
                    if library is None:
                        from tokenizers import Tokenizer

                        library = Tokenizer.from_str(shipped.value[2])
                    n_tokens[i] = len(library.encode(value, add_special_tokens=False).ids)
                own = [part.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=schema.names)

    return docs.select(*kept, docs[text].cast("string").alias("__text")).mapInArrow(run, schema)
