"""Pluggable models: each is loaded once in a Python worker and sees whole batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[list[str]], list[list[float]]]
PairScorer = Callable[[list[str], list[str]], list[float]]
Generator = Callable[[list[str]], list[str]]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed word hashes, at length one; the zero vector for a blank text.  The same for every run and machine."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        size = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return (out / np.where(size == 0, 1, size)).tolist()

    return embed


def embedding(text: Column, load: Callable[[], Embedder] = hashing_embedder) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    return run(text)


def overlap_scorer() -> PairScorer:
    """The share of a question's distinct words that a text holds as words: a deterministic stand-in for a cross-encoder."""

    def words(text: str) -> set[str]:
        return {w for w in re.split(r"[\t\n\f\r ]+", text) if w}

    def score(asked: list[str], texts: list[str]) -> list[float]:
        return [len(words(q) & words(t)) / max(len(words(q)), 1) for q, t in zip(asked, texts, strict=True)]

    return score


def excerpt_generator(size: int = 300) -> Generator:
    """Answers by the first characters of the prompt: a deterministic stand-in for a language model."""
    return lambda prompts: [p[:size] for p in prompts]


def pair_score(question: Column, text: Column, load: Callable[[], PairScorer]) -> Column:
    """A cross-encoder's score of each pair."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            yield pd.Series(model(q.fillna("").tolist(), t.fillna("").tolist()))

    return run(question, text)


def pair_input(text: Column, entities: tuple[str, ...], limit: int = 512, keep: int = 400) -> Column:
    """A text cut for a cross-encoder: up to three sentences with an entity, else its first characters."""
    said = F.filter(F.split(text, "[。！？.!?\n]"), lambda s: F.exists(F.array(*[F.lit(e) for e in entities]), lambda e: F.contains(s, e)))
    chosen = F.when(F.size(said) > 0, F.array_join(F.slice(said, 1, 3), ". ")).otherwise(F.substring(text, 1, keep))
    return F.when(F.length(text) > limit, F.substring(chosen, 1, keep)).otherwise(text)


def answers(prompts: DataFrame, load: Callable[[], Generator], prompt: str = "prompt") -> DataFrame:
    """Adds answer and error: a failed batch keeps its rows and says why."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            try:
                yield frame.assign(answer=model(frame[prompt].fillna("").tolist()), error=None)
            except Exception as e:  # noqa: BLE001  the row's status replaces the exception
                yield frame.assign(answer=None, error=str(e))

    return prompts.mapInPandas(run, schema)
