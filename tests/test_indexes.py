"""Indexes that leave blocks and lists closed give what the plain operators give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import lexical, pruned, vector


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    """Token columns, which need a session."""
    globals().update(TEXT=X.tokens(F.col("text"), least=1), QUESTION=X.tokens(F.col("question"), least=1))



def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def topical(spark):
    """Documents of ten topics with words of their own, some null, empty or repeated."""
    made = np.random.default_rng(1)
    docs = [(i, " ".join(made.choice([f"t{i % 10}w{j}" for j in range(8)] + ["the", "of"], 12 + i % 7))) for i in range(600)]
    docs += [(600, None), (601, ""), (602, docs[3][1]), (603, docs[3][1])]
    asked = [(100 + t, f"the t{t}w1 t{t}w2 t{t}w2") for t in range(10)] + [(200, "nowhere"), (201, ""), (202, "the of")]
    return spark.createDataFrame(docs, "chunk_id long, text string").cache(), spark.createDataFrame(asked, "query_id long, question string").cache()


def test_batched_scores_keep_the_k_best(topical):
    docs, asked = topical
    want = rows(lexical.top_k(lexical.bm25_scores(docs, asked, TEXT, QUESTION), 7), "query_id", "chunk_id", "score", "rank")
    assert rows(lexical.bm25_top_k(docs, asked, TEXT, QUESTION, 7), "query_id", "chunk_id", "score", "rank") == want and len(want) == 11 * 7


def test_small_limits_change_nothing(topical, monkeypatch):
    docs, asked = topical
    want = rows(lexical.bm25_top_k(docs, asked, TEXT, QUESTION, 5), "query_id", "chunk_id", "score", "rank")
    monkeypatch.setattr(lexical, "CELLS", 20)
    assert rows(lexical.bm25_top_k(docs, asked, TEXT, QUESTION, 5), "query_id", "chunk_id", "score", "rank") == want
    monkeypatch.setattr(lexical, "MOST_TERMS", 12)
    assert rows(lexical.bm25_top_k(docs, asked, TEXT, QUESTION, 5), "query_id", "chunk_id", "score", "rank") == want
    monkeypatch.setattr(lexical, "MOST_BLOCKS", 1)
    assert rows(lexical.bm25_top_k(docs, asked, TEXT, QUESTION, 5), "query_id", "chunk_id", "score", "rank") == want


def test_blocks_stay_closed_and_no_hit_is_lost(spark, topical, tmp_path):
    docs, asked = topical
    index = pruned.save(docs, TEXT, str(tmp_path / "index"), per_block=4)
    want = rows(lexical.top_k(lexical.bm25_scores(docs, asked, TEXT, QUESTION), 5), "query_id", "chunk_id", "score", "rank")
    assert rows(pruned.top_k(pruned.load(spark, str(tmp_path / "index")), asked, QUESTION, 5), "query_id", "chunk_id", "score", "rank") == want
    terms = pruned.weights(index, asked, QUESTION)
    found = pruned.score_blocks(index, terms, pruned.seed_blocks(index, terms, 10))
    least = pruned.kth_scores(found, 5).cache()
    everything, opened = pruned.open_blocks(index, terms, least.limit(0)).count(), pruned.open_blocks(index, terms, least).count()
    assert opened < everything / 2


def test_index_of_nothing(topical):
    docs, asked = topical
    assert pruned.top_k(pruned.build(docs.limit(0), TEXT), asked, QUESTION, 5).count() == 0
    assert lexical.bm25_top_k(docs.limit(0), asked, TEXT, QUESTION, 5).count() == 0
    assert lexical.bm25_top_k(docs, asked.limit(0), TEXT, QUESTION, 5).count() == 0


@pytest.fixture(scope="module")
def clustered(spark):
    made = np.random.default_rng(2)
    centres = made.normal(size=(20, 8)) * 5
    vectors = [(i, (centres[i % 20] + made.normal(size=8) * 0.1).tolist()) for i in range(1000)]
    vectors += [(1000, vectors[0][1]), (1001, vectors[0][1]), (1002, None)]
    return spark.createDataFrame(vectors, "chunk_id long, embedding array<double>").cache()


def brute(pairs, queries, k):
    ids, x = np.array([i for i, v in pairs if v is not None]), np.array([v for _, v in pairs if v is not None])
    out = []
    for q, v in queries:
        d = np.round(((x - np.array(v)) ** 2).sum(axis=1), 6)
        out += [(q, int(ids[j]), r + 1) for r, j in enumerate(np.lexsort((ids, d))[:k])]
    return sorted(out)


def test_lists_stay_closed_and_no_neighbour_is_lost(spark, clustered, tmp_path):
    queries = clustered.filter("chunk_id % 20 = 0 AND embedding IS NOT NULL").withColumnRenamed("chunk_id", "query_id")
    pairs = [tuple(r) for r in clustered.collect()]
    want = brute(pairs, [tuple(r) for r in queries.collect()], 6)
    index = vector.save(clustered, str(tmp_path / "vectors"), cells=24)
    assert rows(vector.search(vector.load(spark, str(tmp_path / "vectors")), queries, 6), "query_id", "chunk_id", "rank") == want
    assert rows(vector.top_k(queries, clustered, 6), "query_id", "chunk_id", "rank") == want
    cells = index.cells.count()
    found = vector._ranked(vector._blockwise(vector.probes(queries, index), index.lists, 6), 6)
    assert vector.still_open(queries, index, found, 6).count() < queries.count() * cells / 10


def test_vectors_in_blocks_and_of_nothing(spark, clustered, monkeypatch, tmp_path):
    queries = clustered.filter("chunk_id % 100 = 0 AND embedding IS NOT NULL").withColumnRenamed("chunk_id", "query_id")
    want = rows(vector.top_k(queries, clustered, 4), "query_id", "chunk_id", "rank")
    monkeypatch.setattr(vector, "MOST_NUMBERS", 16)
    assert rows(vector.top_k(queries, clustered, 4), "query_id", "chunk_id", "rank") == want
    monkeypatch.setattr(vector, "MOST_BLOCKS", 1)
    assert rows(vector.top_k(queries, clustered, 4), "query_id", "chunk_id", "rank") == want
    assert vector.top_k(queries, clustered.limit(0), 4).count() == 0 and vector.top_k(queries.limit(0), clustered, 4).count() == 0
    empty = vector.save(clustered.limit(0), str(tmp_path / "none"))
    assert vector.search(empty, queries, 4).count() == 0
