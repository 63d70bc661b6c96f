"""What a step ships and holds grows with its input alone."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_grounding import DELIMITERS, INDICATORS, PATTERNS, brute, support

from marlstone.functions import text as X
from marlstone.operators import grounding, incremental, lexical, phrases, pruned, vector
from marlstone.plans import retrieval


def shuffled(spark):
    """Bytes that all tasks of the session have written for a shuffle."""
    held = spark._jsc.sc().statusStore().executorList(False)
    return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))


def test_a_fact_is_not_shipped_for_each_of_its_words(spark):
    made = random.Random(1)
    word = lambda: "".join(made.choice("abcdefghijklmnopqrst") for _ in range(made.randint(3, 9)))
    sentence = lambda: "thing " + " ".join(word() for _ in range(150))
    turns = [(g, 0, sentence()) for g in range(60)]
    bent = lambda text: " ".join(made.sample(text.split(), 120))
    said = [(g, g, "q", bent(turns[g][2]) if g % 2 else sentence()) for g in range(60)]
    before = shuffled(spark)
    got = support(spark, said, turns)
    assert shuffled(spark) - before < 20 * sum(len(r[-1]) for r in turns + said)
    assert got == brute(said, turns) and {k for _, _, k in got} == {0, 1}


def test_words_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(grounding, "MEETINGS", 3)
    made = random.Random(2)
    turns = [(g, p, " ".join(made.choice(["thing", "things", "tion", "a", "of", "the", "12"]) for _ in range(6))) for g in (1, 2) for p in range(8)]
    said = [(i, made.choice([1, 2, 3]), "q", " ".join(made.choice(["thing", "tion", "of", "the", "x", "yes", "no"]) for _ in range(5))) for i in range(40)]
    assert support(spark, said, turns) == brute(said, turns)
    own, known = (spark.createDataFrame(rows, "group long, fact string") for rows in ([(1, "!!!!"), (2, "!!!!")], [(1, "wholly different")]))
    assert [tuple(r) for r in grounding.similar_facts(own, known, share=0.6).collect()] == [(1, "!!!!")]


def test_an_upsert_deals_the_index_by_rows(spark, monkeypatch):
    rows = [(f"f{i}", f"t{j}") for i in range(40) for j in range(25)]
    index = spark.createDataFrame(rows, "path string, term string")
    files = spark.createDataFrame([(f"f{i}", "old" if i % 4 else "new") for i in range(40)], "path string, text string")
    stored = incremental.fingerprints(spark.createDataFrame([(f"f{i}", "old") for i in range(40)], "path string, text string"))
    monkeypatch.setattr(incremental, "ROWS", 100)
    out = incremental.upsert_index(index, stored, files, lambda changed: changed.select("path", F.lit("x").alias("term")))
    assert sorted(tuple(r) for r in out.collect()) == sorted([r for r in rows if int(r[0][1:]) % 4] + [(f"f{i}", "x") for i in range(0, 40, 4)])
    assert re.search(r"hashpartitioning\(path#\d+, 10\), REPARTITION_BY_NUM", out._jdf.queryExecution().toString())


def test_fixed_phrases_are_counted_without_a_posting_for_each_word(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(phrases, "save", None)
    assert retrieval.exact_phrase(spark, sf_dir).count() and retrieval.forced_recall(spark, sf_dir).count() is not None


def text():
    return X.tokens(F.col("text"))


def question():
    return X.tokens(F.col("question"))


def made_corpus(spark, n=400):
    made = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [(i, f"k{i % 3}" if i % 7 else None, " ".join(made.choices(words, [1 / (j + 1) for j in range(60)], k=made.randint(0, 40))) or None) for i in range(n)]
    asked = [(i, " ".join(made.sample(words, 6))) for i in range(30)]
    return spark.createDataFrame(texts, "chunk_id long, kind string, text string").repartition(3), spark.createDataFrame(asked, "query_id long, question string")


def same(got, want):
    columns = ["query_id", "chunk_id", "score", "rank"]
    got, want = (sorted(tuple(r) for r in x.select(*columns).collect()) for x in (got, want))
    assert got == want and got


def test_terms_set_aside_lose_no_text(spark, monkeypatch):
    docs, asked = made_corpus(spark)
    want = lexical.top_k(lexical.bm25_scores(docs, asked, text(), question()), 4)
    monkeypatch.setattr(lexical, "CELLS", 300)
    for share in (0.0, 0.7, 1.0):
        monkeypatch.setattr(lexical, "ASIDE", share)
        same(lexical.bm25_top_k(docs, asked, text(), question(), 4), want)


def test_best_texts_of_a_question_s_kinds(spark, monkeypatch):
    docs, asked = made_corpus(spark)
    kinds = spark.createDataFrame([(i, f"k{i % 3}") for i in range(25)] + [(1, "k2"), (2, None)], "query_id long, kind string")
    allowed = docs.select("chunk_id", "kind").join(kinds, "kind").select("query_id", "chunk_id")
    for scores, top in (
        (lexical.bm25_scores, lambda: lexical.bm25_top_k(docs, asked, text(), question(), 4, kinds=(F.col("kind"), kinds))),
        (lexical.keyword_frequency_scores, lambda: lexical.shared_top_k(docs, asked, text(), question(), "keyword", 4, (F.col("kind"), kinds))),
    ):
        want = lexical.top_k(scores(docs, asked, text(), question()).join(allowed, ["query_id", "chunk_id"], "left_semi"), 4)
        same(top(), want)
        with monkeypatch.context() as m:
            m.setattr(lexical, "MOST_BLOCKS", 0)
            same(top(), want)


def test_counts_of_shared_terms_ship_no_row_for_each_pair(spark):
    docs, asked = made_corpus(spark, 3000)
    for count, scores in (("frequency", lexical.term_frequency_scores), ("overlap", lexical.overlap_scores), ("keyword", lexical.keyword_frequency_scores)):
        want = lexical.top_k(scores(docs, asked, text(), question()), 4)
        before = shuffled(spark)
        got = lexical.shared_top_k(docs.coalesce(3), asked, text(), question(), count, 4).localCheckpoint()
        assert shuffled(spark) - before < 500_000
        same(got, want)


def test_equal_questions_are_scored_once(spark, monkeypatch):
    docs, asked = made_corpus(spark)
    again = asked.unionByName(asked.select((F.col("query_id") + 100).alias("query_id"), F.array_join(F.shuffle(F.split("question", " ")), " ").alias("question")))
    want = lexical.top_k(lexical.bm25_scores(docs, again, text(), question()), 4)
    shipped, whole = [], lexical._best_of
    monkeypatch.setattr(lexical, "_best_of", lambda texts, asked, *rest: shipped.append(asked.select("query_id").distinct().count()) or whole(texts, asked, *rest))
    same(lexical.bm25_top_k(docs, again, text(), question(), 4), want)
    assert shipped == [30]


@pytest.mark.parametrize("limits", [{"TILE": 7, "HEAD": 2}, {"TILE": 1, "HEAD": 0}, {"CELLS": 10, "ENTRIES": 5, "TEXTS": 11}])
@pytest.mark.parametrize("weight", ["1 + pmod(hash(term), 7) / 4D", "pmod(hash(term), 5) - 2D"])
def test_tiles_lose_no_text(spark, monkeypatch, limits, weight):
    """Weights of nothing and below count, too: then a shared term alone makes a hit."""
    docs, asked = made_corpus(spark)
    terms = lexical.question_terms(asked, question()).select("query_id", "term", F.expr(weight).alias("weight"))
    found = lambda: lexical.best_texts(docs, terms, text(), 4, lambda tf, dl: tf / (tf + dl), F.expr("weight * (tf / (tf + dl))"))
    with monkeypatch.context() as m:
        m.setattr(lexical, "MOST_BLOCKS", 0)
        want = found().localCheckpoint()
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    same(found(), want)


class Frame:
    """A table in this process that takes the place of a DataFrame."""

    def __init__(self, table):
        self.table, self.sparkSession, self.sparkContext = table, self, self

    def toArrow(self):
        return self.table

    def broadcast(self, value):
        return type("Shipped", (), {"value": value})

    def mapInArrow(self, step, schema):
        return pa.Table.from_batches(list(step(iter(self.table.to_batches(1000)))))


def vectors(name, x):
    return Frame(pa.table({name: pa.array(range(len(x)), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))}))


def test_nearest_vectors_hold_no_table_of_all_questions():
    made = np.random.default_rng(4)
    x, y = made.standard_normal((4000, 8)), made.standard_normal((3000, 8))
    y[5], y[6:40], y[50, 2], x[3, 1] = x[7], y[5], np.nan, np.nan
    asked, known = vectors("query_id", x), vectors("chunk_id", y)
    tracemalloc.start()
    got = vector._nearest_of(asked, known, 3).to_pandas().sort_values(["query_id", "distance", "chunk_id"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    distance = vector._squares(x, y)
    order = np.lexsort((np.broadcast_to(np.arange(3000), distance.shape), distance))[:, :3]
    assert (got["chunk_id"].to_numpy().reshape(-1, 3) == order).all() and len(got) == 12000
    assert np.array_equal(got["distance"].to_numpy().reshape(-1, 3), np.take_along_axis(distance, order, 1), equal_nan=True)


def asked_of_an_index(spark, docs, per_block, path):
    """Of a saved index: its answers, those of plain BM25, and the bytes shuffled for its own."""
    words = lambda column: F.split(column, " ")
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 1} w0 w{3 * i}") for i in range(20)] + [(90, "none"), (91, None)], "query_id long, question string")
    plain = lexical.top_k(lexical.bm25_scores(docs.filter("chunk_id IS NOT NULL"), asked, words("text"), words("question")), 5)
    before = shuffled(spark)
    index = pruned.save(docs, words("text"), path, per_block=per_block)
    got = sorted(tuple(r) for r in pruned.top_k(index, asked, words("question"), 5).select("query_id", "chunk_id", "score", "rank").collect())
    return got, shuffled(spark) - before, plain


def texts_of_words(n):
    made = random.Random(7)
    return [(i, " ".join(f"w{min(int(made.expovariate(0.05)), 99)}" for _ in range(made.randint(1, 60)))) for i in range(n)]


def test_a_saved_index_shuffles_terms_and_not_postings(spark, tmp_path):
    sizes = []
    for n in (1000, 8000):
        docs = spark.createDataFrame(texts_of_words(n), "chunk_id long, text string").coalesce(2)
        got, bytes_, plain = asked_of_an_index(spark, docs, 16, str(tmp_path / f"i{n}"))
        assert got == sorted(tuple(r) for r in plain.select("query_id", "chunk_id", "score", "rank").collect()) and len(got) == 100
        sizes.append(bytes_)
    assert sizes[1] < 2 * sizes[0]


def test_a_saved_index_in_small_parts(spark, tmp_path, monkeypatch):
    rows = texts_of_words(300) + [(300, None), (301, "w1"), (302, "w1")]
    docs = spark.createDataFrame(rows, "chunk_id long, text string").coalesce(3).cache()
    want, _, plain = asked_of_an_index(spark, docs, 16, str(tmp_path / "whole"))
    assert want == sorted(tuple(r) for r in plain.select("query_id", "chunk_id", "score", "rank").collect())
    for name, value in {"TOKENS": 50, "TILE": 3, "CELLS": 40, "ENTRIES": 30}.items():
        monkeypatch.setattr(pruned, name, value)
    assert asked_of_an_index(spark, docs, 3, str(tmp_path / "small"))[0] == want
    monkeypatch.setattr(lexical, "MOST_TERMS", 2)
    assert asked_of_an_index(spark, docs, 7, str(tmp_path / "parts"))[0] == want
    monkeypatch.setattr(lexical, "MOST_BLOCKS", 1)
    assert asked_of_an_index(spark, docs, 7, str(tmp_path / "joined"))[0] == want
    named = docs.withColumn("chunk_id", F.format_string("%04d", "chunk_id"))
    assert [(q, int(c), s, r) for q, c, s, r in asked_of_an_index(spark, named, 7, str(tmp_path / "named"))[0]] == want


def test_a_text_without_an_id_counts_and_is_no_hit(spark, tmp_path):
    rows = texts_of_words(200)
    docs = spark.createDataFrame([(None if i % 10 == 0 else i, t) for i, t in rows], "chunk_id long, text string")
    whole = spark.createDataFrame(rows, "chunk_id long, text string")
    got, _, _ = asked_of_an_index(spark, docs, 16, str(tmp_path / "index"))
    scores = lexical.bm25_scores(whole, spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 1} w0 w{3 * i}") for i in range(20)], "query_id long, question string"), F.split("text", " "), F.split("question", " "))
    assert got == sorted(tuple(r) for r in lexical.top_k(scores.filter("chunk_id % 10 <> 0"), 5).select("query_id", "chunk_id", "score", "rank").collect())
