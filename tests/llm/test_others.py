"""Operators 7, 9 and 10, and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import chat, hmm, queries, warc
from marlstone.llm import spans as S


def test_op7_reads_back(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    said = "\\### Assistant: </turn> ok"
    by = {-7: [(0, "user", said), (1, "assistant", said)]}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    out = {r.conv_id: r for r in queries.op7_chat_format(spark, sf_dir).collect()}
    assert out.keys() == by.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256, out[c].loss_chars, out[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))


def test_op7_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "\\\\</turn>\n</turn>\n### x: y"), (1, 1, None, "\\\\</turn>\n</turn>\n### x: y"), (None, None, "us:er\\", "😀"), (2, 5, "assistant", ""), (3, 0, "user", "z" * 100000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1)).withColumn("node", F.lit("n"))
    out = chat.format_conversations(df).withColumn("turns", chat.read_back(F.col("formatted"), F.col("spans"))).collect()
    got = {r.conv_id: [(t.role, t.text, t.under) for t in r.turns] for r in out}
    odd = "\\\\</turn>\n</turn>\n### x: y"
    assert got == {1: [("user", "", ""), ("", odd, odd), ("", odd, odd)], None: [("us:er\\", "😀", "😀")], 2: [("assistant", "", "")], 3: [("user", "z" * 100000,) * 1 + ("z" * 100000,)]}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_op7_best_branch(spark):
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 0.5), ("t", 4, 3, 5.0), ("t", 5, 2, 0.1), ("u", 1, 99, 0.0), ("v", 1, 2, 1.0), ("v", 2, 1, 1.0)]
    rows += [("w", i, i - 1 if i else None, 0.0) for i in range(70)]
    paths = chat.chosen_paths(spark.createDataFrame(rows, "tree string, node long, parent long, score double"))
    got = {}
    for r in paths.orderBy("tree", "depth").collect():
        got.setdefault(r.tree, []).append(r.node)
    assert got == {"t": [1, 3, 4], "u": [1], "w": list(range(70))}
    second = chat.chosen_paths(spark.createDataFrame(rows, "tree string, node long, parent long, score double"), 2).filter("tree = 't' and branch = 2")
    assert [r.node for r in second.orderBy("depth").collect()] == [1, 2, 5]


def test_op9_finds_the_damage(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = {(r.page_id, r.status) for r in queries.op9_merkle_audit(spark, sf_dir).collect()}
    ids = [r.page_id for r in pages.collect()]
    expected = {(i, "missing") for i in ids if i % 89 == 7} | {(i, "corrupt") for i in ids if i % 97 == 5 and i % 89 != 7} | {(-1 - i, "extra") for i in ids if i % 101 == 11}
    # Records behind a lost, longer or added one have moved within their file.
    touched, after = set(), {}
    for i in sorted(ids):
        after[i] = i // 1000 in touched
        touched |= {i // 1000} if i % 89 == 7 or i % 97 == 5 else set()
    moved = {(i, "moved") for i in ids if after[i] and i % 89 != 7 and i % 97 != 5}
    assert out == expected | moved
    assert warc.audit(pages, pages).count() == 0


def test_op9_odd_rows(spark):
    schema = "page_id long, url string, html string"
    a = spark.createDataFrame([(1, None, None), (2, "u", "x"), (2, "u", "x"), (None, "u", "y"), (-5, "n", "é" * 1000), (5000, "f", "z")], schema).withColumn("hash", F.lit(1))
    b = spark.createDataFrame([(1, None, None), (2, "u", "x"), (-5, "n", "é" * 999), (5000, "f", "z")], schema)
    assert {(r.page_id, r.status) for r in warc.audit(a, b).collect()} == {(2, "corrupt"), (-5, "corrupt")}
    assert {(r.page_id, r.status) for r in warc.audit(b, a.limit(0)).collect()} == {(i, "missing") for i in (1, 2, -5, 5000)}
    assert {(r.page_id, r.status) for r in warc.audit(a.limit(0), b).collect()} == {(i, "extra") for i in (1, 2, -5, 5000)}
    assert warc.audit(a.limit(0), a.limit(0)).count() == 0


def test_warc_moved_records(spark):
    rows = [(i, "u%d" % i, "x" * (i % 7)) for i in range(990, 1030)]
    a = spark.createDataFrame(rows, "page_id long, url string, html string")
    longer = spark.createDataFrame([(i, u, h + "!" if i == 1005 else h) for i, u, h in rows], a.schema)
    found = {r.page_id: (r.status, r.found_offset - r.offset) for r in warc.audit(a, longer).collect()}
    # Only the rest of the file behind the changed record moves: the file before it stays as it is.
    assert found == {1005: ("corrupt", 0), **{i: ("moved", 1) for i in range(1006, 1030)}}
    lost = {r.page_id: r.status for r in warc.audit(a, a.filter("page_id <> 995")).collect()}
    assert lost == {995: "missing", **{i: "moved" for i in range(996, 1000)}}


def lower(text):
    return (text or "").encode().lower().split()


def test_op10_counts_and_base(spark, odd_docs, no_docs):
    out = hmm.score_documents(odd_docs, iterations=1).collect()
    rows = odd_docs.collect()
    training = [lower(r.text) + [None] for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    c = Counter(w for t in training for w in t)
    n, v = sum(c.values()), len(c)
    texts = {r.doc_id: lower(r.text) + [None] for r in rows}
    assert len(out) == 8
    for r in out:
        own = texts[r.doc_id]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0 and math.isfinite(r.score)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    assert hmm.score_documents(no_docs, iterations=1).count() == 0


def small_model(k=2):
    rng = np.random.default_rng(4)
    emit = rng.random((hmm.CLASSES + 1, k))
    step = rng.random((k, k))
    start = rng.random(k)
    return hmm.Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def paths(model, seq):
    for states in product(range(len(model.start)), repeat=len(seq)):
        p = model.start[states[0]] * model.emit[seq[0], states[0]]
        for a, b, c in zip(states, states[1:], seq[1:], strict=False):
            p *= model.step[a, b] * model.emit[c, b]
        yield states, p


def test_forward_and_expectations_match_enumeration():
    model = small_model()
    texts = [[3, 5, 3], [], [7], [1, 2, 3, 4, 5]]
    classes, counts = np.array([c for t in texts for c in t], np.int32), np.array([len(t) for t in texts])
    got = hmm.log_likelihood(model, classes, counts)
    emissions, steps, first = np.zeros((hmm.CLASSES + 1, 2)), np.zeros((2, 2)), np.zeros(2)
    for t, value in zip(texts, got, strict=True):
        seq = [*t, hmm.CLASSES]
        total = sum(p for _, p in paths(model, seq))
        assert abs(value - math.log(total)) < 1e-9
        for states, p in paths(model, seq):
            first[states[0]] += p / total
            for s, c in zip(states, seq, strict=True):
                emissions[c, s] += p / total
            for a, b in zip(states, states[1:], strict=False):
                steps[a, b] += p / total
    for kept in (1, 4, 100):
        e, s, f = hmm.expectations(model, *hmm._with_ends(classes, counts), kept)
        assert np.allclose(e, emissions, atol=1e-4) and np.allclose(s, steps, atol=1e-4) and np.allclose(f, first, atol=1e-4)


def test_training_reads_whole_texts(spark):
    """One text of many words: every transition counts, the model is that of one sequence."""
    words = ["abcd"[(i // 50) % 4] + str(i % 3) for i in range(3000)]
    docs = spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string")
    assert zlib.crc32(b"0") % 5 != 1
    rows = hmm._class_rows(docs)
    (sequence,) = [np.frombuffer(r.classes, "<u2") for r in rows.collect()]
    share = np.bincount(sequence, minlength=hmm.CLASSES + 1) + 0.1
    model = hmm.first_model(share / share.sum())
    _, steps, first = hmm._gather_expectations(rows, model)
    assert len(sequence) == 3001 and abs(steps.sum() - 3000) < 0.1 and abs(first.sum() - 1) < 1e-5


def brute_scores(model, counts, texts):
    """log10 probabilities of texts, word by word."""
    every = sorted({w for t in texts for w in t} | counts.keys())
    ends = np.cumsum([len(w) for w in every])
    hashes = S.Slice(0, np.frombuffer(b"".join(every), np.uint8), np.array([0, ends[-1]])).hashes(np.concatenate([[0], ends[:-1]]), ends)
    key = dict(zip(every, hmm._classes(hashes).tolist(), strict=True))
    by_class, kinds = Counter(), Counter()
    for w, c in counts.items():
        by_class[key[w]] += c
        kinds[key[w]] += 1
    for words in texts:
        alpha, total = model.start, 0.0
        for t, c in enumerate([*(key[w] for w in words), hmm.CLASSES]):
            alpha = (alpha if t == 0 else alpha @ model.step) * model.emit[c]
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        yield total + sum(math.log10((counts[w] + 0.5) / (by_class[key[w]] + 0.5 * (kinds[key[w]] + 1))) for w in words)


def test_op10_score_is_the_model_s_probability(spark, documents, monkeypatch):
    docs = documents.select("doc_id", F.substring("text", 1, 3000).alias("text"))
    rows = docs.collect()
    kept = {}
    honest = hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a, **k: kept.setdefault("model", honest(*a, **k)))
    out = {r.doc_id: r for r in hmm.score_documents(docs, iterations=2, hot_words=50).collect()}
    counts = Counter(w for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for w in lower(r.text))
    for r, expected in zip(rows, brute_scores(kept["model"], counts, [lower(r.text) for r in rows]), strict=True):
        assert abs(out[r.doc_id].score - expected) < 1e-6 * max(1, abs(expected))


def test_op10_gains_on_the_unigram_base(spark, documents):
    out = hmm.score_documents(documents, iterations=4)
    r = out.filter("not held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b
    few = hmm.score_documents(documents, iterations=4, hot_words=100).select("doc_id", F.col("score").alias("x"), F.col("base_score").alias("y"))
    joined = out.join(few, "doc_id").filter("abs(score - x) > 1e-6 * abs(score) or abs(base_score - y) > 1e-6 * abs(base_score)")
    assert joined.count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns and docs.count() <= left
        left = docs.count()
    kept = {r.doc_id for r in docs.collect()}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == kept and 0 < len(kept) < 200
