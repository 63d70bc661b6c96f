"""Operators 2 and 3 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import embeddings, jaccard, queries
from marlstone.llm.components import connected_components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    ids = sorted(sets)
    edges = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                k = len(x & y)
                if 100 * k >= 75 * (len(x) + len(y) - k):
                    edges.append((a, b))
    return {d: (len(sets[d]), c) for d, c in components(ids, edges).items()}


def variants(seed=0):
    """Groups of near copies around the threshold, of every size, and texts that share a long passage."""
    rng = np.random.default_rng(seed)
    word = lambda: "w%d" % rng.integers(5000)
    passage = [word() for _ in range(80)]
    texts = {}
    for size in (3, 5, 6, 7, 8, 10, 14, 20, 30, 60, 120, 300):
        base = [word() for _ in range(size)]
        for _ in range(14):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + max(1, size // 25)))):
                copy[int(rng.integers(len(copy)))] = word()
            if rng.random() < 0.3:
                copy = copy[: max(1, len(copy) - int(rng.integers(0, 1 + size // 10)))]
            texts[len(texts)] = " ".join(copy)
    for _ in range(40):
        texts[len(texts)] = " ".join(passage + [word() for _ in range(int(rng.integers(5, 40)))])
    return texts


@pytest.mark.parametrize("small_group", [8, 2])
def test_op2_on_variants(spark, monkeypatch, small_group):
    monkeypatch.setattr(jaccard, "SMALL_GROUP", small_group)
    texts = variants()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("place", [1, 5, 12])
def test_op2_star_in_one_batch(spark, place):
    base = ["w%d" % i for i in range(50)]
    rows = [" ".join(base[:i] + ["x%d" % i] + base[i + 1 :]) for i in range(4, 44, 2)]
    rows.insert(place - 1, " ".join(base))
    texts = dict(enumerate(rows))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(texts) and {c for _, c in got.values()} == {0}


def test_op2_on_documents(spark, sf_dir, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_jaccard_join(spark, sf_dir).collect()}
    assert got == brute({r.doc_id: r.text for r in documents.collect()})


def test_op2_odd_rows(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(None, "the cat sat on the mat and the dog sat on the log"), (9, "THE cat sat on the mat and the dog sat on the log")], "doc_id long, text string")
    out = jaccard.near_duplicates(odd_docs.select("doc_id", "text").unionByName(more)).collect()
    assert len(out) == 10
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (0, 4) and by[9][1] == 1 and by[None][1] is None and by[6][1] == 6
    assert jaccard.near_duplicates(odd_docs).count() == 8 and jaccard.near_duplicates(no_docs).count() == 0
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_op2_one_id_of_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (6, b + "x"), (7, a + "x"), (8, "something else altogether that is said once"), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):
        got = sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect())
        assert got == [(5, 5), (5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]
    kept = sorted((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect())
    assert kept == sorted([(5, a), (5, b), rows[4]])


def test_linked_sets_share_a_segment_that_fits():
    rng = np.random.default_rng(3)
    allocation = jaccard.allocate({}, {5: 0.9})
    for _ in range(1500):
        n = int(rng.choice([3, 4, 5, 6, 8, 11, 12, 23, 24, 47, 48, 95, 96, 300, 800]))
        base = rng.integers(1, 2**63, n, dtype=np.uint64)
        other = np.concatenate([rng.choice(base, n - int(rng.integers(0, n // 7 + 1)), replace=False), rng.integers(1, 2**63, int(rng.integers(0, n // 7 + 1)), dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        k = len(np.intersect1d(a, b))
        if len(b) < 3 or 100 * k < 75 * (len(a) + len(b) - k) or k == len(a) == len(b):
            continue
        flat, sizes = np.concatenate([a, b]), np.array([len(a), len(b)])
        rarity = np.where(np.isin(flat, base[: n // 2]), 50, 0)
        doc, sig, rank = jaccard.signatures(flat, sizes, rarity, allocation)
        x, y = ({s: r for s, r in zip(sig[doc == i], rank[doc == i], strict=True)} for i in (0, 1))
        assert any(jaccard.fits(sizes[0], x[s], sizes[1], y[s]) for s in x.keys() & y.keys())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)] + [(7, 3), (3, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1300), 1000)}


def cosine_links(rows):
    good = []
    for v, e, label in rows:
        if v is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            x = np.array(e, np.float32).astype(float)
            good.append((v, x / np.sqrt((x**2).sum()), label))
    edges = [(a[0], b[0]) for i, a in enumerate(good) for b in good[i + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.98]
    return edges


def test_op3(spark, sf_dir):
    rng = np.random.default_rng(1)
    rows = []
    for label in range(3):
        for _ in range(12):
            centre = rng.normal(size=64)
            for _ in range(int(rng.integers(1, 14))):
                rows.append((len(rows), (centre + rng.normal(size=64) * rng.choice([0.02, 0.12, 0.15])).astype(np.float32).tolist(), label))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 1), (902, None, 0), (903, [0.0] * 64, 0), (904, [float("nan")] * 64, 0), (905, [None] * 64, 0), (906, rows[0][1], None), (907, [], 0), (908, rows[0][1][:32], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x")).withColumn("copies", F.lit(1))
    out = {r.vec_id: r for r in embeddings.near_duplicates(df, block=16).collect()}
    edges = cosine_links(rows)
    expected = components([r[0] for r in rows], edges)
    assert len(out) == len(rows) and {v: r.component_id for v, r in out.items()} == expected
    assert all(out[v].n_links == sum(v in e for e in edges) and out[v].kept == (expected[v] == v) for v in out)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    twice = embeddings.near_duplicates(df.unionByName(df)).collect()
    assert len(twice) == 2 * len(rows) and all(r.n_links == out[r.vec_id].n_links for r in twice)


def test_op3_on_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    edges = cosine_links(rows)
    expected = components([r[0] for r in rows], edges)
    out = queries.op3_embedding_dedup(spark, sf_dir).collect()
    assert {r.vec_id: r.component_id for r in out} == expected and sum(r.n_links for r in out) == 2 * len(edges)


def test_extreme_finite_vectors_link_and_cost_others_nothing(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (4, [1e-170, 1e-170], 0), (5, [1e200, 1.001e200], 0), (6, [5e-324, 5e-324], 0), (7, [1e308, -1e308], 0), (8, [0.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 4: (2, 4), 5: (2, 4), 6: (2, 4), 7: (0, 7), 8: (0, 8)}
