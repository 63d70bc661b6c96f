"""Each stage of the pipeline against plain Python on odd rows: null, empty and long texts, ties, repeated rows, rows without an id."""

import itertools
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import quality, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_passes(text):
    w = words(text)
    spots = defaultdict(list)
    for i in range(len(w) - 7):
        spots[tuple(w[i : i + 8])].append(i)
    repeated = {i + k for places in spots.values() if len(places) > 1 for i in places for k in range(8)}
    return len(w) >= 20 and 100 * len(repeated) <= 30 * len(w)


def shingles(text):
    w = words(text.translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def one_of_each_group(rows):
    """Rows that stay: the least id of each linked group once, and whatever has no id or no word."""
    out = [r for r in rows if r[0] is None or not words(r[1])]
    nodes = sorted({r for r in rows if r[0] is not None and words(r[1])})
    sets, parent = [shingles(t) for _, t in nodes], list(range(len(nodes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(nodes)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return out + [nodes[i] for i in range(len(nodes)) if find(i) == i]


@pytest.fixture(scope="module")
def mixed(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang").collect()]
    some = next(t for _, t, _ in rows if base_passes(t) and len(words(t)) > 100)
    own = " ".join(f"word{i}" for i in range(60))
    rows += [(9001, None, "en"), (9002, "", "en"), (9003, " \n\t ", None), (9004, some + " more", "en"), (9005, some, "en"), (9005, some, "en"), (9006, own, "xx"), (9006, own, "xx"), (None, own, "xx"), (None, own + " end", None)]
    rows += [(9007, " ".join(f"w{i}" for i in range(20000)), "en"), (9008, own.replace("word59", "other"), "xx"), (8999, own.upper(), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit("clash"), "kept": F.lit("clash"), "node": F.lit(1), "h": F.lit(2)})
    return docs.cache()


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_equal_plain_python(spark, mixed, labels, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    one = stages["quality rules"](spark, mixed, sf_dir).cache()
    verdict = {(r.doc_id, r.text): r.kept for r in quality.judge(mixed, labels).join(mixed.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i"))).select("doc_id", "text", "kept").collect() if r.doc_id is not None and r.doc_id != 9006}
    got = pairs(one)
    assert all(base_passes(t) for _, t in got) and one.columns == mixed.columns
    for (i, t), n in pairs(mixed).items():
        if (i, t) in verdict:
            assert got[i, t] == (n if verdict[i, t] else 0), i
        elif not base_passes(t):
            assert (i, t) not in got

    machine = toxicity.train(one, labels)
    clean = pairs(one.select("doc_id", "text", toxicity.score(one, machine).alias("p")).filter(F.col("p") < toxicity.THRESHOLD))
    two = stages["toxicity"](spark, one, sf_dir).cache()
    assert pairs(two) == clean and two.columns == mixed.columns

    three = stages["n-gram Jaccard join"](spark, two, sf_dir).cache()
    assert pairs(three) == Counter(one_of_each_group(list(pairs(two).elements()))) and three.columns == mixed.columns

    four = stages["best-fit packing"](spark, three, sf_dir).collect()
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for (i, t), n in pairs(three).items():
        want[i] += n * (len(library.encode(t or "", add_special_tokens=False).ids) + 1)
    found, sequences = Counter(), defaultdict(list)
    for r in four:
        found[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert found == want
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024


def test_an_empty_table_passes_all_stages(spark, mixed, sf_dir):
    docs = mixed.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
