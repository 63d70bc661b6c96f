"""The learnt dictionary and the best path against plain Python."""

import itertools
import math
import random
import re
from collections import Counter

import pytest

from marlstone.operators import segment

SCRIPT = "[a-zA-Z一-龥]"


@pytest.fixture(scope="module")
def corpus(spark):
    made = random.Random(2)
    words = ["数据", "挖掘", "数据挖掘", "的", "竞赛", "要求", "是", "ab", "Ab", "c", "智能交通"]
    docs = [(i, " ".join("".join(made.choices(words, k=made.randint(1, 6))) for _ in range(8))) for i in range(60)] + [(90, None), (91, ""), (92, "12 ...")]
    return docs, spark.createDataFrame(docs, "chunk_id long, text string")


def brute_dictionary(docs, most, least, cohesion, freedom):
    found = Counter(r for _, t in docs for r in re.findall(SCRIPT + "+", t or ""))
    grams, before, after = Counter(), {}, {}
    for run, n in found.items():
        for i, j in itertools.combinations(range(len(run) + 1), 2):
            if j - i <= most:
                g = run[i:j]
                grams[g] += n
                before.setdefault(g, Counter())[run[i - 1] if i else ""] += n
                after.setdefault(g, Counter())[run[j] if j < len(run) else ""] += n
    total = sum(n for g, n in grams.items() if len(g) == 1)
    entropy = lambda c: -sum(k / sum(c.values()) * math.log(k / sum(c.values())) for k in c.values())
    out = {}
    for g, n in grams.items():
        whole = len(g) == 1 or (n >= least and min(n * total / grams[g[:i]] / grams[g[i:]] for i in range(1, len(g))) >= cohesion and min(entropy(before[g]), entropy(after[g])) >= freedom)
        if whole:
            out[g] = (n, round(math.log(n / total) * 1_000_000))
    return found, out


def test_dictionary(corpus):
    docs, df = corpus
    found, want = brute_dictionary(docs, 4, 5, 2.0, 0.5)
    counted = segment.runs(df, SCRIPT)
    assert {r.run: r.n for r in counted.collect()} == found
    got = {r.word: (r.n, r.weight) for r in segment.learn(counted, 4, 5, 2.0, 0.5).collect()}
    assert got == want and any(len(w) > 1 for w in want) and {"a", "A"} <= set(want)


def test_best_paths(spark, corpus):
    docs, df = corpus
    found, dictionary = brute_dictionary(docs, 4, 5, 2.0, 0.5)
    table = spark.createDataFrame([(w, n, weight) for w, (n, weight) in dictionary.items()], "word string, n long, weight long")
    short = [r for r in found if len(r) <= 9]
    got = {r.run: r.words for r in segment.segment(spark.createDataFrame([(r,) for r in found], "run string"), table).collect()}
    assert set(got) == set(found) and all("".join(w) == r for r, w in got.items())
    for run in short:
        best = None
        for cuts in itertools.product([0, 1], repeat=len(run) - 1):
            ends = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
            words = [run[a:b] for a, b in itertools.pairwise(ends)]
            if all(w in dictionary for w in words):
                key = (sum(dictionary[w][1] for w in words), [len(w) for w in reversed(words)])
                best = max(best, (key, words)) if best else (key, words)
        assert got[run] == best[1], run


def test_nothing(spark, corpus):
    none = segment.runs(corpus[1].limit(0), SCRIPT)
    assert segment.learn(none).count() == 0 and segment.segment(none.select("run"), segment.learn(none)).count() == 0
