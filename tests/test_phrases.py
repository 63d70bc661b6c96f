"""Phrases from the index against counting in the texts."""

import random

from marlstone.operators import phrases


def brute(docs, listed):
    out = []
    for p in sorted(set(x for x in listed if x and x.strip(" "))):
        for d, t in docs:
            if t and (n := t.count(p)):
                out.append((p, d, n, round(n / (len(t) + 1) * 1000, 6)))
    return sorted(out)


def test_phrases_of_all_kinds(spark, tmp_path):
    made = random.Random(3)
    docs = [(i, "".join(made.choice(["a", "aa", " ", "  ", "of", "the", "\n", "é", "b"]) for _ in range(made.randint(0, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "of the of the"), (203, "proof there"), (204, "a a a a"), (205, ("x " * 3000 + "of the end")), (206, " lead"), (207, "trail ")]
    listed = ["of the", "a", "aa", "a a", " lead", "trail ", "of  the", "the of", "é", "x x", "of the end", "f the e", "aaaa", "", " ", None, "of the", "nowhere", " of "]
    index = phrases.save(spark.createDataFrame(docs, "chunk_id long, text string"), str(tmp_path / "phrases"))
    asked = spark.createDataFrame([(p,) for p in listed], "phrase string")
    got = phrases.matches(phrases.load(spark, str(tmp_path / "phrases")), asked).select("phrase", "chunk_id", "matches", "score")
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, listed)


def test_phrases_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, text string")
    asked = spark.createDataFrame([("a b",)], "phrase string")
    assert phrases.matches(phrases.save(none, str(tmp_path / "none")), asked).count() == 0
    some = phrases.save(spark.createDataFrame([(1, "a b")], "chunk_id long, text string"), str(tmp_path / "some"))
    assert phrases.matches(some, asked.limit(0)).count() == 0
