"""Grounding over rows against plain Python over whole contexts."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.operators import grounding, validate
from marlstone.plans import answering
from marlstone.sources import tables

PATTERNS, INDICATORS, DELIMITERS = answering.FACT_PATTERNS, answering.FACT_INDICATORS, answering.DELIMITERS


def facts(text):
    found = list(dict.fromkeys(m for p in PATTERNS for m in re.findall(p, text or "")))
    return found + [s.strip() for s in re.split(f"[{DELIMITERS}]", text or "") if len(s.strip()) > 5 and re.search(INDICATORS, s)]


def words(fact):
    return {w for w in re.findall(r"[^\W_]+", fact.lower()) if len(w) > 1}


def backed(fact, known):
    own = words(fact)
    return fact in known or any(difflib.SequenceMatcher(None, fact, k).ratio() >= 0.6 or len(own & words(k)) >= 0.6 * len(own) for k in known)


def brute(said, turns):
    context = {}
    for g, place, text in sorted(turns, key=lambda r: (r[0], r[1])):
        context.setdefault(g, []).append(text or "")
    known = {g: set(facts("\n".join(c))) for g, c in context.items()}
    return sorted((a, len(f), sum(backed(x, known.get(g, set())) for x in f)) for a, g, _, answer in said for f in [facts(answer)])


def support(spark, said, turns):
    s = spark.createDataFrame(said, "answer_id long, group long, question string, answer string").withColumn("fact", F.lit("x"))
    t = spark.createDataFrame(turns, "group long, place long, text string").withColumn("item", F.lit("x"))
    got = grounding.support(s, t, PATTERNS, INDICATORS, DELIMITERS).select("answer_id", "n_facts", "n_supported")
    return sorted(tuple(r) for r in got.collect())


def test_support_of_the_whole_table(spark, sf_dir):
    said, turns = (sorted(map(tuple, df.collect()), key=repr) for df in tables.answer_turns(spark, sf_dir))
    said = [(a, g, q, x) for g, a, q, x in said] if isinstance(said[0][2], str) and said[0][0] < said[0][1] else said
    s, t = tables.answer_turns(spark, sf_dir)
    rows = [tuple(r) for r in s.select("answer_id", "group", "question", "answer").collect()]
    got = sorted(tuple(r) for r in grounding.support(s, t, PATTERNS, INDICATORS, DELIMITERS).select("answer_id", "n_facts", "n_supported").collect())
    assert got == brute(rows, [tuple(r) for r in t.select("group", "place", "text").collect()]) and got


@pytest.mark.parametrize("block", [3, 2048])
def test_support_with_near_facts_and_one_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(grounding, "BLOCK", block)
    made = random.Random(4)
    base = [f"the station {i} near thing number {made.randint(10, 99)} was built" for i in range(12)] + ["nothing", "12", "12 things", "Station", "a@b"]

    def bent(text):
        return "".join(c for c in text if made.random() > 0.15) if made.random() < 0.6 else " ".join(made.sample(text.split(), len(text.split())))

    turns = [(g, p, ".\n".join(made.choice(base) for _ in range(3))) for g in (1, 1, 1, 2, 3) for p in range(6)] + [(4, 0, None), (4, 1, ""), (5, 0, "no fact")]
    said = [(i, made.choice([1, 1, 1, 2, 3, 4, 5, 6]), "q", ". ".join(bent(made.choice(base)) for _ in range(3))) for i in range(60)] + [(90, 1, None, None), (91, 1, "q", ""), (92, 1, "q", turns[0][2] + ". " + turns[0][2])]
    want = brute(said, turns)
    assert support(spark, said, turns) == want
    assert {0 < k < n for _, n, k in want} == {True, False}


def test_bounds_are_bounds():
    made = random.Random(7)
    for _ in range(500):
        a, b = ("".join(made.choice("abcd ") for _ in range(made.randint(0, 12))) for _ in range(2))
        matched = sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert matched <= grounding.subsequence(a, b) == table[-1][-1]


def test_shares_equal_those_of_joined_contexts(spark):
    said = [(1, 1, "q", "a b c, B"), (2, 1, "q", ""), (3, 2, "q", "x y"), (4, 2, None, None), (5, 9, "q", "a")]
    turns = [(1, 0, "a b"), (1, 1, "!"), (1, 2, "c a"), (2, 0, None), (2, 1, "y x")]
    s = spark.createDataFrame(said, "answer_id long, group long, question string, answer string")
    t = spark.createDataFrame(turns, "group long, place long, text string")
    whole = {1: "a b\n!\nc a", 2: "\ny x", 9: ""}
    joined = spark.createDataFrame([(a, x or "", whole[g]) for a, g, _, x in said], "answer_id long, answer string, context string")
    for part, plain in ((grounding.shared_tokens, validate.unigram_overlap), (grounding.shared_bigrams, validate.bigram_overlap), (grounding.shared_characters, validate.character_overlap)):
        want = joined.select("answer_id", F.round(plain(F.col("answer"), F.col("context")), 6))
        assert sorted(map(tuple, part(s, t).collect())) == sorted(map(tuple, want.collect()))


def test_failed_checks_lower_the_confidence(spark):
    said = [(1, 1, "station built when", "the station was built in 1904 as planned"), (2, 1, "station built when", "the station was built in 1905 as planned"), (3, 1, "station built when", "short"), (4, 1, "station built when", "it is not known that the station was built here")]
    turns = [(1, 0, "the station was built in 1904 as planned"), (1, 1, "it is known that the station is here")]
    s, t = spark.createDataFrame(said, "answer_id long, group long, question string, answer string"), spark.createDataFrame(turns, "group long, place long, text string")
    plain = grounding.validate(s, t, PATTERNS, INDICATORS, DELIMITERS).cache()
    got = {r.answer_id: r for r in grounding.enhance(plain, s, t, (("not known", "known"),), ("[0-9]{4}",), ("unknown",)).collect()}
    before = {r.answer_id: r.confidence for r in plain.collect()}
    assert (got[1].contradicts, got[1].times_agree, got[1].complete) == (False, True, True) and got[1].confidence == before[1]
    assert not got[2].times_agree and got[2].confidence == round(before[2] * 0.8, 6)
    assert not got[3].complete and got[4].contradicts
    assert grounding.validate(s.limit(0), t, PATTERNS, INDICATORS, DELIMITERS).count() == 0
