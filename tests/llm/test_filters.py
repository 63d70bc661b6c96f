"""Operators 1 and 5."""

import re
from collections import Counter

from pyspark.sql import functions as F

from marlstone.llm import quality, queries, toxicity


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(runs), set()
    for i, run in enumerate(runs):
        if times[run] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_op1_base(spark, odd_docs, no_docs, labels, sf_dir, documents):
    for docs, rows in ((odd_docs, quality.judge(odd_docs, labels)), (documents, queries.op1_quality_rules(spark, sf_dir))):
        texts, out = {r.doc_id: r.text for r in docs.collect()}, rows.collect()
        assert len(out) == docs.count()
        for r in out:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
            assert not (r.base_failed and r.kept)
    assert quality.judge(no_docs, labels).count() == 0
    assert quality.judge(odd_docs, labels.limit(0)).filter(~F.col("base_failed")).filter("not kept").count() == 0


def test_bound_is_exact():
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9
    p = quality.upper_bound(3, 50, 0.01)
    below = sum(__import__("math").comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(4))
    assert abs(below - 0.01) < 1e-9 and quality.upper_bound(5, 5, 0.1) == 1.0 and quality.upper_bound(0, 0, 0.1) == 1.0


def brute_kept(rows, labels, risk=quality.RISK, error=quality.ERROR):
    """doc_id -> kept, from the counts, by plain loops; also the certified step of each language."""
    def rates(r):
        over = lambda a, b: round(a / b + 1e-12, 3) if b else 0.0
        return (over(r.n_symbols, r.n_words), over(r.n_dup_lines, r.n_lines), over(r.n_upper, r.n_letters), over(r.n_repeat_next, r.n_words), over(r.n_marked, r.n_words), over(r.word_chars, r.n_words))

    def quantile(values, q):
        place = q * (len(values) - 1)
        low = int(place)
        return values[low] if low + 1 == len(values) else values[low] + (place - low) * (values[low + 1] - values[low])

    good = {d for d, q in labels.items() if q == 1}
    by = {}
    for r in rows:
        if r.doc_id in good and not r.base_failed:
            by.setdefault(r.lang, ({}, {}))[r.side][r.doc_id] = rates(r)
    with_path = [k for k, v in by.items() if v[0]]
    cuts, steps = {}, {}
    for lang in with_path:
        shaping, held = (list(x.values()) for x in by[lang])
        columns = [sorted(c) for c in zip(*shaping, strict=True)]
        path = [[c[-1] * k for c in columns] for k in quality.SLACKS] + [[quantile(c, 1 - t) for c in columns] for t in quality.TAILS]
        for i, setting in enumerate(path):
            rejected = sum(any(x > c for x, c in zip(r, setting, strict=True)) for r in held)
            if quality.upper_bound(rejected, len(held), error / len(with_path)) > risk:
                break
            cuts[lang], steps[lang] = setting, i
    return {r.doc_id: not r.base_failed and not (r.lang in cuts and any(x > c for x, c in zip(rates(r), cuts[r.lang], strict=True))) for r in rows}, steps


def test_op1_kept_is_the_certified_setting(documents, labels):
    marks = {r.doc_id: r.quality for r in labels.collect()}
    for risk in (0.3, 0.1, quality.RISK):
        out = quality.judge(documents, labels, risk=risk).withColumn("side", (F.pmod(F.xxhash64("doc_id"), F.lit(quality.SHAPING)) != 0).cast("int")).collect()
        expected, steps = brute_kept(out, marks, risk)
        assert {r.doc_id: r.kept for r in out} == expected
        assert all(s < len(quality.SLACKS) + len(quality.TAILS) - 1 for s in steps.values())  # the bound stops the path
        assert risk < 0.3 or steps


def test_path_stops_at_the_first_failure(spark):
    rule = quality.Rule("symbols", "n_symbols / n_words")
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "en").otherwise(None).alias("lang"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("rate_symbols"))
    got = {r.stratum: r for r in quality.select_cutoffs(rows, rows, (rule,), 0.02, 0.05).collect()}
    assert set(got) == {"en", None} and all(0.98 < r.cut_symbols < 1 and r.n == 2000 for r in got.values())
    few = quality.select_cutoffs(rows.limit(20), rows.limit(20), (rule,), 0.02, 0.05).collect()
    assert all(r.cut_symbols is None and r.step is None for r in few)
    assert quality.select_cutoffs(rows.limit(0), rows, (rule,)).count() == 0


def test_op1_odd_labels(spark, odd_docs):
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (99, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") < 6, F.col("lang")).otherwise(""))
    rows = quality.judge(docs, odd, risk=0.9).collect()
    assert len(rows) == 8 and {r.lang for r in rows} == {"en", "fr", None, ""} and all(r.kept == (not r.base_failed) for r in rows)


def test_stage_keeps_what_judge_keeps(documents, labels):
    docs = documents.withColumn("n_words", F.lit(1)).withColumn("rate_symbols", F.lit(9.0))
    kept = quality.keep_good(docs, labels, risk=0.2)
    assert kept.columns == docs.columns
    expected = {r.doc_id for r in quality.judge(documents, labels, risk=0.2).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == expected
    assert len(expected) <= quality.judge(documents, labels, risk=1e-9).filter("kept").count()


def toxic_set(spark):
    rows = [(i, f"plain words number{i % 7} about the weather {'you idiots' if i % 5 == 0 else ''} {'idiot proof' if i % 5 == 1 else ''} today", int(i % 5 == 0)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_op5_learns_and_holds_out(spark, odd_docs, no_docs):
    docs, marks = toxic_set(spark)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, marks).collect()}
    held = [r for r in out.values() if r.held_out]
    assert 250 < len(held) < 500 and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    # Labels of held-out rows change nothing.
    flipped = marks.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {k: r.score for k, r in out.items()} == {r.doc_id: r.score for r in toxicity.score_documents(docs, flipped).collect()}
    odd = toxicity.score_documents(odd_docs, marks).collect()
    assert len(odd) == 8 and all(0 <= r.score <= 1 for r in odd) and len({r.score for r in odd if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.score_documents(no_docs, marks).count() == 0
    assert {r.predicted for r in toxicity.score_documents(odd_docs, marks.limit(0)).collect()} == {0}


def test_interactions_are_learned():
    import numpy as np

    rng = np.random.default_rng(2)
    samples, labels = [], []
    for _ in range(2000):
        a, b = rng.random(2) < 0.5
        samples.append(np.array(sorted({1} | ({5} if a else set()) | ({9} if b else set()))))
        labels.append(float(a and b))
    machine = toxicity.fit(samples, np.array(labels), epochs=40)
    ask = lambda *c: float(toxicity._sigmoid(toxicity._raw(machine, np.zeros(len(c), int), np.array(c), 1))[0])
    assert ask(1, 5, 9) > 0.5 > max(ask(1, 5), ask(1, 9), ask(1))


def test_op5_learns_an_insult_beside_a_mention(spark, monkeypatch):
    """An insult with a mention is toxic; two insults or two mentions, or one of them alone, are not: no sum of weights tells these apart."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(4000):
        words = [rng.choice("plain words about weather fields rivers bread songs clouds roads".split()) for _ in range(30)]
        said = rng.sample(["vermin", "leeches", "lowlanders", "islanders"], rng.choice([0, 1, 2, 2]))
        for word in said:
            words.insert(rng.randrange(30), word)
        rows.append((i, " ".join(words), int(len({w.endswith("landers") for w in said}) == 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    wrong = []
    for start in (toxicity.FACTOR_START, 0.0):  # without factors the machine is linear
        monkeypatch.setattr(toxicity, "FACTOR_START", start)
        out = toxicity.score_documents(df.select("doc_id", "text"), df.select("doc_id", "toxic")).join(df, "doc_id").filter("held_out").collect()
        wrong.append(sum(r.predicted != r.toxic for r in out) / len(out))
    assert len(out) > 800 and wrong[0] < 0.01 and wrong[1] > 0.1


def test_op5_score_is_the_machine_s_sum(spark, odd_docs):
    import math

    import numpy as np
    import pyarrow as pa

    from marlstone.llm import spans as S

    rng = np.random.default_rng(1)
    size = 1 << toxicity.BITS
    machine = toxicity.Machine(-0.3, (rng.random(size) * 0.1).astype(np.float32), rng.normal(0, 0.05, (size, toxicity.FACTORS)).astype(np.float32))
    got = {r.doc_id: r.score for r in odd_docs.select("doc_id", toxicity.score(odd_docs, machine).alias("score")).collect()}
    for r in odd_docs.collect():
        (piece,) = S.slices(pa.array([r.text], pa.string()))
        columns = toxicity._terms(piece)[1].tolist()
        assert len(columns) == len(set(columns))
        total = machine.bias + sum(float(machine.w[c]) for c in columns)
        total += sum(float(machine.v[a] @ machine.v[b]) for i, a in enumerate(columns) for b in columns[i + 1 :])
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-total))) < 1e-4


def test_op5_odd_labels(spark, odd_docs):
    odd = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (99, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert len(toxicity.score_documents(odd_docs, odd).collect()) == 8


def test_stage_drops_toxic(spark):
    docs, marks = toxic_set(spark)
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit(1.0)), marks)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {i for i in range(1500) if i % 5}
