"""Sharding, filter audit and spelling variants against brute force on small fixtures."""

import itertools
import math
import random
import zlib
from collections import Counter

import pytest
from oracle import connect, rows_of, sql_rows
from pyspark.sql import functions as F

from marlstone.llm import filter_audit, queries, sharding, spelling


@pytest.mark.parametrize("name", ["op11_rendezvous", "op12_filter_audit", "op13_spelling_variants"])
def test_same_rows_as_sql(spark, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == sql_rows(connect(sf_dir), queries.ORACLE_SQL[name])


def test_only_the_new_shard_takes_rows(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.place(docs, [1.0] * 6).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {6} and abs(len(moved) - 20000 / 7) < 300
    again = {r.doc_id: r.shard for r in sharding.place(docs, [1.0] * 7).collect()}
    assert all(again[r.doc_id] == r.grown_shard for r in rows)


def test_weights_share_out_rows_and_a_heavier_shard_only_gains(spark):
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    one = sharding.place(docs, [1.0, 2.0, 3.0])
    found = {r.shard: r for r in sharding.balance(one, [1.0, 2.0, 3.0]).collect()}
    assert all(abs(found[i].share - (i + 1) / 6) < 0.01 for i in range(3))
    light, heavy = ({r.doc_id: r.shard for r in sharding.place(docs, [1.0, w, 3.0]).collect()} for w in (2.0, 2.5))
    assert {heavy[i] for i in light if heavy[i] != light[i]} == {1}
    with pytest.raises(ValueError):
        sharding.place(docs, [1.0, 0.0])


def test_slots_are_gapless_over_hot_ids_and_many_parts(spark):
    """A third of the rows have one id, another third one text and no id."""
    n = F.col("id")
    doc_id = F.when(n % 3 == 0, F.lit(7)).when(n % 3 == 1, F.lit(None)).otherwise(n)
    text = F.when(n % 3 == 1, F.lit("same")).otherwise(F.concat(F.lit("t"), n % 11))
    docs = spark.range(3000, numPartitions=7).select(doc_id.cast("long").alias("doc_id"), text.alias("text"))
    rows = sharding.place(docs, [1.0] * 3).collect()
    for shard in range(3):
        own = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size) for r in own]
        assert keys == sorted(keys)
    assert len(rows) == 3000 and len({r.shard for r in rows if r.doc_id == 7}) == 1


def test_odd_rows_shard(spark, odd_docs, no_docs):
    rows = sharding.place(odd_docs, [1.0] * 4).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
    assert next(r for r in rows if r.doc_id == 2)[1:3] == (8, 0)
    assert sharding.place(no_docs, [1.0] * 4).count() == 0
    nameless = odd_docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert len({r.shard for r in sharding.place(nameless, [1.0] * 40).collect()}) > 1


def test_written_shards_hold_whole_records_in_order(spark, documents, tmp_path):
    path = str(tmp_path / "shards")
    sharding.write_shards(documents, [1.0] * 3, path)
    back = spark.read.parquet(path)
    assert sorted(map(repr, back.select(documents.columns).collect())) == sorted(map(repr, documents.collect()))
    placed = {r.doc_id: r.shard for r in sharding.place(documents, [1.0] * 3).collect()}
    assert all(placed[r.doc_id] == r.shard for r in back.select("doc_id", "shard").collect())


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for doc_id, text, source in docs:
        text = text or ""
        words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
        f = set()
        f |= {"A"} if len(words) < 50 else set()
        f |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        f |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
        f |= {"D"} if set(text) & set("#$%&*|") else set()
        f |= {"E"} if doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in docs) else set()
        fails.append((source or "", f, doc_id in good, doc_id in toxic))
    rows = []
    for part in sorted({p for p, *_ in fails}):
        own = [x for x in fails if x[0] == part]
        total, found = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                total[letter] += len(gone)
                failing, only = sum(letter in x[1] for x in own), sum(x[1] == {letter} for x in own)
                found.append((letter, (part, order, step + 1, len(left), len(gone), failing - len(gone), only, sum(x[2] for x in gone), sum(x[3] for x in gone))))
        rows += [(*row, total[letter]) for letter, row in found]
    return sorted(rows)


def test_audit_equals_brute_force_with_hot_copies(spark):
    made = random.Random(3)
    texts = [None, "", "one two", "A B C D E", "word " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)) + " $", "\x1c    x" * 60, "5"]
    docs = [(i if made.random() < 0.9 else None, made.choice(texts) if made.random() < 0.6 else texts[5], made.choice([None, "", "web", "web", "book"])) for i in range(400)]
    docs += docs[:20]
    labels = [(i, made.choice([0, 1, None]), made.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"mask": F.lit(1), "part": F.lit("x"), "digest": F.lit("y"), "first": F.lit(1)})
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)


def test_audit_of_nothing(spark, no_docs, labels):
    assert filter_audit.audit(no_docs, labels).count() == 0


def brute_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        n_near[w] = len(others)
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, n_near[w], words.get(form.get(w))) for w, n in words.items())


@pytest.fixture(scope="module")
def misspelt():
    made, docs = random.Random(5), []
    base = ["aaaaa", "aaaaaa", "aabaa", "water", "wáter", "waters", "house", "mouse", "Éclair", "éclair", "straße", "naïve", "interesting", "z" * 300, "z" * 299]
    for i in range(300):
        words = []
        for _ in range(30):
            w = made.choice(base[: made.randint(1, len(base))])
            if made.random() < 0.3:
                k = made.randrange(len(w))
                w = made.choice([w[:k] + w[k + 1 :], w[:k] + made.choice("abé") + w[k:], w[:k] + made.choice("xyÀ") + w[k + 1 :]])
            words.append(w if made.random() < 0.8 else w.upper())
        docs.append((i if i % 10 else None, made.choice([" ", "-", "×", "0"]).join(words)))
    return [*docs, (5, None), (6, ""), docs[3], docs[3]]


def test_variants_equal_brute_force(spark, misspelt):
    docs = spark.createDataFrame(misspelt, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1), "root": F.lit("r"), "run": F.lit("q")})
    want = brute_variants(misspelt)
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=lambda r: r[0]) == want and any(r[1] and r[1] != r[2] for r in want)


def test_tiles_lose_and_repeat_no_pair(spark, misspelt):
    docs = spark.createDataFrame(misspelt, "doc_id long, text string")
    vocabulary = spelling.words(docs).cache()
    whole = sorted(map(tuple, spelling.near_words(vocabulary).collect()))
    assert sorted(map(tuple, spelling.near_words(vocabulary, block=64, tile=5).collect())) == whole and len(set(whole)) == len(whole)


def test_one_edit_and_bound():
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(words, words):
        n = min(abs(len(a) - len(b)), 2)
        edits = n if n else sum(x != y for x, y in zip(a, b, strict=True))
        want = edits == 1 and (not n or any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b)))))
        assert spelling.one_edit(a, b) == want


def test_long_paths_end_at_their_root(spark):
    n = 40
    pointers = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(n)], "word string, root string")
    assert {r.root for r in spelling.follow(pointers).collect()} == {f"w{n}"}


def test_odd_rows_spell(spark, odd_docs, no_docs):
    rows = {r.word: r for r in spelling.variants(odd_docs).collect()}
    assert all(math.isfinite(r.n) and r.n >= 3 for r in rows.values())
    assert spelling.variants(no_docs).count() == 0
