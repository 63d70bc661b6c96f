import difflib
import time

import pytest
from pyspark.sql import functions as F

from marlstone.functions import lexicons as L
from marlstone.functions import text as X
from marlstone.operators import chunking, context, diversity, fusion, grounding, incremental, lexical, reports, rerank
from marlstone.sources import pages, tables
from marlstone.streaming import watcher


def one(spark, column, **values):
    names = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_strip_covers_unicode_space(spark):
    assert one(spark, X.strip(F.col("t")), t="　  a b \n\x1f") == "a b"


def test_tokens_take_lexicon_terms_whole(spark):
    tokens = X.tokens(F.col("t"), lexicon=("智能交通信号灯", "交通信号灯"), stopwords=("的",))
    assert one(spark, tokens, t="智能交通信号灯的设计 AI2 x") == ["智能交通信号灯", "的设", "ai2"]
    assert one(spark, X.tokens(F.col("t")), t="") == []


def test_occurrences_do_not_overlap(spark):
    assert one(spark, X.occurrences(F.col("t"), "aa"), t="aaaaa") == 2


def test_bm25_ties_go_to_the_lower_id(spark):
    docs = spark.createDataFrame([(3, "alpha beta"), (1, "alpha beta"), (2, "gamma delta"), (4, "")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "gamma"), (2, "nothing here"), (3, "alpha")], "query_id long, question string")
    top = lexical.top_k(lexical.bm25_scores(docs, asked, X.tokens(F.col("text")), X.tokens(F.col("question"))), 5)
    assert [(r.query_id, r.chunk_id) for r in top.orderBy("query_id", "rank").collect()] == [(1, 2), (3, 1), (3, 3)]


def test_rrf_keeps_worst_rank_and_ignores_channel_order(spark):
    hits = spark.createDataFrame([(1, "v", 7, 1, 0.9), (1, "v", 7, 3, 0.8), (1, "b", 7, 2, 5.0), (1, "b", 8, 1, 6.0)], "query_id long, channel string, key long, rank int, score double")
    a = fusion.reciprocal_rank_fusion(hits, {"v": 0.4, "b": 0.6}).collect()
    b = fusion.reciprocal_rank_fusion(hits.orderBy(F.desc("rank")), {"b": 0.6, "v": 0.4}).collect()
    assert {(r.key, r.rrf_score) for r in a} == {(r.key, r.rrf_score) for r in b}
    assert abs(next(r for r in a if r.key == 7).rrf_score - (0.4 / 63 + 0.6 / 62)) < 1e-9


def test_caps_hold_and_second_pass_fills(spark):
    rows = spark.createDataFrame([(1, i, "s1" if i < 6 else "s2", float(10 - i)) for i in range(8)], "query_id long, chunk_id long, source string, score double")
    taken = diversity.select_diverse(rows, 6, cap=2).collect()
    counts = {s: sum(r.source == s for r in taken) for s in ("s1", "s2")}
    assert counts == {"s1": 3, "s2": 2}
    assert [r.rank for r in sorted(taken, key=lambda r: r.rank)] == [1, 2, 3, 4, 5]


def test_entity_bonus_counts_nested_terms(spark):
    bonus = rerank.entity_bonus(F.col("q"), F.col("c"), L.ENTITIES)
    assert abs(one(spark, bonus, q="智能交通信号灯的设计", c="智能交通信号灯") - (1.8 * 0.1 + 1.7 * 0.1)) < 1e-9


def test_fixed_chunks_cover_the_text(spark):
    texts = [(1, "x" * 1234), (2, ""), (3, "   "), (4, None)]
    chunks = chunking.fixed_chunks(spark.createDataFrame(texts, "doc_id long, text string"), 500, 50).orderBy("doc_id", "chunk_idx").collect()
    assert [(c.doc_id, c.start, len(c.chunk)) for c in chunks] == [(1, 0, 500), (1, 450, 500), (1, 900, 334)]


def test_sections_drop_preamble_and_short_ones(spark):
    text = "preamble\n一、第一节\n" + "a" * 60 + "\n二、短\nb\n【三】\n" + "c" * 60
    found = chunking.sections(spark.createDataFrame([(1, text)], "doc_id long, text string"), L.SECTION_PATTERNS).orderBy("section_idx").collect()
    assert [s.title for s in found] == ["第一节", "三"]
    assert all(text[s.start_pos : s.end_pos].strip() == s.body for s in found)


def test_sentence_chunks(spark):
    rows = [(1, "a" * 799), (2, "a" * 801), (3, ("b" * 300 + "。") * 6), (4, None)]
    out = chunking.sentence_chunks(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect()
    by = {d: [(r.chunk_start, r.chunk_end) for r in out if r.doc_id == d] for d in (1, 2, 3)}
    assert by[1] == [(0, 799)] and by[2][0] == (0, 800)
    assert by[3][0] == (0, 602) and by[3][1][0] == 502


def test_recursive_chunks_stay_within_size(spark):
    text = "\n\n".join(" ".join("word%d" % i for i in range(j, j + 40)) for j in range(0, 400, 40))
    out = chunking.recursive_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), 200, 20).collect()
    assert all(0 < len(r.chunk) <= 200 for r in out)
    assert {w for r in out for w in r.chunk.split()} == set(text.split())


def test_compression_stops_at_the_first_that_does_not_fit(spark):
    rows = [(1, 0, "a" * 900, 0.9), (1, 1, "b" * 700, 0.8), (1, 2, "c" * 100, 0.7), (2, 0, "d" * 2000, 0.9)]
    out = {r.query_id: r for r in context.compress(spark.createDataFrame(rows, "query_id long, idx int, paragraph string, score double")).collect()}
    assert out[1].context == "a" * 900 and out[2].context == "d" * 1497 + "..."


def test_fact_support_uses_edit_ratio(spark):
    own = spark.createDataFrame([(1, "the meeting is on 5 May"), (2, "wholly different")], "group long, fact string")
    known = spark.createDataFrame([(1, "the meeting is on 6 May"), (2, "nothing alike here")], "group long, fact string")
    got = [tuple(r) for r in grounding.similar_facts(own, known).collect()]
    assert difflib.SequenceMatcher(None, "the meeting is on 5 May", "the meeting is on 6 May").ratio() >= 0.6
    assert got == [(1, "the meeting is on 5 May")]


def test_snapshot_diff_with_itself_is_unchanged(spark):
    files = incremental.fingerprints(spark.createDataFrame([("a", "x"), ("b", None)], "path string, text string"))
    assert {r.status for r in incremental.snapshot_diff(files, files).collect()} == {"unchanged"}
    other = incremental.fingerprints(spark.createDataFrame([("a", "y"), ("c", "x")], "path string, text string"))
    assert {r.path: r.status for r in incremental.snapshot_diff(files, other).collect()} == {"a": "modified", "b": "deleted", "c": "new"}


def test_answer_numbers_follow_the_order(spark):
    rows = spark.range(2500).select(F.col("id").alias("answer_id"), F.lit(3).alias("n_sources")).repartition(5)
    out = reports.answer_records(rows, ("answer_id",)).collect()
    assert all(int(r.number[1:]) == r.answer_id + 1 for r in out) and out[0].confidence == "0.30"


def test_parsers_fall_back(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\f \ftwo")
    (tmp_path / "b.bin").write_bytes(b"zz")

    def broken(content):
        raise ValueError("no")

    files = tables.read_files(spark, str(tmp_path), ("*.txt", "*.bin"))
    got = pages.load_pages(files, (broken, pages.plain_parser)).collect()
    assert sorted((r.path[-5:], r.page, r.text) for r in got) == [("a.txt", 1, "one"), ("a.txt", 3, "two"), ("b.bin", 1, "zz")]
    assert {r.error for r in pages.load_pages(files, (broken,)).collect()} == {"no"}


def test_terms_are_counted_alike_on_either_way(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b a b, ab"), (2, ""), (3, None), (4, "a a")], "chunk_id long, text string")
    asked = spark.createDataFrame([(7, "a b b"), (8, "")], "query_id long, question string")
    toks = lambda c: X.tokens(F.col(c), least=1)
    assert sorted((r.chunk_id, r.dl, r.term, r.tf) for r in lexical.term_counts(docs, toks("text")).collect()) == [(1, 4, "a", 1), (1, 4, "ab", 1), (1, 4, "b", 2), (4, 2, "a", 2)]
    run = lambda: sorted(tuple(r) for f in (lexical.bm25_scores, lexical.term_frequency_scores) for r in f(docs, asked, toks("text"), toks("question")).collect())
    broadcast = run()
    monkeypatch.setattr(lexical, "MOST_TERMS", 0)
    assert run() == broadcast and len(broadcast) == 4


def test_question_sheet(spark, tmp_path):
    (tmp_path / "q.csv").write_text('no,question\n1," one, ""two"" "\n2,\n3,three\n')
    assert sorted(r.question for r in tables.read_questions(spark, str(tmp_path / "q.csv")).collect()) == ['one, "two"', "three"]


def test_watcher_reports_adds_changes_and_deletions(spark, tmp_path):
    folder, state, seen = tmp_path / "in", str(tmp_path / "state"), []
    folder.mkdir()
    note = lambda df, n: seen.append({r.path.rsplit("/", 1)[1]: r.status for r in df.collect()})
    (folder / "a.txt").write_text("1")
    (folder / "b.txt").write_text("1")
    watcher.watch(spark, str(folder), state, note, once=True).awaitTermination()
    (folder / "a.txt").write_text("2")
    (folder / "b.txt").unlink()
    (folder / "c.txt").write_text("3")
    watcher.watch(spark, str(folder), state, note, once=True).awaitTermination()
    assert seen[0] == {"a.txt": "new", "b.txt": "new"}
    assert seen[1] == {"a.txt": "modified", "b.txt": "deleted", "c.txt": "new"}


@pytest.mark.parametrize("change", ["modified", "deleted"])
def test_watcher_reports_without_an_arrival(spark, tmp_path, change):
    folder, state, seen = tmp_path / "in", str(tmp_path / "state"), []
    folder.mkdir()
    note = lambda df, n: seen.append({r.path.rsplit("/", 1)[1]: r.status for r in df.collect()})
    (folder / "a.txt").write_text("1")
    (folder / "b.txt").write_text("1")
    running = watcher.watch(spark, str(folder), state, note, interval="1 second")
    try:
        for n in (1, 2):
            end = time.monotonic() + 20
            while len(seen) < n and time.monotonic() < end and running.isActive:
                time.sleep(0.1)
            if n == 1:
                (folder / "a.txt").write_text("2") if change == "modified" else (folder / "a.txt").unlink()
    finally:
        running.stop()
    assert seen == [{"a.txt": "new", "b.txt": "new"}, {"a.txt": change}]


def test_windowed_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = watcher.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("changes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("changes").agg(F.sum("changes")).first()[0] == events.count()
