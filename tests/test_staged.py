"""Merging, restricting and boosting of candidates; section levels; classification by points."""

from pyspark.sql import functions as F

from marlstone.functions import lexicons as L
from marlstone.operators import chunking, classify, rerank, staged

HITS = "query_id long, channel string, chunk_id long, rank int, score double, source string, text string"


def test_merge_keeps_the_last_vector_hit_and_adds_lexical_ones(spark):
    head = "x" * 100
    rows = [
        (1, "vector", 10, 1, 0.9, "a", head + "one"), (1, "vector", 11, 2, 0.5, "a", head + "two"), (1, "bm25", 12, 1, 4.0, "a", head + "three"), (1, "bm25", 13, 2, 2.0, "a", head),
        (1, "bm25", 14, 3, 1.0, "b", head + "one"), (1, "vector", 15, 3, 0.4, "c", "other"),
    ]
    got = staged.merge_candidates(spark.createDataFrame(rows, HITS), 10, 0.25).orderBy("rank").collect()
    assert [(r.chunk_id, r.source_type, r.hybrid_score) for r in got] == [(11, "hybrid", 4.625), (14, "bm25", 0.75), (15, "vector", 0.1)]


def test_two_stages_and_few_candidates(spark):
    rows = [(q, i, "a b", "a b" if i == 3 else "a", float(i)) for q, n in ((1, 6), (2, 2)) for i in range(n)]
    frame = spark.createDataFrame(rows, "query_id long, chunk_id long, question string, text string, score double")
    got = staged.two_stage_rerank(frame, F.col("chunk_id") / 10, first=3, k=2).collect()
    assert {(r.query_id, r.chunk_id, r.rank) for r in got} == {(1, 3, 1), (1, 5, 2), (2, 1, 1), (2, 0, 2)}
    assert {(r.chunk_id, r.final_score) for r in got if r.query_id == 1} == {(3, 0.72), (5, 0.5)}


def test_files_of_a_question(spark):
    hits = "query_id long, chunk_id long, score double, source string"
    ranked = spark.createDataFrame([(q, c, s, f) for q in (1, 2, 3) for c, s, f in ((1, 9.0, "a"), (2, 8.0, "b"))], hits)
    words = spark.createDataFrame([(2, 7, 3.0, "z"), (1, 8, 3.0, "b")], hits)
    targets = spark.createDataFrame([(1, "b"), (2, "z")], "query_id long, source string")
    got = staged.within_files(ranked, words, targets, 5).collect()
    assert {(r.query_id, r.chunk_id, r.mode, r.rank) for r in got} == {(1, 2, "targeted", 1), (2, 7, "keyword", 1), (3, 1, "global", 1), (3, 2, "global", 2)}


def test_boosted_hits_come_first_in_their_order(spark):
    rows = [(1, i, i, s) for i, s in ((1, "x.pdf"), (2, "guide-1.pdf"), (3, "y.pdf"), (4, "guide-2.pdf"))]
    frame = spark.createDataFrame(rows, "query_id long, chunk_id long, rank int, source string")
    got = staged.boosted_first(frame, staged.file_matches(F.col("source"), "guide*.pdf"), 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.matches, r.match_score) for r in got] == [(2, True, 2.0), (4, True, 2.0), (1, False, 1.0)]
    assert frame.filter(staged.file_matches(F.col("source"), "") | staged.file_matches(F.col("source"), "y.")).count() == 1


def test_section_levels_and_titles(spark):
    text = "一、任务描述\n" + "智能控制" * 20 + "\n（1）技术要求\n" + "内容" * 40
    rows = chunking.sections(spark.createDataFrame([(1, text)], "doc_id long, text string"), L.SECTION_PATTERNS, levels=L.SECTION_LEVELS)
    words = F.array(*[F.lit(w) for w in L.TASK_INDICATORS])
    entities = F.array(F.lit("智能控制"), F.lit("别的"))
    content = chunking.enriched_section(F.col("title"), F.col("body"), F.col("level"), words, entities, L.LEVEL_MARKS, L.SECTION_TAGS)
    got = rows.withColumn("content", content).orderBy("section_idx").collect()
    assert [(r.title, r.level) for r in got] == [("任务描述", 1), ("技术要求", 3)]
    assert got[0].content.split("\n")[0] == "【主要章节】任务描述 #关键:任务 #文件实体:智能控制 #文件实体:别的 #实体匹配:智能控制"
    assert got[1].content.split("\n")[0] == "【细分章节】技术要求 #关键:要求 #文件实体:智能控制 #文件实体:别的"
    assert "".join(r.body for r in got).replace("\n", "") == text.replace("\n", "")


def test_points_names_and_effectiveness(spark):
    frame = spark.createDataFrame([("alpha beta",), ("beta",), ("none",)], "t string")
    category, points = classify.points_category(F.col("t"), {"b": (("beta",), ()), "a": (("alpha",), ("^alpha",))}, "other")
    name, sure = classify.named_type(F.col("t"), {"beta": ("alpha gamma",)})
    got = frame.select(category, points, name, sure).collect()
    assert [tuple(r) for r in got] == [("a", 3, "beta", 1.0), ("b", 1, "beta", 1.0), ("other", 0, None, 0.0)]
    fitting, overall = rerank.prompt_effectiveness(F.lit(0.1), F.lit(0.5), F.lit(True))
    assert tuple(frame.select(fitting, overall).first()) == (True, 0.3)
