"""Cutters against plain restatements of their rules, and files with their pages."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import chunking


def recursive(text, size, overlap, separators):
    """Split, keep separators in front, merge, go deeper into long parts."""

    def merged(parts):
        out, window, total = [], [], 0
        for p in parts:
            if window and total + len(p) > size:
                out.append("".join(window).strip())
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(window.pop(0))
            window.append(p)
            total += len(p)
        return [c for c in [*out, "".join(window).strip()] if c]

    def split(t, left):
        i = next(i for i, s in enumerate(left) if s == "" or s in t)
        parts = [p if j == 0 else left[i] + p for j, p in enumerate(t.split(left[i]))] if left[i] else list(t)
        out, good = [], []
        for p in filter(None, parts):
            if len(p) < size:
                good.append(p)
                continue
            out, good = [*out, *(merged(good) if good else [])], []
            out += split(p, left[i + 1 :]) if left[i + 1 :] else [p]
        return [*out, *(merged(good) if good else [])]

    return split(text, separators) if text else []


def sentence(text, title, size, overlap, delimiters):
    if len(text) <= size:
        return [(0, len(text), text)]
    out, start, steps = [], 0, 0
    while start < len(text) and steps < len(text) // (size // 2) + 10:
        steps, end = steps + 1, start + size
        if end < len(text):
            last = next((at for d in delimiters if (at := text.rfind(d, start, end)) >= 0), -1)
            end = last + 1 if last > start else end
        if chunk := text[start:end].strip():
            out.append((start, end, f"<{title}>{chunk}" if out else chunk))
        start = end - overlap if end - overlap > start else start + max(1, size // 4)
        if start >= len(text) - 50:
            break
    return out


@pytest.fixture(scope="module")
def texts(spark):
    made = random.Random(1)
    rows = [(0, None, "t"), (1, "", "t"), (2, "x" * 3000, "t"), (3, "ab cd\n\n\n\nef " * 200, "t"), (4, " \n " * 400, "t"), (5, "x" * 499 + " " + "y" * 500, None)]
    pieces = ["word", " ", "  ", "\n", "\n\n", "longerword", "😀", ".", "!", "é"]
    rows += [(i, "".join(made.choice([*pieces, "y" * made.randint(1, 90)]) for _ in range(made.randint(1, 600))), f"T{i}") for i in range(6, 50)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, title string").withColumns({"a": F.lit(1), "chunk_index": F.lit("x"), "node": F.lit(2)}).drop("chunk_index").cache()


def by_doc(rows, *names):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append((r.chunk_index, *[r[n] for n in names]))
    return {d: [x[1:] for x in sorted(c)] for d, c in out.items()}


@pytest.mark.parametrize(("size", "overlap"), [(500, 50), (40, 10), (60, 60)])
def test_recursive_cuts(texts, size, overlap):
    rows, df = texts
    got = by_doc(chunking.recursive_chunks(df, size, overlap).collect(), "chunk")
    for d, t, _ in rows:
        assert [c for (c,) in got.get(d, [])] == recursive(t, size, overlap, ("\n\n", "\n", " ", "")), d


@pytest.mark.parametrize(("size", "overlap"), [(800, 100), (50, 20), (60, 59)])
def test_sentence_cuts(texts, size, overlap):
    rows, df = texts
    got = by_doc(chunking.sentence_chunks(df, size, overlap, ".!\n", mark="<{}>").collect(), "chunk_start", "chunk_end", "chunk")
    for d, t, title in rows:
        assert got.get(d, []) == ([] if t is None else sentence(t, title or "", size, overlap, ".!\n")), d


def test_separators_must_end_with_the_empty_one(texts):
    with pytest.raises(ValueError):
        chunking.recursive_chunks(texts[1], separators=("\n", " "))


def test_chapters_name_their_pages_and_files_without_chapters_fall_back(spark):
    body = "Some words that fill this line of the page.\n" * 30
    pages = [("a", 1, "before"), ("a", 2, "1. First\n" + body), ("a", 3, body + "2. Second"), ("a", 4, body), ("b", 1, "A paragraph that is long enough.\nshort"), ("b", 2, None)]
    df = spark.createDataFrame(pages, "path string, page int, text string")
    got = chunking.load_chapters(df, (r"^\d\. (.+)$",), ((1, r"^1\. "), (2, r"^\d\. ")), ("words",), F.array(F.concat(F.lit("file "), F.col("path"))), {1: "[1] ", 2: "[2] "}, ("#k:", "#f:", "#b:"), delimiters=".\n", mark="<{}>").collect()
    chapters = sorted((r.section_idx, r.chunk_index, r.chunk, r.pages, r.level) for r in got if r.path == "a")
    assert chapters[0][2].startswith("[1] First #f:file a\n\n1. First\n") and {tuple(c[3]) for c in chapters if c[0] == 0} == {(2,), (2, 3), (3,)}
    assert {tuple(c[3]) for c in chapters if c[0] == 1} == {(3, 4), (4,)} and {c[4] for c in chapters if c[0] == 1} == {2}
    assert all(c[2].startswith("<First>") for c in chapters if c[0] == 0 and c[1] > 0)
    assert [(r.title, r.chunk, r.pages) for r in got if r.path == "b"] == [(None, "A paragraph that is long enough.", [1])]
    assert chunking.load_chapters(df.limit(0), (r"^\d\. (.+)$",), (), ("words",), F.array(F.col("path")), {1: ""}, ("", "", "")).count() == 0
