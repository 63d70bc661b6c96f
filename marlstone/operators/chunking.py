"""Splitting texts into chunks, sections, paragraphs and sentences."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.sources.tables import materialise


def fixed_chunks(corpus: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_idx, start, chunk: windows of ``size`` characters; blank ones are dropped, ends stripped."""
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    # Numbered within the array, so no row leaves its partition.
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), X.strip(F.substring(F.col("text"), s + 1, F.lit(size))).alias("chunk")))
    rows = corpus.select("doc_id", F.posexplode(F.filter(cut, lambda c: c.chunk != "")).alias("chunk_idx", "c"))
    return rows.select("doc_id", "chunk_idx", "c.start", "c.chunk")


def section_title(line: Column, patterns: tuple[str, ...], keywords: tuple[str, ...] = ()) -> Column:
    """Group 1 of the first matching pattern, or a short line with a keyword; null if it is no title."""
    title = F.when(F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(line, k)) & (F.length(line) < 100), line) if keywords else F.lit(None).cast("string")
    for pattern in reversed(patterns):
        title = F.when(line.rlike(pattern), X.strip(F.regexp_extract(line, pattern, 1))).otherwise(title)
    return F.when(title != "", title)


def section_level(line: Column, levels: Sequence[tuple[int, str]], default: int = 2) -> Column:
    """The level of the first pattern that a title's line matches."""
    out = F.lit(default)
    for level, pattern in reversed(levels):
        out = F.when(line.rlike(pattern), level).otherwise(out)
    return out


def sections(corpus: DataFrame, patterns: tuple[str, ...], keywords: tuple[str, ...] = (), least: int = 50, levels: Sequence[tuple[int, str]] = ()) -> DataFrame:
    """doc_id, section_idx, title, level, start_pos, end_pos, body, body_pos (where the body starts) of sections longer than ``least``.

    A section runs from its title's line to the next title; text before the first is not part of one.
    start_pos is the length of the lines before the title, joined.  Each line travels once, to its document; a section's body is put together from its lines.
    """
    lines = corpus.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("stripped", X.strip(F.col("line")))
    order = Window.partitionBy("doc_id").orderBy("n")
    stripped = F.col("stripped")
    placed = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("title", section_title(stripped, patterns, keywords)).withColumn("level", F.when(F.col("title").isNotNull(), section_level(stripped, levels)))
    numbered = placed.withColumn("section", F.count("title").over(order)).filter("section > 0")
    whole = numbered.groupBy("doc_id", "section").agg(
        F.min_by("title", "n").alias("title"), F.min_by("level", "n").alias("level"), F.greatest(F.min("start") - 1, F.lit(0)).alias("start_pos"),
        F.min(F.col("start") + F.when(F.col("title").isNotNull(), F.length("line") - F.length(F.regexp_replace("line", f"^{X.SPACE}+", "")))).alias("body_pos"),
        F.max(F.col("start") + F.length("line")).alias("last"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"),
    )
    following = Window.partitionBy("doc_id").orderBy("section")
    ended = whole.withColumn("end_pos", F.coalesce(F.lead("start_pos").over(following), F.col("last")))
    kept = ended.filter(F.col("end_pos") - F.col("start_pos") > least)
    body = X.strip(F.array_join("lines.line", "\n"))
    return kept.select("doc_id", (F.row_number().over(following) - 1).alias("section_idx"), "title", "level", "start_pos", "end_pos", body.alias("body"), "body_pos").filter("body <> ''")


def enriched_section(title: Column, body: Column, level: Column, keywords: Column, entities: Column, marks: Mapping[int, str], tags: tuple[str, str, str]) -> Column:
    """The body below its title, which carries a mark for the level, tags for keywords in it and for the file's
    entities, and further tags for entities that the body has and the title has not.

    keywords, entities: array columns; tags: prefixes of the three kinds.
    """
    mark = F.coalesce(F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])[level], F.lit(""))

    def tagged(words: Column, prefix: str) -> Column:
        return F.array_join(F.transform(words, lambda w: F.concat(F.lit(" " + prefix), w)), "")

    in_title = F.filter(keywords, lambda w: F.contains(title, w))
    in_body = F.filter(entities, lambda w: F.contains(body, w) & ~F.contains(title, w))
    return F.concat(mark, title, tagged(in_title, tags[0]), tagged(entities, tags[1]), tagged(in_body, tags[2]), F.lit("\n\n"), body)


def paragraphs(text: Column, least: int = 20) -> Column:
    """Pieces between line feeds and full stops, stripped; those shorter than ``least`` go unless all are."""
    pieces = F.filter(F.transform(F.split(text, "[\n。！？]"), X.strip), lambda p: p != "")
    long = F.filter(pieces, lambda p: F.length(p) >= least)
    return F.when(F.size(long) == 0, pieces).otherwise(long)


def sentences(text: Column, delimiters: str = "。！？\n", least: int = 6) -> Column:
    return F.filter(F.transform(F.split(text, f"[{delimiters}]"), X.strip), lambda s: F.length(s) >= least)


def tagged_paragraphs(corpus: DataFrame, keywords: tuple[str, ...], separator: str = "\n", least: int = 20) -> DataFrame:
    """doc_id, paragraph_index (counted before short ones go), tags, content (tags in front, if any)."""
    cut = corpus.select("doc_id", F.posexplode(F.split("text", separator)).alias("paragraph_index", "p")).withColumn("p", X.strip(F.col("p")))
    tags = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains("p", k))
    cut = cut.filter(F.length("p") >= least).withColumn("tags", tags)
    head = F.concat(F.lit("["), F.array_join("tags", "]["), F.lit("]\n\n"))
    return cut.select("doc_id", "paragraph_index", "tags", F.when(F.size("tags") > 0, F.concat(head, "p")).otherwise(F.col("p")).alias("content"))


def _last_place(window: Column, delimiter: str) -> Column:
    """Place, from 0, of the last occurrence; null if there is none."""
    return F.when(F.contains(window, F.lit(delimiter)), F.length(window) - F.length(F.substring_index(window, delimiter, -1)) - len(delimiter))


def _blocks(size: int) -> Column:
    """``text`` in blocks of ``size`` characters, so that any range of up to ``size`` lies in two of them, however long the text is."""
    return F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _range(blocks: str, start: Column, length: Column, size: int) -> Column:
    place = F.floor(start / size).cast("int")
    return F.substring(F.concat(F.get(blocks, place), F.coalesce(F.get(blocks, place + 1), F.lit(""))), start - place * size + 1, length)


def sentence_chunks(corpus: DataFrame, size: int = 800, overlap: int = 100, delimiters: str = "。！？\n", tail: int = 50, mark: str = "【续：{}】\n\n") -> DataFrame:
    """The columns of ``corpus`` (text and, if there is one, title among them) and chunk_index, chunk_start, chunk_end, is_continuation, chunk.

    A text of up to ``size`` characters stays as it is.  Else each chunk ends after the last occurrence, in its window, of the first of the
    delimiters that occurs there; the next starts ``overlap`` before, or a quarter of the window on where that is no way forward.  Cutting
    stops with ``tail`` characters or fewer left, or after as many steps as half windows and ten.  Chunks are stripped, blank ones go, and
    all but the first name the title.  Null texts give no chunk.

    Each cut depends on the one before, so the cuts are a fold over the steps, within the row.
    """
    n = F.length("text")
    steps = F.sequence(F.lit(1), F.floor(n / (size // 2)).cast("int") + 10)
    start = F.struct(F.lit(0).alias("start"), F.array().cast("array<struct<a:int,b:int,chunk:string>>").alias("cuts"))

    def advance(state: Column, window: Column, cut: Column) -> Column:
        at = state["start"]
        added = X.let(X.strip(F.substring(window, F.lit(1), cut)), lambda chunk: F.when(chunk != "", F.array_append(state["cuts"], F.struct(at.alias("a"), (at + cut).cast("int").alias("b"), chunk.alias("chunk")))).otherwise(state["cuts"]))
        ahead = at + F.when(cut > overlap, cut - overlap).otherwise(max(1, size // 4))
        return F.struct(ahead.cast("int").alias("start"), added.alias("cuts"))

    def step(state: Column, _: Column) -> Column:
        at = state["start"]

        def cut_in(window: Column) -> Column:
            found = F.coalesce(*[_last_place(window, d) for d in delimiters], F.lit(0))
            cut = F.when(at + size < n, X.let(found, lambda f: F.when(f > 0, f + 1).otherwise(size))).otherwise(size)
            return X.let(cut, lambda c: advance(state, window, c))

        going = (at < n) & ((at == 0) | (at < n - tail))
        return F.when(going, X.let(_range("__blocks", at, F.lit(size), size), cut_in)).otherwise(state)

    whole = F.array(F.struct(F.lit(0).alias("a"), n.alias("b"), F.col("text").alias("chunk")))
    cuts = F.when(n <= size, whole).otherwise(F.aggregate(steps, start, step)["cuts"])
    cut = corpus.withColumn("__blocks", F.when(n > size, _blocks(size))).select(*corpus.columns, F.posexplode(cuts).alias("chunk_index", "c"))
    later = F.col("chunk_index") > 0
    before, after = mark.split("{}")
    title = F.coalesce("title", F.lit("")) if "title" in corpus.columns else F.lit("")
    chunk = F.when(later, F.concat(F.lit(before), title, F.lit(after), F.col("c.chunk"))).otherwise(F.col("c.chunk"))
    return cut.select(*corpus.columns, "chunk_index", F.col("c.a").alias("chunk_start"), F.col("c.b").alias("chunk_end"), later.alias("is_continuation"), chunk.alias("chunk"))


_PIECE = "array<struct<node:bigint,piece:string>>"


def _split_parts(size: int, level: int, separator: str, levels: int) -> Callable[[Column, Column], Column]:
    """What the i-th part becomes at a separator: itself, or its parts, each with the separator before it."""

    def split(p: Column, i: Column) -> Column:
        node = (i.cast("long") * levels + level).alias("node")
        if separator:
            texts = F.transform(F.split(p["piece"], rf"\Q{separator}\E"), lambda x, j: F.when(j > 0, F.concat(F.lit(separator), x)).otherwise(x))
        else:
            texts = F.split(p["piece"], "")
        placed = F.transform(F.filter(texts, lambda x: x != ""), lambda x: F.struct(node, x.alias("piece")))
        held = F.contains(p["piece"], F.lit(separator)) if separator else F.lit(True)
        todo = (F.length(p["piece"]) >= size) | (p["node"] == -1)
        return F.when(todo & held, placed).otherwise(F.array(p)).cast(_PIECE)

    return split


def _pieces(size: int, separators: Sequence[str]) -> Column:
    """The parts of ``text``, in order and without gaps, that chunks are put together from: node (the part that was split into them), piece.

    The text, and then each part of ``size`` characters or more, is split by the first separator of the list that occurs in it.
    """
    out = F.array(F.struct(F.lit(-1).cast("long").alias("node"), F.col("text").alias("piece"))).cast(_PIECE)
    for level, separator in enumerate(separators):
        out = F.flatten(F.transform(out, _split_parts(size, level, separator, len(separators))))
    return F.transform(out, lambda p: F.struct(p["node"].alias("node"), F.length(p["piece"]).alias("length")))


def recursive_chunks(corpus: DataFrame, size: int = 500, overlap: int = 50, separators: Sequence[str] = ("\n\n", "\n", " ", "")) -> DataFrame:
    """The columns of ``corpus`` (text among them) and chunk_index, start, chunk, by recursive separators, the last of which is empty.

    Parts keep the separator before them.  Parts of one node follow each other in a chunk of up to ``size`` characters; the next chunk
    begins with as many of the last parts as fit ``overlap``, and the part to come fits with them.  Chunks are stripped, blank ones go;
    null and empty texts give none.

    As parts have no gaps, a chunk is a range of the text: a fold over the parts keeps the range's start, and where the parts of the last ``overlap`` characters begin.
    """
    if not separators or separators[-1] != "":
        raise ValueError("the last separator must be empty")
    kind = "array<struct<a:int,b:int>>"
    start = F.struct(F.lit(-1).cast("long").alias("node"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.array().cast("array<int>").alias("recent"), F.array().cast(kind).alias("cuts"))

    def step(state: Column, p: Column) -> Column:
        at, length = state["b"], p["length"]
        other = p["node"] != state["node"]
        full = ~other & (at > state["a"]) & (at - state["a"] + length > size)
        closed = F.array_append(state["cuts"], F.struct(state["a"].alias("a"), at.alias("b")))
        first = F.get(F.filter(state["recent"], lambda r: r >= at - F.least(F.lit(overlap), size - length)), F.lit(0))
        return F.struct(
            p["node"].alias("node"), F.when(other, at).when(full, F.coalesce(first, at)).otherwise(state["a"]).alias("a"), (at + length).alias("b"),
            F.when(other, F.array(at)).otherwise(F.array_append(F.filter(state["recent"], lambda r: r >= at - overlap), at)).alias("recent"),
            F.when((other & (at > state["a"])) | full, closed).otherwise(state["cuts"]).alias("cuts"),
        )

    rows = corpus.filter("text <> ''").withColumns({"__blocks": _blocks(size), "__state": F.aggregate(_pieces(size, separators), start, step)})
    ranges = F.array_append("__state.cuts", F.struct(F.col("__state.a").alias("a"), F.col("__state.b").alias("b")))
    cut = F.transform(ranges, lambda r: F.struct(r["a"].alias("start"), X.strip(_range("__blocks", r["a"], r["b"] - r["a"], size)).alias("chunk")))
    out = rows.select(*corpus.columns, F.posexplode(F.filter(cut, lambda c: c["chunk"] != "")).alias("chunk_index", "c"))
    return out.select(*corpus.columns, "chunk_index", "c.start", "c.chunk")


def page_files(pages: DataFrame) -> DataFrame:
    """path, text, spans (page, start, end) from (path, page, text): the pages of a file in their order, a line feed after each, and where each lies.

    A null page text counts as empty.  Pages of one number follow each other by their text.
    """
    gathered = pages.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text")))).alias("__pages"))
    kind = "array<struct<page:bigint,start:int,end:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
    placed = F.aggregate("__pages", begin, lambda s, p: F.struct((s["at"] + F.length(p["text"])).alias("at"), F.array_append(s["spans"], F.struct(p["page"].cast("long").alias("page"), s["at"].alias("start"), (s["at"] + F.length(p["text"])).alias("end"))).alias("spans")))
    return gathered.select("path", F.array_join("__pages.text", "").alias("text"), placed["spans"].alias("spans"))


def pages_of(spans: Column, start: Column, end: Column) -> Column:
    """The pages that a range of the file's text touches."""
    return F.filter(spans, lambda p: (p["start"] < end) & (p["end"] > start))["page"]


def load_chapters(
    pages: DataFrame, patterns: tuple[str, ...], levels: Sequence[tuple[int, str]], keywords: tuple[str, ...], entities: Column, marks: Mapping[int, str], tags: tuple[str, str, str],
    size: int = 800, overlap: int = 100, delimiters: str = "。！？\n", mark: str = "【续：{}】\n\n",
) -> DataFrame:
    """path, section_idx, title, level, chunk_index, chunk, pages of files given by their pages (path, page, text).

    A file's pages become one text, which is cut into sections; each section, below its enriched title, into chunks at sentence ends.
    A chunk's pages are those that its part of the file's text touches.  A file without sections gives its pages' paragraphs (no title).
    ``entities`` is an array column over ``path``.
    """
    pages = materialise(pages.select("path", "page", "text"))  # what makes the texts is done once
    files = materialise(page_files(pages))
    found = materialise(sections(files.withColumnRenamed("path", "doc_id"), patterns, levels=levels).withColumnRenamed("doc_id", "path"))
    chapters = found.join(files.select("path", "spans"), "path")
    words = F.array(*[F.lit(k) for k in keywords])
    content = enriched_section(F.col("title"), F.col("body"), F.col("level"), words, entities, marks, tags)
    cut = sentence_chunks(chapters.withColumn("text", content).select("path", "section_idx", "title", "level", "spans", "text", "body_pos", F.length("body").alias("size"), (F.length(content) - F.length("body")).alias("head")), size, overlap, delimiters, mark=mark)
    place = lambda at, least: F.col("body_pos") + F.least(F.greatest(F.col(at) - F.col("head"), F.lit(least)), F.col("size"))
    begin, end = place("chunk_start", 0), place("chunk_end", 1)
    chunks = cut.select("path", "section_idx", "title", "level", "chunk_index", "chunk", pages_of(F.col("spans"), begin, end).alias("pages"))
    plain = pages.join(found.select("path").distinct(), "path", "left_anti")
    named = tagged_paragraphs(plain.select(F.struct("path", F.col("page").cast("long").alias("page")).alias("doc_id"), "text"), keywords)
    rest = named.select("doc_id.path", F.lit(None).cast("int").alias("section_idx"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("level"), F.col("paragraph_index").alias("chunk_index"), F.col("content").alias("chunk"), F.array("doc_id.page").alias("pages"))
    return chunks.unionByName(rest)
