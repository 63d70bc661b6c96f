"""Named queries: tokens, chunking, sections, classification and corpus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import lexicons as L
from marlstone.functions import text as X
from marlstone.operators import chunking, classify, lexical, reports, segment, staged, substrings
from marlstone.plans.registry import query
from marlstone.plans.retrieval import SQL_BM25, bm25_hits, d_tokens, q_tokens, sql_list, sql_tokens, swap
from marlstone.sources.pages import html_text
from marlstone.sources.tables import answers, corpus, materialise, questions, table

_STRIP = r"regexp_replace({}, '^[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"


#: White space in the Unicode sense.
_SQL_SPACE = _STRIP[_STRIP.index("[") : _STRIP.index("]") + 1].replace("{{", "{").replace("}}", "}")


def sql_strip(column: str) -> str:
    return _STRIP.format(column)


@query("tokens_stats", f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens FROM (SELECT doc_id, {swap(sql_tokens('text'), 'lower(text)', 'text')} AS t FROM documents)")
def tokens_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as they are written; case is kept."""
    cased = X.tokens(F.col("text"), lower=False)
    return corpus(spark, sf_dir).select("doc_id", F.size(cased).alias("tokens"), F.size(F.array_distinct(cased)).alias("distinct_tokens"))


# The prose is cut into the parts that its words are made of.
_LETTERS, _LEAST, _COHESION, _FREEDOM = "[a-z]", 50, 4.0, 1.5
_DICTIONARY = f"""
runs AS MATERIALIZED (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_LETTERS}{{1,1000}}')) AS run FROM documents) GROUP BY run),
grams AS MATERIALIZED (SELECT gram, sum(n)::BIGINT AS n FROM (SELECT n, unnest(flatten(list_transform(range(1, length(run) + 1), lambda i: list_transform(range(1, least(5, length(run) - i + 1) + 1), lambda k: substring(run, i::INT, k::INT))))) AS gram FROM runs) GROUP BY gram),
total AS (SELECT sum(n)::BIGINT AS total FROM grams WHERE length(gram) = 1),
longer AS (SELECT * FROM grams WHERE length(gram) BETWEEN 2 AND 4 AND n >= {_LEAST}),
splits AS (SELECT gram, n, substring(gram, 1, i::INT) AS head, substring(gram, i::INT + 1) AS tail FROM longer, unnest(range(1, length(gram))) u(i)),
held AS (SELECT s.gram, min(round(s.n * total::DOUBLE / h.n / t.n, 6)) AS cohesion FROM splits s JOIN grams h ON h.gram = s.head JOIN grams t ON t.gram = s.tail, total GROUP BY s.gram),
before AS (SELECT substring(gram, 2) AS gram, sum(n) AS inside, sum(n * ln(n)) AS kk FROM grams WHERE length(gram) >= 2 GROUP BY 1),
after AS (SELECT substring(gram, 1, length(gram) - 1) AS gram, sum(n) AS inside, sum(n * ln(n)) AS kk FROM grams WHERE length(gram) >= 2 GROUP BY 1),
free AS (SELECT g.gram, round(ln(g.n) - (coalesce(b.kk, 0) + CASE WHEN g.n > coalesce(b.inside, 0) THEN (g.n - coalesce(b.inside, 0)) * ln(g.n - coalesce(b.inside, 0)) ELSE 0 END) / g.n, 6) AS before_,
  round(ln(g.n) - (coalesce(a.kk, 0) + CASE WHEN g.n > coalesce(a.inside, 0) THEN (g.n - coalesce(a.inside, 0)) * ln(g.n - coalesce(a.inside, 0)) ELSE 0 END) / g.n, 6) AS after_ FROM grams g LEFT JOIN before b ON b.gram = g.gram LEFT JOIN after a ON a.gram = g.gram),
dictionary AS MATERIALIZED (SELECT gram AS word, n, round(ln(n / total::DOUBLE) * 1000000)::BIGINT AS weight FROM (
  SELECT l.gram, l.n FROM longer l JOIN held USING (gram) JOIN free USING (gram) WHERE cohesion >= {_COHESION} AND before_ >= {_FREEDOM} AND after_ >= {_FREEDOM} UNION ALL SELECT gram, n FROM grams WHERE length(gram) = 1), total)"""


@query("learnt_words", f"WITH {_DICTIONARY} SELECT * FROM dictionary")
def learnt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of the parts that the corpus's words are made of."""
    return segment.learn(segment.runs(corpus(spark, sf_dir), _LETTERS), least=_LEAST, cohesion=_COHESION, freedom=_FREEDOM)


@query("segmented_runs", f"""WITH {_DICTIONARY},
spans AS (SELECT run, e, e - k AS b, substring(run, (e - k + 1)::INT, k::INT) AS word FROM runs, unnest(range(1, length(run) + 1)) u(e), unnest(range(1, 5)) v(k) WHERE k <= e),
places AS (SELECT run, e, list({{'b': b, 'w': weight}}) AS edges FROM spans JOIN dictionary USING (word) GROUP BY run, e),
folded AS (SELECT run, list_reduce(list_concat([{{'edges': []::STRUCT(b BIGINT, w BIGINT)[], 'best': [{{'score': 0::BIGINT, 'size': 0::BIGINT, 'path': ''}}]}}], list({{'edges': edges, 'best': []::STRUCT(score BIGINT, size BIGINT, path VARCHAR)[]}} ORDER BY e)),
  lambda s, x: {{'edges': x.edges, 'best': list_append(s.best, list_max(list_transform(x.edges, lambda d: {{'score': s.best[d.b + 1].score + d.w, 'size': len(s.best) - d.b, 'path': s.best[d.b + 1].path || d.b || ','}})))}}) AS s FROM places GROUP BY run),
cuts AS (SELECT run, list_transform(list_filter(string_split(s.best[-1].path, ','), lambda x: x <> ''), lambda x: x::INT) AS c FROM folded)
SELECT run, n, array_to_string(list_transform(c, lambda x, i: substring(run, x + 1, coalesce(c[i + 1], length(run)) - x)), '|') AS words FROM cuts JOIN runs USING (run)""")
def segmented_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct run of the corpus, along its best path."""
    counted = materialise(segment.runs(corpus(spark, sf_dir), _LETTERS))
    dictionary = materialise(segment.learn(counted, least=_LEAST, cohesion=_COHESION, freedom=_FREEDOM))
    return segment.segment(counted.select("run"), dictionary).join(counted, "run").select("run", "n", F.array_join("words", "|").alias("words"))


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(text, '[^\x{4e00}-\x{9fa5}a-zA-Z0-9\s%s]', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"


@query("normalise_text", f"SELECT doc_id, md5({_NORMAL % ''}) AS base, md5({_NORMAL % '，。！？；：（）【】.-'}) AS enhanced FROM documents")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.md5(X.normalise(F.col("text"))).alias("base"), F.md5(X.normalise(F.col("text"), X.ENHANCED_KEEP)).alias("enhanced"))


@query("stopword_filter", f"SELECT doc_id, len(list_filter({sql_tokens('text')}, lambda t: NOT list_contains({sql_list(L.PROSE_STOPWORDS)}, t))) AS kept FROM documents")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.size(X.tokens(F.col("text"), stopwords=L.PROSE_STOPWORDS)).alias("kept"))


@query("doc_keywords", f"""WITH t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term, generate_subscripts({sql_tokens('text')}, 1) AS pos FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS first FROM t GROUP BY ALL)
SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, first) AS rank FROM c QUALIFY rank <= 10""")
def doc_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_keywords(corpus(spark, sf_dir), d_tokens(), key="doc_id")


@query("query_keywords", f"SELECT item_id AS query_id, array_to_string(({sql_tokens('text')})[1:10], ' ') AS first_ten, array_to_string(list_filter({sql_tokens('text')}, lambda t: NOT list_contains({sql_list(L.PROSE_STOPWORDS)}, t))[1:10], ' ') AS without_stopwords FROM benchmark")
def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", F.array_join(F.slice(q_tokens(), 1, 10), " ").alias("first_ten"), F.array_join(F.slice(X.tokens(F.col("question"), stopwords=L.PROSE_STOPWORDS), 1, 10), " ").alias("without_stopwords"))


@query("delete_by_source", f"SELECT count(*) AS kept, (SELECT count(*) FROM documents) - count(*) AS deleted, round(avg(len({sql_tokens('text')})), 6) AS avgdl FROM documents WHERE source <> 'src3'")
def delete_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    stays = F.col("source") != "src3"
    return docs.agg(F.count_if(stays).alias("kept"), F.count_if(~stays).alias("deleted"), F.round(F.avg(F.when(stays, F.size(d_tokens()))), 6).alias("avgdl"))


@query("filename_entities", r"SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(url, '([a-z]+)\.example', 1), regexp_extract_all(url, '/([a-z]{2})/', 1), regexp_extract_all(url, '[0-9]+')))), '|') AS entities FROM pages")
def filename_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = (r"([a-z]+)\.example", r"/([a-z]{2})/", r"([0-9]+)")
    found = F.array_distinct(F.concat(*[F.regexp_extract_all("url", F.lit(p), F.lit(1)) for p in patterns]))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(found), "|").alias("entities"))


@query("chunk_fixed", f"""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 450)) AS start FROM documents),
c AS (SELECT doc_id, start, {sql_strip('substring(text, start + 1, 500)')} AS chunk FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_idx, start, md5(chunk) AS chunk_hash FROM c WHERE chunk <> ''""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(corpus(spark, sf_dir)).select("doc_id", "chunk_idx", "start", F.md5("chunk").alias("chunk_hash"))


def _sections_sql(patterns: tuple[str, ...] = L.PROSE_SECTIONS, source: str = "documents") -> str:
    line = sql_strip("line")
    title = "CASE " + " ".join(f"WHEN regexp_matches({line}, '{p}') THEN nullif({sql_strip(f'regexp_extract({line}, ' + chr(39) + p + chr(39) + ', 1)')}, '')" for p in patterns) + " END"
    return f"""
parts AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM {source}),
placed AS (SELECT doc_id, text, {title} AS title, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + greatest(n - 1, 0) AS start_pos FROM parts),
ended AS (SELECT *, coalesce(lead(start_pos) OVER (PARTITION BY doc_id ORDER BY start_pos), length(text)) AS end_pos FROM placed WHERE title IS NOT NULL),
sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_pos) - 1 AS section_idx, title, start_pos, end_pos, start_pos + length(regexp_extract(substring(text, start_pos + 1, end_pos - start_pos), '^{_SQL_SPACE}*')) AS body_pos, {sql_strip('substring(text, start_pos + 1, end_pos - start_pos)')} AS body FROM ended WHERE end_pos - start_pos > 50)"""


@query("detect_sections", f"WITH {_sections_sql()} SELECT doc_id, section_idx, title, start_pos, end_pos, md5(body) AS body_hash FROM sections WHERE body <> ''")
def detect_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections(corpus(spark, sf_dir), L.PROSE_SECTIONS).select("doc_id", "section_idx", "title", "start_pos", "end_pos", F.md5("body").alias("body_hash"))


_MARKS, _TAGS = {1: "[main] ", 2: "[sub] ", 3: "[detail] "}, ("#key:", "#file:", "#both:")


def _enriched_sql() -> str:
    tagged = lambda words, prefix: f"array_to_string(list_transform({words}, lambda w: ' {prefix}' || w), '')"
    level = "CASE " + " ".join(f"WHEN regexp_matches(first_line, '{p}') THEN {n}" for n, p in L.PROSE_LEVELS) + " ELSE 2 END"
    entities = "list_filter(list_distinct(regexp_extract_all(source, '[A-Za-z]+')), lambda w: length(w) >= 2)"
    return f"""{_sections_sql()},
lined AS (SELECT s.doc_id, section_idx, title, body, {sql_strip("string_split(body, chr(10))[1]")} AS first_line, list_sort({entities}) AS e FROM sections s JOIN documents d USING (doc_id) WHERE body <> ''),
levelled AS (SELECT *, {level} AS level FROM lined)
SELECT doc_id, section_idx, level, md5(CASE level {' '.join(f"WHEN {n} THEN '{m}'" for n, m in _MARKS.items())} END || title || {tagged(f"list_filter({sql_list(L.PROSE_KEYWORDS)}, lambda w: contains(title, w))", _TAGS[0])} || {tagged('e', _TAGS[1])} || {tagged('list_filter(e, lambda w: contains(body, w) AND NOT contains(title, w))', _TAGS[2])} || chr(10) || chr(10) || body) AS content_hash FROM levelled"""


@query("section_enrichment", f"WITH {_enriched_sql()}")
def section_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their level, below a title that names keywords and the file's entities."""
    docs = corpus(spark, sf_dir)
    found = chunking.sections(docs, L.PROSE_SECTIONS, levels=L.PROSE_LEVELS).join(docs.select("doc_id", "source"), "doc_id")
    words = F.array(*[F.lit(k) for k in L.PROSE_KEYWORDS])
    named = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all("source", F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: F.length(w) >= 2)))
    content = chunking.enriched_section(F.col("title"), F.col("body"), F.col("level"), words, named, _MARKS, _TAGS)
    return found.select("doc_id", "section_idx", "level", F.md5(content).alias("content_hash"))


@query("structure_report", f"""WITH {_sections_sql()}, n AS (SELECT doc_id, count(*) AS sections FROM sections WHERE body <> '' GROUP BY doc_id)
SELECT d.doc_id, length(d.text) AS chars, coalesce(n.sections, 0) AS sections, coalesce(n.sections, 0) > 3 AS structured FROM documents d LEFT JOIN n USING (doc_id)""")
def structure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    n = chunking.sections(docs, L.PROSE_SECTIONS).groupBy("doc_id").agg(F.count("*").alias("sections"))
    counted = docs.select("doc_id", F.length("text").alias("chars")).join(n, "doc_id", "left").fillna(0, ["sections"])
    return counted.withColumn("structured", F.col("sections") > 3)


@query("paragraph_tags", f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS paragraph_index FROM documents),
s AS (SELECT doc_id, paragraph_index, {sql_strip('raw')} AS p FROM p), t AS (SELECT *, list_filter({sql_list(L.PROSE_KEYWORDS)}, lambda k: contains(p, k)) AS tags FROM s WHERE length(p) >= 20)
SELECT doc_id, paragraph_index, array_to_string(tags, ',') AS tags, md5(CASE WHEN len(tags) > 0 THEN '[' || array_to_string(tags, '][') || ']' || chr(10) || chr(10) || p ELSE p END) AS content_hash FROM t""")
def paragraph_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.tagged_paragraphs(corpus(spark, sf_dir), L.PROSE_KEYWORDS).select("doc_id", "paragraph_index", F.array_join("tags", ",").alias("tags"), F.md5("content").alias("content_hash"))


@query("context_paragraphs", f"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\\n。！？]'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS ps FROM documents)
SELECT doc_id, CASE WHEN len(list_filter(ps, lambda x: length(x) >= 20)) = 0 THEN len(ps) ELSE len(list_filter(ps, lambda x: length(x) >= 20)) END AS paragraphs FROM p""")
def context_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.size(chunking.paragraphs(F.col("text"))).alias("paragraphs"))


@query("sentence_split", f"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？\\n]'), lambda x: {sql_strip('x')}), lambda x: length(x) >= 6)) AS sentences FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.size(chunking.sentences(F.col("text"), ".!?。！？\n")).alias("sentences"))


def _sentence_sql(source: str, keys: str = "doc_id", size: int = 800, overlap: int = 100, mark: str = "continued") -> str:
    """chunks: the texts of the relation ``source`` (keys, title, text) cut at sentence ends."""
    window = f"substring(text, a + 1, {size})"
    last = "CASE " + " ".join(f"WHEN contains(w, {d}) THEN length(regexp_extract(w, '(?s)^(.*){p}', 1))" for d, p in (("'.'", "[.]"), ("'!'", "!"), ("'?'", "[?]"), ("chr(10)", "[\\n]"))) + " ELSE 0 END"
    return f"""
cut_texts AS MATERIALIZED (SELECT *, length(text) AS n FROM {source} WHERE text IS NOT NULL),
steps AS (
  SELECT {keys}, 1 AS i, 0 AS a, CASE WHEN {size} < n AND {last} > 0 THEN {last} + 1 ELSE {size} END AS cut FROM (SELECT *, substring(text, 1, {size}) AS w FROM cut_texts WHERE n > {size})
  UNION ALL
  SELECT {keys}, i, a, CASE WHEN a + {size} < n AND {last} > 0 THEN {last} + 1 ELSE {size} END FROM (
    SELECT {keys}, i, a, n, {window} AS w FROM (
      SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, i + 1 AS i, a + CASE WHEN cut > {overlap} THEN cut - {overlap} ELSE {size // 4} END AS a, n, text FROM steps s JOIN cut_texts t USING ({keys})
    ) WHERE a < n - 50 AND i <= n // {size // 2} + 10)
),
sentence_parts AS (
  SELECT {keys}, title, a, a + cut AS b, {sql_strip('substring(text, a + 1, cut)')} AS chunk FROM steps JOIN cut_texts USING ({keys})
  UNION ALL SELECT {keys}, title, 0, n, text FROM cut_texts WHERE n <= {size}
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY a) - 1 AS chunk_index FROM sentence_parts WHERE chunk <> '' OR b <= {size} AND a = 0),
chunks AS (SELECT * EXCLUDE (chunk), CASE WHEN chunk_index > 0 THEN '[{mark}: ' || coalesce(title, '') || ']' || chr(10) || chr(10) || chunk ELSE chunk END AS chunk FROM numbered)"""


_MARK = "[continued: {}]\n\n"
_SENTENCES = ".!?\n"


@query("chunk_sentence", f"WITH RECURSIVE titled AS (SELECT doc_id, source AS title, text FROM documents), {_sentence_sql('titled')} SELECT doc_id, chunk_index, a AS chunk_start, b AS chunk_end, chunk_index > 0 AS is_continuation, md5(chunk) AS chunk FROM chunks")
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = corpus(spark, sf_dir).select("doc_id", F.col("source").alias("title"), "text")
    return chunking.sentence_chunks(titled, delimiters=_SENTENCES, mark=_MARK).select("doc_id", "chunk_index", "chunk_start", "chunk_end", "is_continuation", F.md5("chunk").alias("chunk"))


def _recursive_sql(size: int, overlap: int, separators: tuple[str, ...]) -> str:
    """The parts of a text level by level, then a fold over them that keeps the start of the chunk in work."""
    levels, before = [], "p0"
    for i, separator in enumerate(separators):
        literal = "||".join(f"chr({ord(c)})" for c in separator)
        todo = f"(length(piece) >= {size} OR node = -1)" + (f" AND contains(piece, {literal})" if separator else "")
        parts = f"list_transform(string_split(piece, {literal}), lambda x, i: CASE WHEN i > 1 THEN {literal} || x ELSE x END)" if separator else "string_split(piece, '')"
        levels.append(f"""
s{i} AS (SELECT doc_id, start, node, x, i FROM (SELECT doc_id, start, node, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT *, {parts} AS x FROM {before} WHERE {todo})) WHERE x <> ''),
p{i + 1} AS (SELECT doc_id, start + coalesce(sum(length(x)) OVER (PARTITION BY doc_id, start, node ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, start * {len(separators)} + {i} AS node, x AS piece FROM s{i}
  UNION ALL SELECT doc_id, start, node, piece FROM {before} WHERE NOT ({todo}))""")
        before = f"p{i + 1}"
    return f"""WITH p0 AS (SELECT doc_id, 0::BIGINT AS start, -1::BIGINT AS node, text AS piece FROM documents WHERE text <> ''),{','.join(levels)},
placed AS (SELECT doc_id, node, start, length(piece) AS len, min(start) OVER (PARTITION BY doc_id, node ORDER BY start RANGE BETWEEN least({overlap}, {size} - length(piece)) PRECEDING AND CURRENT ROW) AS first FROM {before}),
folded AS (
  SELECT doc_id, list_reduce(list({{'node': node, 'start': start, 'len': len, 'first': first, 'a': start, 'cuts': []::STRUCT(a BIGINT, b BIGINT)[]}} ORDER BY start), lambda s, x: {{
    'node': x.node, 'start': x.start, 'len': x.len, 'first': x.first,
    'a': CASE WHEN x.node <> s.node THEN x.start WHEN x.start - s.a + x.len > {size} AND x.start > s.a THEN x.first ELSE s.a END,
    'cuts': CASE WHEN x.node <> s.node OR (x.start - s.a + x.len > {size} AND x.start > s.a) THEN list_append(s.cuts, {{'a': s.a, 'b': s.start + s.len}}) ELSE s.cuts END}}) AS s FROM placed GROUP BY doc_id
),
ranges AS (SELECT doc_id, unnest(list_append(s.cuts, {{'a': s.a, 'b': s.start + s.len}})) AS r FROM folded),
stripped AS (SELECT doc_id, r.a AS start, r.b AS b, {sql_strip('substring(text, r.a + 1, r.b - r.a)')} AS chunk FROM ranges JOIN documents USING (doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, b) - 1 AS chunk_index, start, md5(chunk) AS chunk FROM stripped WHERE chunk <> ''"""


def _recursive(name: str, size: int, overlap: int, separators: tuple[str, ...]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cut = chunking.recursive_chunks(corpus(spark, sf_dir).select("doc_id", "text"), size, overlap, separators)
        return cut.select("doc_id", "chunk_index", "start", F.md5("chunk").alias("chunk"))

    query(name, _recursive_sql(size, overlap, separators))(run)


_recursive("chunk_recursive", 500, 50, ("\n\n", "\n", " ", ""))
# The rebuild's sizes, with the stops of the prose as separators.
_recursive("chunk_recursive_rebuild", 800, 100, ("\n\n", "\n", ".", "!", "?", " ", ""))


_HTML = r"""regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)</(p|h1|h2|h3|li|title|div|tr)>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t]+', ' ', 'g')"""


@query("page_text", f"SELECT page_id, length(t) AS chars, md5(t) AS text_hash FROM (SELECT page_id, {_HTML} AS t FROM pages)")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("t")).select("page_id", F.length("t").alias("chars"), F.md5("t").alias("text_hash"))


def _category_sql(column: str, least: int, weight: str = "") -> str:
    def score(terms: tuple[str, ...]) -> str:
        return "(" + " + ".join(f"((length({column}) - length(replace({column}, '{t}', ''))) / {len(t)})::INT * {len(t)}" for t in terms) + f"){weight}"

    scores = {n: score(t) for n, t in L.PROSE_CATEGORIES.items()}
    top = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {top} < {least} THEN NULL " + " ".join(f"WHEN {s} = {top} THEN '{n}'" for n, s in scores.items()) + " END"


_CATEGORY = f"SELECT doc_id, source, {_category_sql('t', 1)} AS category FROM (SELECT doc_id, source, lower(text) AS t FROM documents)"


@query("category_classify", f"SELECT doc_id, category FROM ({_CATEGORY})")
def category_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", classify.best_category(F.col("text"), L.PROSE_CATEGORIES).alias("category"))


@query("category_stats", f"SELECT category, count(*) AS documents, count(DISTINCT source) AS sources FROM ({_CATEGORY}) GROUP BY category")
def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = corpus(spark, sf_dir).select("source", classify.best_category(F.col("text"), L.PROSE_CATEGORIES).alias("category"))
    return named.groupBy("category").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))


@query("question_category", f"SELECT item_id AS query_id, {_category_sql('t', 3, ' * 2')} AS category FROM (SELECT item_id, lower(text) AS t FROM benchmark)")
def question_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", classify.best_category(F.col("question"), L.PROSE_CATEGORIES, 3, 2).alias("category"))


@query("hierarchical_retrieve", f"""WITH {SQL_BM25}, dc AS (SELECT doc_id AS chunk_id, category FROM ({_CATEGORY})), qc AS (SELECT item_id AS query_id, {_category_sql('t', 3, ' * 2')} AS category FROM (SELECT item_id, lower(text) AS t FROM benchmark)),
s AS (SELECT bm.query_id, bm.chunk_id, bm.score, coalesce(dc.category = qc.category, false) AS inside FROM bm JOIN dc USING (chunk_id) JOIN qc USING (query_id)),
w AS (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY query_id) AS n_inside, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM s),
r AS (SELECT query_id, chunk_id, inside, score, row_number() OVER (PARTITION BY query_id ORDER BY inside DESC, score DESC, chunk_id) AS rank FROM w WHERE inside OR (n_inside < 5 AND place <= 10 - n_inside))
SELECT * FROM r WHERE rank <= 10""")
def hierarchical_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the question's category; where they fill less than half the places, the best general hits besides."""
    docs, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    category = classify.best_category(F.col("text"), L.PROSE_CATEGORIES)
    qc = asked.select("query_id", classify.best_category(F.col("question"), L.PROSE_CATEGORIES, 3, 2).alias("qc"))
    # the k best of the category and the k best of all hold every row that counts
    inside = lexical.bm25_top_k(docs, asked, d_tokens(), q_tokens(), 10, kinds=(category, qc.withColumnRenamed("qc", "kind")))
    found = inside.unionByName(lexical.bm25_top_k(docs, asked, d_tokens(), q_tokens(), 10)).select("query_id", "chunk_id", "score").distinct()
    scored = found.join(docs.select("chunk_id", category.alias("dc")), "chunk_id").join(qc, "query_id")
    return staged.topped_up(scored.select("query_id", "chunk_id", F.coalesce(F.col("dc") == F.col("qc"), F.lit(False)).alias("inside"), "score"), 10)


_TYPES = {"question": (("what", "which", "the thing"), ("of the",)), "process": (("how", "ing "), ("ed and",)), "advice": (("should", "tion"), ("tion [a-z]+ing",))}


def _type_sql() -> str:
    scores = {n: "round(" + " + ".join([f"contains(t, '{k}')::INT * 0.3" for k in words] + [f"regexp_matches(t, '{p}')::INT * 0.5" for p in patterns]) + ", 6)" for n, (words, patterns) in _TYPES.items()}
    columns = ", ".join(f"({s})::DOUBLE AS s_{n}" for n, s in scores.items())
    names = [f"s_{n}" for n in scores]
    return f"""s AS (SELECT item_id AS query_id, {columns} FROM (SELECT item_id, text AS t FROM benchmark)),
p AS (SELECT *, greatest({', '.join(names)}) AS top, {' + '.join(names)} AS total FROM s)
SELECT query_id, CASE WHEN top > 0 AND top / total >= 0.3 THEN CASE {' '.join(f"WHEN s_{n} = top THEN '{n}'" for n in scores)} END ELSE 'factual' END AS kind, round(CASE WHEN top > 0 AND top / total >= 0.3 THEN top / total ELSE 0.5 END, 6) AS confidence FROM p"""


@query("open_question_type", f"WITH {_type_sql()}")
def open_question_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, sure = classify.weighted_type(F.col("question"), _TYPES, "factual")
    return questions(spark, sf_dir).select("query_id", kind.alias("kind"), sure.alias("confidence"))


_RULES = (("count", "[0-9]"), ("of", "of the"), ("thing", "thing"))


@query("question_type", "SELECT item_id AS query_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _RULES) + " ELSE 'general' END AS kind FROM benchmark")
def question_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", X.first_matching(F.col("question"), _RULES, "general").alias("kind"))


_FILLERS = ("the ", "and ", "of ", "that ", "is ")
_REWRITES = (("^That", "that which"), ("thing [a-z]+tion", "things"))


@query("query_rewrite", f"""WITH r AS (SELECT item_id AS query_id, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN '{v}'" for p, v in _REWRITES)} ELSE text END AS rewritten FROM benchmark),
f0 AS (SELECT item_id AS query_id, text AS t FROM benchmark)""" + "".join(f""",
f{i + 1} AS (SELECT query_id, CASE WHEN contains(t, '{w}') AND length(t) > {len(w) + 5} THEN trim(replace(t, '{w}', '')) ELSE t END AS t FROM f{i})""" for i, w in enumerate(_FILLERS)) + r"""
SELECT query_id, rewritten, regexp_replace(t, '\s+', ' ', 'g') AS cleaned FROM r JOIN f5 USING (query_id)""")
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("query_id", classify.rewrite(F.col("question"), _REWRITES).alias("rewritten"), classify.drop_fillers(F.col("question"), _FILLERS).alias("cleaned"))


@query("target_files", f"""WITH kw AS (SELECT source, list(term) AS keywords FROM (
  SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, term) AS r FROM (SELECT source, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY source, term QUALIFY r <= 10) GROUP BY source),
q AS (SELECT item_id AS query_id, text AS question, {sql_tokens('text')} AS words FROM benchmark),
s AS (SELECT query_id, source, round(list_sum(list_transform(keywords, lambda k: CASE WHEN contains(question, k) THEN 2.0 * length(k) WHEN list_contains(words, k) THEN 1.0 * length(k)
  WHEN len(list_filter(words, lambda w: contains(w, k) OR contains(k, w))) > 0 THEN 0.5 * length(k) ELSE 0.0 END)) / list_sum(list_transform(keywords, lambda k: 2.0 * length(k))), 6)::DOUBLE AS score FROM q, kw)
SELECT query_id, source, score FROM s WHERE score >= 0.6""")
def target_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose main words a question names: the ten most frequent words of each source."""
    counted = corpus(spark, sf_dir).select("source", F.explode(d_tokens()).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"))
    words = lexical.top_k(counted, 10, (F.desc("n"), F.asc("term")), partition="source").select("source", "term")
    return substrings.named_files(questions(spark, sf_dir), q_tokens(), words)


@query("doc_stats", "SELECT count(*) AS documents, sum(length(text))::BIGINT AS characters, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages, round(avg(length(text)), 6) AS mean_characters FROM documents")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.corpus_report(corpus(spark, sf_dir))


@query("source_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_counts(corpus(spark, sf_dir))


@query("run_report", "SELECT count(*) AS runs, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value >= 10) AS slow FROM events")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_report(table(spark, sf_dir, "events"), F.col("value"), {"errors": F.col("event_type") == "error", "slow": F.col("value") >= 10})


@query("usage_flags", "SELECT user_id, coalesce(bool_or(event_type = 'error'), false) AS error, coalesce(bool_or(event_type = 'purchase'), false) AS purchase FROM events GROUP BY user_id")
def usage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.usage_flags(table(spark, sf_dir, "events"), "user_id", {"error": F.col("event_type") == "error", "purchase": F.col("event_type") == "purchase"})


@query("assessment_grade", "SELECT user_id, round(avg(value) / 100, 6) AS score, CASE WHEN avg(value) / 100 >= 0.9 AND count(*) > 5 AND min(value) < 10 THEN 'A+' WHEN avg(value) / 100 >= 0.8 AND count(*) > 5 THEN 'A' WHEN avg(value) / 100 >= 0.6 THEN 'B' ELSE 'C' END AS grade FROM events GROUP BY user_id")
def assessment_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg((F.avg("value") / 100).alias("s"), F.count("*").alias("n"), F.min("value").alias("least"))
    return runs.select("user_id", F.round("s", 6).alias("score"), reports.grade(F.col("s"), F.col("n") > 5, F.col("least")).alias("grade"))


_ANSWERS = """said AS (SELECT conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant'),
asked AS (SELECT conv_id, turn + 1 AS turn, text AS question FROM conversations WHERE role = 'user'),
ctx AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS context, count(*) AS n FROM conversations WHERE role <> 'assistant' GROUP BY conv_id),
answers AS (SELECT conv_id * 1000 + turn AS answer_id, question, answer, context FROM said JOIN asked USING (conv_id, turn) JOIN ctx USING (conv_id))"""


@query("batch_answers", f"""WITH {_ANSWERS}, n AS (SELECT answer_id, len({sql_tokens('question')}) AS n_sources, row_number() OVER (ORDER BY answer_id) AS i FROM answers)
SELECT answer_id, 'Q' || CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS number, printf('%.2f', least(n_sources / 10, 1.0)) AS confidence, n_sources FROM n""")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir).select("answer_id", F.size(q_tokens()).alias("n_sources"))
    return reports.answer_records(rows, ("answer_id",)).select("answer_id", "number", "confidence", "n_sources")


@query("context_stats", f"""WITH {SQL_BM25} SELECT query_id, count(*) AS texts, sum(length(text))::BIGINT AS characters, round(avg(length(text)), 6) AS mean_characters, count(DISTINCT source) AS sources FROM hits GROUP BY query_id""")
def context_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_hits(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("characters"), F.round(F.avg(F.length("text")), 6).alias("mean_characters"), F.countDistinct("source").alias("sources"))


#: Two pages of the table are a file.
_FILE = 2
_FILES = f"""page_texts AS (SELECT page_id // {_FILE} AS path, page_id AS page, {_HTML} AS text FROM pages),
spans AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY path ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, sum(length(text) + 1) OVER (PARTITION BY path ORDER BY page)::BIGINT AS e FROM page_texts),
files AS (SELECT path AS doc_id, string_agg(text || chr(10), '' ORDER BY page) AS text FROM page_texts GROUP BY path)"""


def _load_sql() -> str:
    tagged = lambda words, prefix: f"array_to_string(list_transform({words}, lambda w: ' {prefix}' || w), '')"
    level = "CASE " + " ".join(f"WHEN regexp_matches(first_line, '{p}') THEN {n}" for n, p in L.PAGE_LEVELS) + " ELSE 2 END"
    found = _sections_sql(L.PAGE_SECTIONS, "files")
    content = f"""CASE level {' '.join(f"WHEN {n} THEN '{m}'" for n, m in _MARKS.items())} END || title || {tagged(f"list_filter({sql_list(L.PROSE_KEYWORDS)}, lambda w: contains(title, w))", _TAGS[0])} || {tagged('e', _TAGS[1])} || {tagged('list_filter(e, lambda w: contains(body, w) AND NOT contains(title, w))', _TAGS[2])} || chr(10) || chr(10) || body"""
    return f"""WITH RECURSIVE {_FILES},{found},
lined AS (SELECT *, {sql_strip("string_split(body, chr(10))[1]")} AS first_line, ['file ' || doc_id] AS e FROM sections WHERE body <> ''),
titled AS (SELECT doc_id, section_idx, title, body_pos, length(body) AS size, level, {content} AS text, length({content}) - length(body) AS head FROM (SELECT *, {level} AS level FROM lined)),{_sentence_sql('titled', 'doc_id, section_idx')},
chunked AS (SELECT c.doc_id AS path, c.section_idx, c.title, t.level, c.chunk_index, md5(c.chunk) AS chunk, (SELECT string_agg(page, ',' ORDER BY page) FROM spans p WHERE p.path = c.doc_id AND p.s < t.body_pos + least(greatest(c.b - t.head, 1), t.size) AND p.e > t.body_pos + least(greatest(c.a - t.head, 0), t.size)) AS pages
  FROM chunks c JOIN titled t ON t.doc_id = c.doc_id AND t.section_idx = c.section_idx),
loose AS (SELECT path, page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS paragraph_index FROM page_texts WHERE path NOT IN (SELECT doc_id FROM sections WHERE body <> '')),
marked AS (SELECT *, list_filter({sql_list(L.PROSE_KEYWORDS)}, lambda k: contains(p, k)) AS tags FROM (SELECT path, page, paragraph_index, {sql_strip('raw')} AS p FROM loose) WHERE length(p) >= 20)
SELECT * FROM chunked UNION ALL
SELECT path, NULL, NULL, NULL, paragraph_index, md5(CASE WHEN len(tags) > 0 THEN '[' || array_to_string(tags, '][') || ']' || chr(10) || chr(10) || p ELSE p END), page::VARCHAR FROM marked"""


@query("full_load", _load_sql())
def full_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two pages by chapters, each chunk with its pages; files without chapters by paragraphs."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / _FILE).alias("path"), F.col("page_id").alias("page"), html_text(F.col("html")).alias("text"))
    entities = F.array(F.concat(F.lit("file "), F.col("path").cast("string")))
    cut = chunking.load_chapters(pages, L.PAGE_SECTIONS, L.PAGE_LEVELS, L.PROSE_KEYWORDS, entities, _MARKS, _TAGS, delimiters=_SENTENCES, mark=_MARK)
    return cut.select("path", "section_idx", "title", "level", "chunk_index", F.md5("chunk").alias("chunk"), F.array_join(F.array_sort("pages"), ",").alias("pages"))
