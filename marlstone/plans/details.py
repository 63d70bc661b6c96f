"""Named queries: strategies, projections, tags, prompts and retrieval reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import lexicons as L
from marlstone.functions import models
from marlstone.functions import text as X
from marlstone.operators import classify, fusion, lexical, reports, vector
from marlstone.operators.chunking import sentences
from marlstone.plans.answering import DELIMITERS, FACT_INDICATORS
from marlstone.plans.registry import query
from marlstone.plans.retrieval import _CHANNELS, _PAIR, SQL_BM25, SQL_CORPUS, _rrf, bm25_hits, channels, sql_list
from marlstone.plans.textual import _ANSWERS, _TYPES, _type_sql, sql_strip
from marlstone.sources.tables import answers, corpus, questions, table


@query("strategy_select", f"""SELECT query_id, CASE WHEN confidence > 0.3 THEN 0.3 ELSE 0.5 END::DOUBLE AS alpha, CASE WHEN confidence > 0.3 THEN 15 ELSE 20 END AS vector_k, CASE WHEN confidence > 0.3 THEN 35 ELSE 30 END AS bm25_k FROM (WITH {_type_sql()})""")
def strategy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sure = classify.weighted_type(F.col("question"), _TYPES, "factual")
    return questions(spark, sf_dir).select("query_id", classify.retrieval_strategy(sure).alias("s")).select("query_id", "s.*")


_KEYWORD = "list_filter({}, lambda k: contains(text, k))".format(sql_list(L.PROSE_KEYWORDS))


@query("query_expansion", f"SELECT item_id AS query_id, CASE WHEN len({_KEYWORD}) > 0 THEN ({_KEYWORD})[1] || ' ' || text ELSE text END AS expanded FROM benchmark")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question with its first known keyword in front."""
    found = F.filter(F.array(*[F.lit(k) for k in L.PROSE_KEYWORDS]), lambda k: F.contains("question", k))
    return questions(spark, sf_dir).select("query_id", F.concat_ws(" ", F.get(found, 0), "question").alias("expanded"))


@query("text_projection", "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '…' ELSE text END) AS excerpt_hash, CASE WHEN contains(text, 'the') THEN nullif(regexp_extract(text, '[0-9]{2,4}[-./][0-9]{1,4}'), '') END AS first_number FROM documents")
def text_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    excerpt = F.when(F.length("text") > 500, F.concat(F.substring("text", 1, 500), F.lit("…"))).otherwise(F.col("text"))
    number = F.regexp_extract("text", "[0-9]{2,4}[-./][0-9]{1,4}", 0)
    return corpus(spark, sf_dir).select("doc_id", F.md5(excerpt).alias("excerpt_hash"), F.when(F.contains("text", F.lit("the")) & (number != ""), number).alias("first_number"))


@query("page_names", r"SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '') AS name FROM pages")
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", "").alias("name"))


@query("keyword_tags", f"SELECT doc_id, array_to_string({_KEYWORD}, ',') AS tags FROM documents")
def keyword_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", F.array_join(F.filter(F.array(*[F.lit(k) for k in L.PROSE_KEYWORDS]), lambda k: F.contains("text", k)), ",").alias("tags"))


@query("rank_score", f"WITH {SQL_BM25} SELECT query_id, chunk_id, round(1.0 - 0.1 * (rank - 1), 6)::DOUBLE AS shown FROM hits")
def rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_hits(spark, sf_dir).select("query_id", "chunk_id", F.round(1.0 - 0.1 * (F.col("rank") - 1), 6).alias("shown"))


_TERMS = [(n, t) for n, terms in L.PROSE_CATEGORIES.items() for t in terms]
_TERM_ROWS = ", ".join(f"('{n}', '{t}')" for n, t in _TERMS)


@query("question_debug", f"""SELECT item_id AS query_id, n AS category, t AS term, ((length(text) - length(replace(lower(text), t, ''))) / length(t))::INT AS matches, ((length(text) - length(replace(lower(text), t, ''))) / length(t))::INT * length(t) * 2 AS score
FROM benchmark, (VALUES {_TERM_ROWS}) AS r(n, t) WHERE contains(lower(text), t)""")
def question_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array(*[F.struct(F.lit(n).alias("category"), F.lit(t).alias("term")) for n, t in _TERMS])
    found = questions(spark, sf_dir).select("query_id", F.lower("question").alias("q"), F.explode(rules).alias("r")).select("query_id", "q", "r.*")
    counted = found.withColumn("matches", X.occurrences(F.col("q"), F.col("term"))).filter("matches > 0")
    return counted.select("query_id", "category", "term", "matches", (F.col("matches") * F.length("term") * 2).alias("score"))


@query("information_probe", f"""WITH {SQL_CORPUS}, m AS (SELECT k AS name, chunk_id, source, round(((length(text) - length(replace(text, k, ''))) / length(k))::INT / (length(text) + 1) * 1000, 6) AS score FROM d, (SELECT unnest({sql_list(L.PROSE_KEYWORDS)}) AS k) WHERE contains(text, k)),
t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, chunk_id) AS r FROM m QUALIFY r <= 3)
SELECT name, count(*) AS texts, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM t GROUP BY name""")
def information_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each known name its three best texts and their sources."""
    docs = corpus(spark, sf_dir)
    top = lexical.top_k(lexical.phrase_matches(docs, L.PROSE_KEYWORDS), 3, partition="phrase").join(docs.select("chunk_id", "source"), "chunk_id")
    return top.groupBy(F.col("phrase").alias("name")).agg(F.count("*").alias("texts"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


_TEMPLATES = {"of": "Answer from the parts listed.\n{context}\nQuestion: {question}", "thing": "State the requirements only.\n{context}\nQuestion: {question}", "general": "Use the context.\n{context}\nQuestion: {question}"}


def _template_sql() -> str:
    def one(t: str) -> str:
        head, rest = t.split("{context}")
        middle = rest.split("{question}")[0]
        quoted = lambda s: " || chr(10) || ".join(f"'{p}'" for p in s.split("\n"))
        return f"{quoted(head)} || text || {quoted(middle)} || question"

    return f"CASE WHEN regexp_matches(question, 'of the') THEN {one(_TEMPLATES['of'])} WHEN regexp_matches(question, 'thing') THEN {one(_TEMPLATES['thing'])} ELSE {one(_TEMPLATES['general'])} END"


@query("prompt_selection", f"WITH {SQL_BM25} SELECT query_id, md5({_template_sql()}) AS prompt_hash, length({_template_sql()}) AS chars FROM hits WHERE rank = 1")
def prompt_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template that the question's type asks for, filled with the best text."""
    kind = X.first_matching(F.col("question"), (("of", "of the"), ("thing", "thing")), "general")
    template = F.create_map(*[F.lit(x) for pair in _TEMPLATES.items() for x in pair])[kind]
    prompt = F.replace(F.replace(template, F.lit("{question}"), F.col("question")), F.lit("{context}"), F.col("text"))
    return bm25_hits(spark, sf_dir).filter("rank = 1").select("query_id", prompt.alias("p")).select("query_id", F.md5("p").alias("prompt_hash"), F.length("p").alias("chars"))


@query("answer_predicates", f"""WITH {_ANSWERS} SELECT answer_id, regexp_matches(answer, '{L.DATE_PATTERN}') AS is_date, len(list_filter(list_transform(regexp_split_to_array(answer, '[.!?\\n]'), lambda x: {sql_strip('x')}), lambda s: length(s) >= 6 AND regexp_matches(s, '{FACT_INDICATORS}'))) AS factual_sentences FROM answers""")
def answer_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    factual = F.filter(sentences(F.col("answer"), DELIMITERS), lambda s: s.rlike(FACT_INDICATORS))
    return answers(spark, sf_dir).select("answer_id", F.col("answer").rlike(L.DATE_PATTERN).alias("is_date"), F.size(factual).alias("factual_sentences"))


@query("retrieval_log", f"WITH {SQL_BM25} SELECT source, count(*) AS n FROM hits GROUP BY source")
def retrieval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_counts(bm25_hits(spark, sf_dir))


_BY_TEXT = f"{_CHANNELS}, named AS (SELECT own.query_id, own.channel, md5(d.text) AS key, own.rank FROM own JOIN d ON d.chunk_id = own.key), worst AS (SELECT query_id, key, channel, max(rank) AS rank FROM named GROUP BY ALL)"


@query("rrf_by_content", f"WITH {_BY_TEXT}, {_rrf(_PAIR, 'worst')} SELECT query_id, key, rrf_score, rank FROM fused")
def rrf_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion keyed by the text itself: copies meet, and the last of them counts."""
    texts = corpus(spark, sf_dir).select(F.col("chunk_id").alias("key"), F.md5("text").alias("text_key"))
    named = channels(spark, sf_dir).join(texts, "key").drop("key").withColumnRenamed("text_key", "key")
    return fusion.reciprocal_rank_fusion(named, _PAIR).drop("ranks")


@query("hashed_vector_search")
def hashed_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions against documents by the default embedder, ten nearest each."""
    docs = corpus(spark, sf_dir).select("chunk_id", models.embedding(F.col("text")).alias("embedding"))
    asked = questions(spark, sf_dir).select("query_id", models.embedding(F.col("question")).alias("embedding"))
    return vector.top_k(asked, docs, 10)
