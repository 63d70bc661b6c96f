"""Named queries: context packing, grounding of answers, knowledge fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import lexicons as L
from marlstone.functions import text as X
from marlstone.operators import answer, context, grounding, rerank, validate
from marlstone.plans.registry import ORACLE_SQL, QUERIES, query
from marlstone.plans.retrieval import K, SQL_BM25, bm25_hits, q_tokens, sql_list, sql_tokens, swap
from marlstone.plans.textual import _ANSWERS, sql_strip
from marlstone.sources.tables import answer_turns, answers, corpus, materialise, questions, table

#: The prose of the test tables ends its sentences with these.
DELIMITERS = ".!?\n"
FACT_PATTERNS = (r"[0-9]+", r"[A-Z][a-z]+tion", r"[a-z]+@[a-z]+")
FACT_INDICATORS = "[0-9]|tion|thing"

_PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array(text, '[\\n。！？]'), lambda x: {sql_strip('x')}), lambda x: x <> '')"


def _grams(c: str) -> str:
    return f"list_concat({c}, list_transform(range(1, len({c})), lambda i: {c}[i] || {c}[i + 1]), list_transform(range(1, len({c}) - 1), lambda i: {c}[i] || {c}[i + 1] || {c}[i + 2]))"


_ADAPTIVE = {"thing": (0.9, 0.1), "of the": (0.7, 0.3), "tion": (0.5, 0.5)}


def _scored_sql(by_word: str = "0.4", by_text: str = "0.6") -> str:
    return f"""{SQL_BM25},
best AS (SELECT query_id, question, text FROM hits WHERE rank = 1),
ps AS (SELECT query_id, question, {_PARAGRAPHS} AS all_ps FROM best),
kept AS (SELECT query_id, question, CASE WHEN len(list_filter(all_ps, lambda x: length(x) >= 20)) = 0 THEN all_ps ELSE list_filter(all_ps, lambda x: length(x) >= 20) END AS ps FROM ps),
cut AS (SELECT query_id, question, unnest(ps) AS paragraph, generate_subscripts(ps, 1) - 1 AS idx FROM kept),
letters AS (SELECT query_id, idx, string_split(lower(question), '') AS a, string_split(lower(paragraph), '') AS b FROM cut),
g AS (SELECT query_id, idx, unnest({_grams('a')}) AS gram, 1 AS x, 0 AS y FROM letters UNION ALL SELECT query_id, idx, unnest({_grams('b')}), 0, 1 FROM letters),
c AS (SELECT query_id, idx, gram, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y FROM g GROUP BY ALL), w AS (SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1.0 ELSE ln(1.5) + 1 END AS w FROM c),
alike AS (SELECT query_id, idx, round(coalesce(sum(x * y * w * w) / nullif(sqrt(sum(x * x * w * w) * sum(y * y * w * w)), 0), 0), 6) AS similarity FROM w GROUP BY query_id, idx),
meas AS (SELECT query_id, idx, question, paragraph, ({sql_tokens('question')})[1:10] AS words, similarity, length(paragraph) AS n FROM cut JOIN alike USING (query_id, idx)),
scored AS (SELECT query_id, idx, paragraph, n, round(({by_word} * coalesce(len(list_filter(words, lambda w: contains(lower(paragraph), w)))::DOUBLE / nullif(len(words), 0), 0) + {by_text} * similarity)
  * CASE WHEN n < 50 THEN greatest(0.5, n / 50) WHEN n <= 300 THEN 1.0 ELSE greatest(0.5, 300 / n) END, 6) AS score FROM meas)"""


_SCORED = _scored_sql()
_COMPRESSED = """
placed AS (SELECT *, row_number() OVER w AS place, sum(n) OVER (PARTITION BY query_id ORDER BY score DESC, idx ROWS UNBOUNDED PRECEDING) AS running FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, idx)),
shown AS (SELECT query_id, place, CASE WHEN place = 1 AND running > 1500 THEN substring(paragraph, 1, 1497) || '...' ELSE paragraph END AS p FROM placed WHERE running <= 1500 OR place = 1),
joined AS (SELECT query_id, string_agg(p, chr(10) || chr(10) ORDER BY place) AS context, count(*) AS kept FROM shown GROUP BY query_id),
fitted AS (SELECT query_id, text, CASE WHEN length(text) <= 1500 THEN text ELSE coalesce(context, '') END AS context, coalesce(kept, 0) AS kept FROM best LEFT JOIN joined USING (query_id))
SELECT query_id, md5(context) AS context_hash, kept, round(coalesce(length(context) / nullif(length(text), 0), 1.0), 6) AS ratio FROM fitted"""


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_hits(spark, sf_dir).filter("rank = 1").select("query_id", "question", "text")


@query("paragraph_scores", f"WITH {_SCORED} SELECT query_id, idx, md5(paragraph) AS paragraph_hash, score FROM scored")
def paragraph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = context.paragraph_scores(_best(spark, sf_dir), F.slice(q_tokens(), 1, 10))
    return scored.select("query_id", "idx", F.md5("paragraph").alias("paragraph_hash"), "score")


@query("context_compress", f"WITH {_SCORED}, {_COMPRESSED}")
def context_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best(spark, sf_dir)
    return context.compress(context.paragraph_scores(best, F.slice(q_tokens(), 1, 10)), best).select("query_id", F.md5("context").alias("context_hash"), "kept", "ratio")


def _by_type(part: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(question, '{p}') THEN {w[part]}" for p, w in _ADAPTIVE.items()) + f" ELSE {(0.4, 0.6)[part]} END"


@query("adaptive_compress", f"WITH {_scored_sql(_by_type(0), _by_type(1))}, {_COMPRESSED}")
def adaptive_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of keywords and similarity follow the question's type."""
    best = _best(spark, sf_dir)

    def weight(part: int) -> Column:
        out = F.lit((0.4, 0.6)[part])
        for pattern, weights in reversed(_ADAPTIVE.items()):
            out = F.when(F.col("question").rlike(pattern), weights[part]).otherwise(out)
        return out

    scored = context.paragraph_scores(best, F.slice(q_tokens(), 1, 10), weight(0), weight(1))
    return context.compress(scored, best).select("query_id", F.md5("context").alias("context_hash"), "kept", "ratio")


@query("tfidf_similarity", f"""WITH {SQL_BM25}, p AS (SELECT query_id AS pair_id, string_split(lower(question), '') AS a, string_split(lower(text), '') AS b FROM hits WHERE rank = 1),
g AS (SELECT pair_id, unnest({_grams('a')}) AS gram, 1 AS x, 0 AS y FROM p UNION ALL SELECT pair_id, unnest({_grams('b')}), 0, 1 FROM p),
c AS (SELECT pair_id, gram, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y FROM g GROUP BY ALL), w AS (SELECT *, CASE WHEN x > 0 AND y > 0 THEN 1.0 ELSE ln(1.5) + 1 END AS w FROM c)
SELECT pair_id, round(coalesce(sum(x * y * w * w) / nullif(sqrt(sum(x * x * w * w) * sum(y * y * w * w)), 0), 0), 6) AS similarity FROM w GROUP BY pair_id""")
def tfidf_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = bm25_hits(spark, sf_dir).filter("rank = 1").select(F.col("query_id").alias("pair_id"), F.col("question").alias("a"), F.col("text").alias("b"))
    return context.tfidf_similarity(best)


@query("context_budget", f"""WITH {SQL_BM25}, b AS (SELECT query_id, rank, '[' || rank || '] ' || source || chr(10) || text AS block FROM hits),
e AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS e FROM b),
s AS (SELECT query_id, rank, CASE WHEN e <= 1500 THEN block WHEN 1500 - (e - length(block)) > 100 THEN substring(block, 1, (1500 - (e - length(block)))::BIGINT) || '...' END AS shown FROM e)
SELECT query_id, md5(string_agg(shown, chr(10) || chr(10) ORDER BY rank)) AS context_hash, count(*) AS texts FROM s WHERE shown IS NOT NULL GROUP BY query_id""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.budgeted_context(bm25_hits(spark, sf_dir)).select("query_id", F.md5("context").alias("context_hash"), "texts")


@query("format_context", f"""WITH {SQL_BM25} SELECT query_id, md5(string_agg('Document ' || rank || ' (source: ' || source || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS formatted_hash FROM hits GROUP BY query_id""")
def format_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.formatted_documents(bm25_hits(spark, sf_dir)).select("query_id", F.md5("formatted").alias("formatted_hash"))


_KINDS = {"of": (("of the", "tion"), 0.3), "general": (("thing", "and"), 0.25)}


@query("context_relevance", f"""WITH {SQL_BM25}, t AS (SELECT *, CASE WHEN regexp_matches(question, 'of the') THEN 'of' ELSE 'general' END AS kind FROM hits),
n AS (SELECT *, CASE kind WHEN 'of' THEN contains(text, 'of the')::INT + contains(text, 'tion')::INT ELSE contains(text, 'thing')::INT + contains(text, 'and')::INT END AS keywords FROM t),
s AS (SELECT query_id, chunk_id, keywords, round(keywords * CASE kind WHEN 'of' THEN 0.3 ELSE 0.25 END + CASE WHEN contains(text, '|') THEN 0.2 ELSE 0.0 END + CASE WHEN contains(text, '!!') THEN 0.3 ELSE 0.0 END, 6)::DOUBLE AS relevance FROM n)
SELECT query_id, chunk_id, keywords, relevance, relevance >= 0.3 AND keywords >= 1 AS relevant FROM s""")
def context_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = X.first_matching(F.col("question"), (("of", "of the"),), "general")
    score, n = rerank.context_relevance(kind, F.col("text"), _KINDS, "|", "!!")
    return bm25_hits(spark, sf_dir).select("query_id", "chunk_id", n.alias("keywords"), score.alias("relevance"), ((score >= 0.3) & (n >= 1)).alias("relevant"))


def _one(name: str, sql: str, part: Callable[[DataFrame, DataFrame], DataFrame], column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        said, turns = answer_turns(spark, sf_dir)
        said = said.join(turns.select("group").distinct(), "group", "left_semi")
        return part(said, turns).select("answer_id", F.col(column).alias("share"))

    query(name, f"WITH {_ANSWERS} SELECT answer_id, round({sql}, 6) AS share FROM answers")(run)


def _tokens(column: str) -> str:
    return rf"regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}]+')"


def _bigrams(column: str) -> str:
    t = _tokens(column)
    return f"list_distinct(list_transform((list_zip({t}, ({t})[2:]))[:len({t}) - 1], lambda x: x[1] || ' ' || x[2]))"


def _share(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}), 0), 0)"


_ROUGE = _share(f"list_distinct({_tokens('answer')})", f"list_distinct({_tokens('context')})")
_BLEU = _share(_bigrams("answer"), _bigrams("context"))
_CHARS = _share(*[f"list_distinct(string_split(regexp_replace(lower({c}), '[ \\n]', '', 'g'), ''))" for c in ("answer", "context")])
_one("rouge1", _ROUGE, grounding.shared_tokens, "rouge")
_one("bleu2", _BLEU, grounding.shared_bigrams, "bleu")
_one("char_overlap", _CHARS, grounding.shared_characters, "overlap")


def _facts(column: str) -> str:
    matched = "list_concat(" + ", ".join(f"regexp_extract_all({column}, '{p}')" for p in FACT_PATTERNS) + ")"
    distinct = f"list_filter(list_transform({matched}, lambda x, i: CASE WHEN list_position({matched}, x) = i THEN x END), lambda x: x IS NOT NULL)"
    said = f"list_filter(list_transform(regexp_split_to_array({column}, '[.!?\\n]'), lambda x: {sql_strip('x')}), lambda x: length(x) >= 6 AND regexp_matches(x, '{FACT_INDICATORS}'))"
    return f"list_concat({distinct}, {said})"


@query("fact_extract", f"WITH {_ANSWERS} SELECT answer_id, len(f) AS facts, md5(array_to_string(f, '|')) AS facts_hash FROM (SELECT answer_id, {_facts('answer')} AS f FROM answers)")
def fact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.facts(F.col("answer"), FACT_PATTERNS, FACT_INDICATORS, DELIMITERS)
    return answers(spark, sf_dir).select("answer_id", found.alias("f")).select("answer_id", F.size("f").alias("facts"), F.md5(F.array_join("f", "|")).alias("facts_hash"))


_RULES = {"patterns": FACT_PATTERNS, "indicators": FACT_INDICATORS, "delimiters": DELIMITERS}


@query("fact_support")
def fact_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each answer, and those that its context supports by equality, edit ratio or words."""
    return grounding.support(*answer_turns(spark, sf_dir), **_RULES).select("answer_id", F.col("n_facts").alias("facts"), F.col("n_supported").alias("supported"))


_VALID = f"""{_ANSWERS},
m AS (SELECT answer_id, round({_ROUGE}, 6) AS rouge, round({_BLEU}, 6) AS bleu, round({_CHARS}, 6) AS overlap, {_facts('answer')} AS f, {_facts('context')} AS k FROM answers),
n AS (SELECT *, len(f) AS n_facts, len(list_filter(f, lambda x: list_contains(k, x))) AS n_supported, 0.3 * rouge + 0.2 * bleu + 0.5 * overlap AS wo, rouge < 0.3 AND bleu < 0.2 AND overlap < 0.25 AS off_topic,
  regexp_matches(array_to_string(f, ' '), '{L.DATE_PATTERN}') AS dated FROM m),
br AS (SELECT *, CASE WHEN dated AND overlap >= 0.5 THEN 1 WHEN dated THEN 2 WHEN overlap >= 0.8 THEN 3 WHEN wo >= 0.6 THEN 4 ELSE 5 END AS b FROM n),
base AS (SELECT *, greatest(0.0, wo * [0.9, 0.8, 0.85, 0.8, 0.65][b]::DOUBLE + CASE WHEN n_facts > 0 THEN n_supported / n_facts * [0.1, 0.2, 0.15, 0.2, 0.35][b]::DOUBLE ELSE [0.1, 0.2, 0.15, 0.2, 0.35][b]::DOUBLE END - (n_facts - n_supported) * [0.01, 0.02, 0.02, 0.03, 0.05][b]::DOUBLE) AS c FROM br),
v AS (SELECT answer_id, rouge, bleu, overlap, n_facts, n_supported, off_topic, round(least(1.0, c * CASE WHEN b = 1 THEN 1.2 WHEN overlap >= 0.8 THEN 1.15 WHEN wo >= 0.7 THEN 1.1 ELSE 1.0 END), 6)::DOUBLE AS confidence, round(coalesce(n_supported::DOUBLE / nullif(n_facts, 0), 1.0), 6)::DOUBLE AS coverage FROM base)"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By equal facts alone, which SQL can repeat."""
    return grounding.validate(*answer_turns(spark, sf_dir), **_RULES, fuzzy=False)


@query("answer_confidence", f"WITH {_VALID} SELECT *, off_topic OR confidence < 0.2 AS hallucination FROM v")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir)


@query("validation_stats", f"""WITH {_VALID} SELECT count(*) AS answers, round(avg((off_topic OR confidence < 0.2)::INT), 6) AS hallucination_rate, round(avg(confidence), 6) AS mean_confidence, round(avg(coverage), 6) AS mean_coverage,
  count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence < 0.5) AS low FROM v""")
def validation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validation_stats(_validated(spark, sf_dir))


_PAIRS = (("not ", "tion"), ("no ", "thing"))


#: Numbers of three digits and more stand for the times of the prose.
_TIMES = ("[0-9]{3,}",)
_CHECKED = f"""{_VALID}, t AS (SELECT *, list_distinct(regexp_extract_all(answer, '[\\p{{L}}\\p{{N}}]+')) AS a, list_distinct(regexp_extract_all(context, '[\\p{{L}}\\p{{N}}]+')) AS c, list_distinct(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}]+')) AS q FROM answers),
checks AS (SELECT answer_id, ((contains(answer, 'not ') AND contains(context, 'tion')) OR (contains(answer, 'no ') AND contains(context, 'thing'))) AND len(list_intersect(a, c)) > 3 AS contradicts,
  len(list_filter(regexp_extract_all(answer, '{_TIMES[0]}'), lambda x: NOT list_contains(regexp_extract_all(context, '{_TIMES[0]}'), x))) = 0 AS times_agree,
  length(answer) >= 10 AND NOT contains(answer, 'unknown') AND len(list_intersect(list_filter(q, lambda x: length(x) >= 2), list_filter(a, lambda x: length(x) >= 2))) >= 0.3 * len(list_filter(q, lambda x: length(x) >= 2)) AS complete FROM t),
checked AS (SELECT answer_id, contradicts, times_agree, complete, off_topic, CASE WHEN contradicts OR NOT times_agree OR NOT complete THEN round(confidence * 0.8, 6) ELSE confidence END AS confidence FROM v JOIN checks USING (answer_id))"""
_CHECKS = {"pairs": _PAIRS, "times": _TIMES, "uncertain": ("unknown",)}


@query("enhanced_validation", f"WITH {_CHECKED} SELECT answer_id, contradicts, times_agree, complete, confidence, off_topic OR confidence < 0.2 AS hallucination FROM checked")
def enhanced_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks for contradictions, times and completeness lower the confidence of the plain validation."""
    checked = grounding.enhance(_validated(spark, sf_dir), *answer_turns(spark, sf_dir), **_CHECKS)
    return checked.select("answer_id", "contradicts", "times_agree", "complete", "confidence", "hallucination")


@query("validated_answers")
def validated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole validation: facts supported by equality, edit ratio or words, and all checks."""
    said, turns = answer_turns(spark, sf_dir)
    return grounding.enhance(grounding.validate(said, turns, **_RULES), said, turns, **_CHECKS)


_MISSING = {"of": ("number", "[0-9]"), "general": ("thing", "thing")}


@query("missing_info", f"""WITH {_ANSWERS}, t AS (SELECT *, CASE WHEN regexp_matches(question, 'of the') THEN 'of' ELSE 'general' END AS kind FROM answers)
SELECT answer_id, kind, CASE WHEN kind = 'general' AND NOT regexp_matches(answer, 'thing') AND regexp_matches(context, 'thing') THEN 'thing' WHEN kind = 'of' AND NOT regexp_matches(answer, '[0-9]') AND regexp_matches(context, '[0-9]') THEN 'number' END AS missing FROM t""")
def missing_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = X.first_matching(F.col("question"), (("of", "of the"),), "general")
    return answers(spark, sf_dir).select("answer_id", kind.alias("kind"), validate.missing_information(kind, F.col("answer"), F.col("context"), _MISSING).alias("missing"))


@query("answer_quality", f"WITH {_ANSWERS} SELECT answer_id, least(CASE WHEN length(answer) > 20 THEN 0.2 ELSE 0.0 END + 0.2 * (" + " + ".join(f"contains(answer, '{t}')::INT" for t in L.PROSE_KEYWORDS) + "), 1.0)::DOUBLE AS quality FROM answers")
def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = sum((F.contains("answer", F.lit(t)).cast("int") for t in L.PROSE_KEYWORDS), F.lit(0))
    return answers(spark, sf_dir).select("answer_id", F.round(F.least(F.when(F.length("answer") > 20, 0.2).otherwise(0.0) + 0.2 * hits, F.lit(1.0)), 6).alias("quality"))


@query("template_answer", f"""WITH {SQL_BM25} SELECT query_id, CASE WHEN regexp_matches(question, 'of the') THEN 'According to the documents: ' WHEN regexp_matches(question, 'thing') THEN 'The requirements are: ' ELSE 'From the documents: ' END
  || md5(CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END) AS answer FROM hits WHERE rank = 1""")
def template_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule-based answer: a prefix by the question's wording and an excerpt of the best text."""
    head = X.first_matching(F.col("question"), (("According to the documents: ", "of the"), ("The requirements are: ", "thing")), "From the documents: ")
    excerpt = F.when(F.length("text") > 300, F.concat(F.substring("text", 1, 300), F.lit("..."))).otherwise(F.col("text"))
    return bm25_hits(spark, sf_dir).filter("rank = 1").select("query_id", F.concat(head, F.md5(excerpt)).alias("answer"))


@query("knowledge_fusion", f"""WITH {SQL_BM25},
s AS (SELECT query_id, 'document' AS kind, 0.9 AS confidence, least(1.0, max(score) / 50) AS relevance, 0.6 AS weight FROM hits GROUP BY query_id
  UNION ALL SELECT query_id, 'domain', 0.8, 0.1 * len(list_filter({sql_list(L.PROSE_KEYWORDS)}, lambda k: contains(question, k))), 0.3 FROM q
  UNION ALL SELECT query_id, 'common', 0.7, CASE WHEN length(question) > 200 THEN 0.5 ELSE 0.2 END, 0.1 FROM q)
SELECT query_id, count(*) AS sources, round(sum(confidence::DOUBLE * relevance * weight::DOUBLE) / sum(weight::DOUBLE), 6) AS confidence FROM s WHERE relevance > 0 GROUP BY query_id""")
def knowledge_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence times relevance of document, domain and common knowledge, weighted."""
    asked = questions(spark, sf_dir)

    def source(rows: DataFrame, kind: str, sure: float, relevance: Column, weight: float) -> DataFrame:
        return rows.select("query_id", F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"), relevance.cast("double").alias("relevance"), F.lit(weight).alias("weight"))

    best = bm25_hits(spark, sf_dir).groupBy("query_id").agg(F.max("score").alias("best"))
    domain = 0.1 * F.size(F.filter(F.array(*[F.lit(k) for k in L.PROSE_KEYWORDS]), lambda k: F.contains("question", k)))
    rows = source(best, "document", 0.9, F.least(F.lit(1.0), F.col("best") / 50), 0.6).unionByName(source(asked, "domain", 0.8, domain, 0.3)).unionByName(source(asked, "common", 0.7, F.when(F.length("question") > 200, 0.5).otherwise(0.2), 0.1))
    part = F.col("confidence") * F.col("relevance") * F.col("weight")
    return rows.filter("relevance > 0").groupBy("query_id").agg(F.count("*").alias("sources"), F.round(F.sum(part) / F.sum("weight"), 6).alias("confidence"))


_NO_HIT, _FOUND, _LEAD = "Nothing was found.", 5, "From the documents:\n\n"
_FROM_HITS = f"""{ORACLE_SQL['hierarchical_retrieve'].removeprefix('WITH ').rsplit('SELECT * FROM r WHERE rank <= 10', 1)[0].rstrip()},
taken AS (SELECT r.query_id, r.rank, d.text FROM r JOIN d USING (chunk_id) WHERE r.rank <= 10),
replies AS (SELECT query_id, '{_LEAD.replace(chr(10) * 2, "' || chr(10) || chr(10) || '")}' || substring(string_agg(substring(text, 1, 800), chr(10) || chr(10) ORDER BY rank) FILTER (rank <= {_FOUND}), 1, 500) || '...' AS answer, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_sources FROM taken GROUP BY query_id),
answers AS (SELECT query_id AS answer_id, question, answer, context FROM replies JOIN q USING (query_id))"""


@query("traditional_answer", f"""WITH {swap(_VALID, _ANSWERS, _FROM_HITS)}
SELECT q.query_id, CASE WHEN answer IS NULL THEN 'no_hits' ELSE 'answered' END AS status, coalesce(n_sources, 0) AS n_sources, md5(coalesce(answer, '{_NO_HIT}')) AS answer_hash, coalesce(confidence, 0.0)::DOUBLE AS confidence, coalesce(off_topic OR confidence < 0.2, false) AS hallucination
FROM q LEFT JOIN replies USING (query_id) LEFT JOIN v ON v.answer_id = q.query_id""")
def traditional_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traditional chain: hierarchical hits, an answer from their beginnings, its validation against the whole texts; a fixed reply where nothing is found."""
    asked = questions(spark, sf_dir)
    hits = QUERIES["hierarchical_retrieve"](spark, sf_dir).select("query_id", "chunk_id", F.col("rank").alias("place"))
    sources = materialise(hits.join(corpus(spark, sf_dir).select("chunk_id", "text"), "chunk_id").select(F.col("query_id").alias("group"), "place", "text"))
    said = answer.from_sources(asked, sources, _LEAD, _FOUND)
    checked = grounding.validate(said.withColumn("group", F.col("query_id")).withColumnRenamed("query_id", "answer_id"), sources, **_RULES, fuzzy=False).withColumnRenamed("answer_id", "query_id")
    return answer.with_fallback(asked, said, checked, _NO_HIT).select("query_id", "status", "n_sources", F.md5("answer").alias("answer_hash"), "confidence", "hallucination")
