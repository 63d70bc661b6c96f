"""Named queries that compose the operators end to end: multi-stage retrieval, strategies, reranking in stages, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import lexicons as L
from marlstone.functions import models
from marlstone.functions import text as X
from marlstone.operators import classify, context, fusion, lexical, rerank, staged
from marlstone.plans.details import _TEMPLATES
from marlstone.plans.registry import query
from marlstone.plans.retrieval import (
    _CHANNELS, _BONUS, _ENHANCED, _FORCED, _PAIR, _TASK, K, SQL_BM25, _relevance_sql, _rrf, swap,
    bm25_hits, channels_of, d_tokens, main_word_questions, q_tokens, sql_list, sql_tokens, vector_channel,
)
from marlstone.plans.textual import _FILLERS, _TYPES, _type_sql, target_files
from marlstone.sources.tables import corpus, materialise, questions

WIDE, CANDIDATES, FINAL = 40, 60, 15

_SPLIT = "list_distinct(list_filter(regexp_split_to_array({}, '[\\t\\n\\f\\r ]+'), lambda w: w <> ''))"
_MODEL = f"round(len(list_intersect({_SPLIT.format('question')}, {_SPLIT.format('text')})) / greatest(len({_SPLIT.format('question')}), 1), 6)"


def _merged(source: str, alpha: str, k: int, key: str = "source, substring(text, 1, 100)") -> str:
    """merged: the k best keys of the rows ``source`` (query_id, channel, chunk_id, rank, score, source, text, alpha)."""
    return f"""keyed AS (SELECT *, hash({key}) AS h FROM {source}),
both_sides AS (SELECT query_id, max_by(chunk_id, rank) FILTER (channel = 'vector') AS vc, max_by(score, rank) FILTER (channel = 'vector') AS vs, min_by(chunk_id, rank) FILTER (channel = 'bm25') AS bc, sum(score) FILTER (channel = 'bm25') AS bs, any_value({alpha})::DOUBLE AS alpha
  FROM keyed GROUP BY query_id, h),
scored AS (SELECT query_id, coalesce(vc, bc) AS chunk_id, CASE WHEN bc IS NULL THEN 'vector' WHEN vc IS NULL THEN 'bm25' ELSE 'hybrid' END AS source_type, round(alpha * coalesce(vs, 0) + (1 - alpha) * coalesce(bs, 0), 6) AS hybrid_score FROM both_sides),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, chunk_id) AS place FROM scored QUALIFY place <= {k})"""


_REFINED = f"""judged AS (SELECT m.*, {_MODEL} AS model_score, text, q.question FROM merged m JOIN d USING (chunk_id) JOIN q ON q.query_id = m.query_id),
final AS (SELECT *, round(0.6 * model_score + 0.4 * hybrid_score, 6) AS final_score FROM judged),
refined AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS rank FROM final QUALIFY rank <= {FINAL})"""
_WIDE = swap(_CHANNELS, f"rank <= {2 * K}", f"rank <= {WIDE}")
_TEXTED = "texted AS (SELECT own.query_id, own.channel, own.key AS chunk_id, own.rank, own.score, d.source, d.text FROM own JOIN d ON d.chunk_id = own.key)"


def _with_texts(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """Hits whose key is a document, with its source and text."""
    return hits.withColumnRenamed("key", "chunk_id").join(corpus(spark, sf_dir).select("chunk_id", "source", "text"), "chunk_id")


def _refine(spark: SparkSession, sf_dir: str, merged: DataFrame, asked: DataFrame) -> DataFrame:
    candidates = merged.drop("rank").join(corpus(spark, sf_dir).select("chunk_id", "text"), "chunk_id").join(asked, "query_id")
    return staged.model_rerank(candidates, FINAL, score="hybrid_score")


@query("multi_stage_retrieve", f"""WITH {_WIDE}, {_TEXTED}, {_merged('texted', '0.5', CANDIDATES)}, {_REFINED}
SELECT query_id, chunk_id, source_type, hybrid_score, model_score, final_score, rank FROM refined""")
def multi_stage_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 hits of either channel, the 60 best after the merge, the 15 best after the model."""
    asked = main_word_questions(spark, sf_dir)
    merged = staged.merge_candidates(_with_texts(spark, sf_dir, channels_of(spark, sf_dir, asked, WIDE)), CANDIDATES)
    return _refine(spark, sf_dir, merged, asked).select("query_id", "chunk_id", "source_type", "hybrid_score", "model_score", "final_score", "rank")


def _cleaned_sql() -> str:
    """c5: the questions of q0 without fillers."""
    steps = "".join(f", c{i + 1} AS (SELECT query_id, CASE WHEN contains(t, '{w}') AND length(t) > {len(w) + 5} THEN trim(replace(t, '{w}', '')) ELSE t END AS t FROM c{i})" for i, w in enumerate(_FILLERS))
    return f"c0 AS (SELECT query_id, question AS t FROM q0){steps}"


_STRATEGY_SQL = swap(_type_sql(), "(SELECT item_id, text AS t FROM benchmark)", "(SELECT query_id AS item_id, question AS t FROM q0)")
_OPTIMISED = (
    swap(_WIDE, "q AS (SELECT chunk_id AS query_id,", "q0 AS (SELECT chunk_id AS query_id,")
    .replace(",\nstats AS", f""",
{_cleaned_sql()},
plan AS (SELECT query_id, kind, CASE WHEN confidence > 0.3 AND kind <> 'factual' THEN 0.3 ELSE 0.5 END AS alpha, CASE WHEN confidence > 0.3 AND kind <> 'factual' THEN 15 ELSE {WIDE} END AS vector_k, CASE WHEN confidence > 0.3 AND kind <> 'factual' THEN 35 ELSE {WIDE} END AS bm25_k FROM (WITH {_STRATEGY_SQL})),
q AS (SELECT query_id, regexp_replace(t, '\\s+', ' ', 'g') AS question, {sql_tokens("regexp_replace(t, '\\s+', ' ', 'g')")} AS toks FROM c{len(_FILLERS)}),
stats AS""", 1)
)
_KIND_WORDS = "CASE kind " + " ".join(f"WHEN '{n}' THEN {sql_list(words)}" for n, (words, _) in _TYPES.items()) + " ELSE []::VARCHAR[] END"


@query("strategy_retrieve", f"""WITH {_OPTIMISED}, {_TEXTED},
cut AS (SELECT t.*, alpha FROM texted t JOIN plan USING (query_id) WHERE rank <= CASE channel WHEN 'vector' THEN vector_k ELSE bm25_k END), {_merged('cut', 'alpha', CANDIDATES)}, {_REFINED},
marked AS (SELECT r.query_id, chunk_id, kind, alpha, hybrid_score, final_score, r.rank AS before, len(list_filter({_KIND_WORDS}, lambda w: contains(text, w))) > 0 AS matches FROM refined r JOIN plan USING (query_id))
SELECT query_id, chunk_id, kind, alpha::DOUBLE AS alpha, hybrid_score, final_score, matches, CASE WHEN matches THEN 2.0 ELSE 1.0 END::DOUBLE AS match_score, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, before) AS rank FROM marked QUALIFY rank <= {K}""")
def strategy_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fillers go, the question's type sets weights and sizes, and texts with the type's words come first."""
    asked = main_word_questions(spark, sf_dir)
    kind, sure = classify.weighted_type(F.col("question"), _TYPES, "factual")
    # The default type has the confidence 0.5 but no strategy of its own.
    chosen = classify.retrieval_strategy(F.when(kind != "factual", sure).otherwise(0.0))
    known = F.col("s.alpha") < 0.5
    plan = asked.select("query_id", kind.alias("kind"), chosen.alias("s")).select("query_id", "kind", "s.alpha", F.when(known, F.col("s.vector_k")).otherwise(WIDE).alias("vector_k"), F.when(known, F.col("s.bm25_k")).otherwise(WIDE).alias("bm25_k"))
    cleaned = asked.select("query_id", classify.drop_fillers(F.col("question"), _FILLERS).alias("question"))
    hits = channels_of(spark, sf_dir, cleaned, WIDE).join(plan, "query_id").filter(F.col("rank") <= F.when(F.col("channel") == "vector", F.col("vector_k")).otherwise(F.col("bm25_k")))
    merged = staged.merge_candidates(_with_texts(spark, sf_dir, hits), CANDIDATES, F.col("alpha"))
    refined = _refine(spark, sf_dir, merged, cleaned).join(plan.select("query_id", "kind", "alpha"), "query_id")
    words = F.create_map(*[x for n, (w, _) in _TYPES.items() for x in (F.lit(n), F.array(*[F.lit(t) for t in w]))])
    boosted = staged.boosted_first(refined, F.exists(words[F.col("kind")], lambda w: F.contains("text", w)), K)
    return boosted.select("query_id", "chunk_id", "kind", "alpha", "hybrid_score", "final_score", "matches", "match_score", "rank")


_FEW = f"count(*) OVER (PARTITION BY query_id) <= {K}"


@query("two_stage_rerank", f"""WITH {swap(SQL_BM25, 'WHERE rank <= 20', f'WHERE rank <= {CANDIDATES}')},
ruled AS (SELECT query_id, chunk_id, question, text, CASE WHEN {_FEW} THEN score ELSE {_relevance_sql('lower(question)', 'lower(text)', 100, 1000, 0.5, 0.3, 2000, 0.3)} END AS stage_score FROM hits),
first_stage AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage_score DESC, chunk_id) AS place FROM ruled QUALIFY place <= 50),
judged AS (SELECT *, {_MODEL} AS model_score FROM first_stage), final AS (SELECT *, round(0.6 * model_score + 0.4 * stage_score, 6) AS final_score FROM judged)
SELECT query_id, chunk_id, stage_score, model_score, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS rank FROM final QUALIFY rank <= {K}""")
def two_stage_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 lexical hits, the 50 best by the rule, the 10 best by the model."""
    relevance = F.round(rerank.simple_relevance(F.lower("question"), F.lower("text")), 6)
    ranked = staged.two_stage_rerank(bm25_hits(spark, sf_dir, CANDIDATES).drop("rank"), relevance, 50, K)
    return ranked.select("query_id", "chunk_id", "stage_score", "model_score", "final_score", "rank")


@query("model_rerank", f"""WITH {SQL_BM25}, judged AS (SELECT *, {_MODEL} AS model_score FROM hits), final AS (SELECT *, round(0.6 * model_score + 0.4 * score, 6) AS final_score FROM judged)
SELECT query_id, chunk_id, model_score, final_score, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS place FROM final) WHERE place <= {K}""")
def model_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged.model_rerank(bm25_hits(spark, sf_dir).drop("rank"), K).select("query_id", "chunk_id", "model_score", "final_score", "rank")


_BY_CONTENT = "ranked_parts AS (SELECT query_id, channel, chunk_id, rank, CASE channel WHEN 'vector' THEN score ELSE 1 / (1 + (rank - 1)) END AS score, source, text FROM texted)"


@query("content_merge", f"WITH {_CHANNELS}, {_TEXTED}, {_BY_CONTENT}, {_merged('ranked_parts', '0.4', K, 'text')} SELECT query_id, chunk_id, source_type, hybrid_score, place AS rank FROM merged")
def content_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge keyed by the whole text, a lexical hit scored by its rank alone."""
    asked = main_word_questions(spark, sf_dir)
    hits = _with_texts(spark, sf_dir, channels_of(spark, sf_dir, asked, 2 * K))
    by_rank = hits.withColumn("score", F.when(F.col("channel") == "vector", F.col("score")).otherwise(1 / F.col("rank")))
    return staged.merge_candidates(by_rank, K, 0.4, key=[F.col("text")])


_LEGACY = _relevance_sql("question", "text", 100, 1000, 0.5, 0.3, 2000, 0.3)


@query("legacy_retrieve", f"""WITH {_CHANNELS}, {_TEXTED}, r AS (SELECT t.query_id, chunk_id, channel, round(0.7 * {_LEGACY} + 0.3 * score, 6) AS final_score FROM texted t JOIN q ON q.query_id = t.query_id)
SELECT query_id, chunk_id, channel, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id, channel) AS rank FROM r QUALIFY rank <= {K}""")
def legacy_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels' hits one after the other, none merged, ranked by the rule."""
    asked = main_word_questions(spark, sf_dir)
    hits = _with_texts(spark, sf_dir, channels_of(spark, sf_dir, asked, 2 * K)).join(asked, "query_id")
    relevance = F.round(rerank.simple_relevance(F.col("question"), F.col("text")), 6)
    scored = hits.select("query_id", "chunk_id", "channel", rerank.fallback_score(relevance, F.col("score")).alias("final_score"))
    return lexical.top_k(scored, K, (F.desc("final_score"), F.asc("chunk_id"), F.asc("channel")))


@query("channel_report", f"WITH {_CHANNELS}, {_TEXTED} SELECT query_id, channel, rank, chunk_id, source, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview FROM texted WHERE rank <= 5")
def channel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each channel with previews of 200 characters."""
    asked = main_word_questions(spark, sf_dir)
    preview = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return _with_texts(spark, sf_dir, channels_of(spark, sf_dir, asked, 5)).select("query_id", "channel", "rank", "chunk_id", "source", preview.alias("preview"))


_BLANKS = swap(SQL_BM25, sql_tokens("text"), r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')")


@query("bm25_whitespace", f"WITH {_BLANKS} SELECT query_id, chunk_id, rank FROM ranked WHERE rank <= {K}")
def bm25_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stock lexical retriever: words between blanks, ranks only."""
    return lexical.bm25_top_k(corpus(spark, sf_dir), questions(spark, sf_dir), X.whitespace_words(F.col("text")), X.whitespace_words(F.col("question")), K).drop("score")


_PATTERN = "*e*"


@query("boost_filter", f"""WITH {SQL_BM25}, m AS (SELECT query_id, chunk_id, source, score, rank AS before, regexp_full_match(source, '.*e.*') OR contains(text, 'thtion') OR contains(text, 'erble') AS matches FROM hits)
SELECT query_id, chunk_id, score, matches, CASE WHEN matches THEN 2.0 ELSE 1.0 END::DOUBLE AS match_score, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, before) AS rank FROM m QUALIFY rank <= {K}""")
def boost_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits from matching files, or with a keyword, first."""
    match = staged.file_matches(F.col("source"), _PATTERN) | F.contains("text", F.lit("thtion")) | F.contains("text", F.lit("erble"))
    return staged.boosted_first(bm25_hits(spark, sf_dir), match, K).select("query_id", "chunk_id", "score", "matches", "match_score", "rank")


_TARGETS = """kw AS (SELECT source, list(term) AS keywords FROM (
  SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, term) AS r FROM (SELECT source, unnest(toks) AS term FROM d) GROUP BY source, term QUALIFY r <= 10) GROUP BY source),
targets AS (SELECT query_id, source FROM (SELECT query_id, source, round(list_sum(list_transform(keywords, lambda k: CASE WHEN contains(question, k) THEN 2.0 * length(k) WHEN list_contains(toks, k) THEN 1.0 * length(k)
  WHEN len(list_filter(toks, lambda w: contains(w, k) OR contains(k, w))) > 0 THEN 0.5 * length(k) ELSE 0.0 END)) / list_sum(list_transform(keywords, lambda k: 2.0 * length(k))), 6)::DOUBLE AS score FROM q, kw) WHERE score >= 0.6)"""


@query("file_aware_retrieve", f"""WITH {SQL_BM25}, {_TARGETS},
wide AS (SELECT r.query_id, chunk_id, score, source FROM ranked r JOIN d USING (chunk_id) WHERE rank <= {3 * K}),
inside AS (SELECT query_id, chunk_id, 'targeted' AS mode, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM wide SEMI JOIN targets USING (query_id, source) QUALIFY rank <= {K}),
words AS (SELECT query_id, post.chunk_id, source, sum(tf * length(term)) AS score FROM qt JOIN post USING (term) JOIN d ON d.chunk_id = post.chunk_id GROUP BY ALL),
keyed AS (SELECT query_id, chunk_id, 'keyword' AS mode, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM words SEMI JOIN targets USING (query_id, source) WHERE query_id NOT IN (SELECT query_id FROM inside) QUALIFY rank <= {K}),
others AS (SELECT query_id, chunk_id, 'global' AS mode, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM wide WHERE query_id NOT IN (SELECT query_id FROM targets) QUALIFY rank <= {K})
SELECT * FROM inside UNION ALL SELECT * FROM keyed UNION ALL SELECT * FROM others""")
def file_aware_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval from the files that a question names; the base retriever is the lexical one."""
    docs, asked = corpus(spark, sf_dir), questions(spark, sf_dir)
    sources = docs.select("chunk_id", "source")
    targets = materialise(target_files(spark, sf_dir))
    ranked = bm25_hits(spark, sf_dir, 3 * K).select("query_id", "chunk_id", "score", "source")
    # Keyword hits are wanted only for questions with target files.
    named = asked.join(targets.select("query_id").distinct(), "query_id", "left_semi")
    words = lexical.shared_top_k(docs, named, d_tokens(), q_tokens(), "keyword", K, (F.col("source"), targets.select("query_id", F.col("source").alias("kind"))))
    words = words.drop("rank").join(sources, "chunk_id")
    return staged.within_files(ranked, words, targets, K)


_FIRST_STAGE = f"""{_CHANNELS}, {swap(_FORCED, f'r <= {2 * K}', f'r <= {4 * K}')},
exact_of AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, chunk_id) AS r FROM ph QUALIFY r <= {2 * K}),
everything AS (SELECT query_id, chunk_id, text, score, 'forced' AS channel FROM forced
  UNION ALL SELECT r.query_id, r.chunk_id, d.text, r.score, 'bm25' FROM ranked r JOIN d USING (chunk_id) WHERE r.rank <= {4 * K} AND NOT EXISTS (SELECT 1 FROM forced f WHERE f.query_id = r.query_id AND f.text = d.text)
  UNION ALL SELECT query_id, chunk_id, text, score + 500, 'phrase' FROM asked JOIN exact_of USING (phrase)),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, chunk_id, channel) AS u FROM everything QUALIFY u = 1),
lexical_top AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM one QUALIFY rank <= {2 * K}),
first_per AS (SELECT query_id, 'vector' AS channel, chunk_id AS key, rank FROM vector_top WHERE query_id IN (SELECT query_id FROM q) UNION ALL SELECT query_id, 'bm25', chunk_id, rank FROM lexical_top),
{_rrf(_PAIR, 'first_per')}"""


def first_stage(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """query_id, chunk_id, rrf_score, rank: vectors and the enhanced lexical search, 2 k of either, fused, k left."""
    lexical_side = lexical.enhanced_search(corpus(spark, sf_dir), asked, d_tokens(), q_tokens(), L.PROSE_PHRASES, L.PROSE_PHRASES, 2 * K)
    both = vector_channel(spark, sf_dir, asked, 2 * K).unionByName(lexical_side.select("query_id", F.lit("bm25").alias("channel"), F.col("chunk_id").alias("key"), "rank", "score"))
    return fusion.reciprocal_rank_fusion(both, _PAIR).filter(F.col("rank") <= K).withColumnRenamed("key", "chunk_id").drop("ranks")


@query("optimized_retrieve", f"WITH {_FIRST_STAGE} SELECT query_id, key AS chunk_id, rrf_score, rank FROM fused WHERE rank <= {K}")
def optimized_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_stage(spark, sf_dir, main_word_questions(spark, sf_dir))


_SHOWN = 5
_NOT_FOUND, _UNANSWERED = "cannot be found in the documents", "No document was found for this question."
_HEAD = {name: template.split("{context}")[0] for name, template in _TEMPLATES.items()}
_KIND_SQL = "CASE WHEN regexp_matches(question, 'of the') THEN 'of' WHEN regexp_matches(question, 'thing') THEN 'thing' ELSE 'general' END"
_TERMS = {"of": (("of", "tion"), 0.3), "thing": (("thing", "and"), 0.25), "general": (("the", "and"), 0.2)}
_FOUND = "CASE kind " + " ".join(f"WHEN '{n}' THEN {' + '.join(f'contains(context, {chr(39)}{t}{chr(39)})::INT' for t in terms)}" for n, (terms, _) in _TERMS.items()) + " END"
_WEIGHT = "CASE kind " + " ".join(f"WHEN '{n}' THEN {w}" for n, (_, w) in _TERMS.items()) + " END"
_QUALITY = "CASE kind " + " ".join(f"WHEN '{n}' THEN {' + '.join(f'contains(answer, {chr(39)}{t}{chr(39)})::INT' for t in terms)}" for n, (terms, _) in _TERMS.items()) + " END"


def _prompt_sql() -> str:
    quoted = lambda s: " || chr(10) || ".join(f"'{p}'" for p in s.split("\n"))
    return "CASE kind " + " ".join(f"WHEN '{n}' THEN {quoted(head)} || context || chr(10) || 'Question: ' || question" for n, head in _HEAD.items()) + " END"


@query("answer_driver", f"""WITH {_FIRST_STAGE},
cand AS (SELECT f.query_id, f.key AS chunk_id, f.rrf_score AS score, d.text, d.source, q.question FROM fused f JOIN d ON d.chunk_id = f.key JOIN q ON q.query_id = f.query_id WHERE f.rank <= {K}),
parts AS (SELECT *, round({_ENHANCED}, 6) AS relevance, round({_BONUS}, 6)::DOUBLE AS entity_bonus, round({_TASK}, 6)::DOUBLE AS task_relevance FROM cand),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * relevance + 0.2 * score + 0.3 * entity_bonus + 0.2 * task_relevance, 6) DESC, chunk_id) AS place FROM parts QUALIFY place <= {_SHOWN}),
packed AS (SELECT query_id, count(*) AS sources, string_agg('Document ' || place || ' (source: ' || source || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS context FROM ordered GROUP BY query_id),
typed AS (SELECT q.query_id, q.question, {_KIND_SQL} AS kind, coalesce(sources, 0) AS sources, context FROM q LEFT JOIN packed USING (query_id)),
prompted AS (SELECT *, CASE WHEN context IS NOT NULL THEN {_prompt_sql()} END AS prompt FROM typed),
answered AS (SELECT *, CASE WHEN prompt IS NULL THEN '{_UNANSWERED}' ELSE substring(prompt, 1, 300) END AS answer FROM prompted),
rated AS (SELECT *, round(coalesce({_FOUND} * {_WEIGHT}, 0), 6)::DOUBLE AS relevance, round(least(CASE WHEN length(answer) > 20 THEN 0.2 ELSE 0.0 END + 0.2 * ({_QUALITY}), 1.0), 6)::DOUBLE AS quality, contains(answer, '{_NOT_FOUND}') OR prompt IS NULL AS says_not_found FROM answered)
SELECT query_id, kind, sources, CASE WHEN prompt IS NULL THEN 'no hits' ELSE 'answered' END AS status, md5(coalesce(prompt, '')) AS prompt_hash, answer, relevance, quality, says_not_found, says_not_found = (relevance < 0.2) AS fitting, round((relevance + quality) / 2, 6) AS overall FROM rated""")
def answer_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question from retrieval to a rated answer; a question without hits, or a failed model, has a status of its own."""
    asked = main_word_questions(spark, sf_dir)
    docs = corpus(spark, sf_dir).select("chunk_id", "source", "text")
    found = first_stage(spark, sf_dir, asked).select("query_id", "chunk_id", F.col("rrf_score").alias("score")).join(docs, "chunk_id").join(asked, "query_id")
    ordered = rerank.enhanced_rerank(found, L.PROSE_ENTITIES, L.PROSE_INDICATORS, _SHOWN)
    packed = context.formatted_documents(ordered).select("query_id", F.col("formatted").alias("context"), F.col("texts").alias("sources"))
    kind = X.first_matching(F.col("question"), (("of", "of the"), ("thing", "thing")), "general")
    typed = asked.join(packed, "query_id", "left").withColumn("kind", kind).fillna(0, ["sources"])
    head = F.create_map(*[F.lit(x) for pair in _HEAD.items() for x in pair])[F.col("kind")]
    prompts = typed.withColumn("prompt", F.concat(head, "context", F.lit("\nQuestion: "), "question"))
    said = models.answers(prompts, models.excerpt_generator)
    status = F.when(F.col("prompt").isNull(), "no hits").when(F.col("error").isNotNull(), "failed").otherwise("answered")
    said = said.withColumn("status", status).withColumn("answer", F.when(F.col("status") == "answered", F.col("answer")).otherwise(_UNANSWERED))
    relevance, _ = rerank.context_relevance(F.col("kind"), F.coalesce("context", F.lit("")), _TERMS)
    says = F.contains("answer", F.lit(_NOT_FOUND)) | (F.col("status") != "answered")
    rated = said.withColumns({"relevance": relevance, "quality": rerank.answer_quality(F.col("kind"), F.col("answer"), {n: terms for n, (terms, _) in _TERMS.items()}), "says_not_found": says})
    fitting, overall = rerank.prompt_effectiveness(F.col("relevance"), F.col("quality"), F.col("says_not_found"))
    return rated.select("query_id", "kind", "sources", "status", F.md5(F.coalesce("prompt", F.lit(""))).alias("prompt_hash"), "answer", "relevance", "quality", "says_not_found", fitting.alias("fitting"), overall.alias("overall"))


_CATEGORY_RULES = {n: (terms, (rf"{terms[0]}[a-z]* [a-z]+", )) for n, terms in L.PROSE_CATEGORIES.items()}


@query("pattern_classify", "SELECT doc_id, CASE " + " ".join(f"WHEN s_{n} = top AND top > 0 THEN '{n}'" for n in _CATEGORY_RULES) + " ELSE 'other' END AS category, top AS score FROM (SELECT *, greatest(" + ", ".join(f"s_{n}" for n in _CATEGORY_RULES) + ") AS top FROM (SELECT doc_id, " + ", ".join("(" + " + ".join([f"contains(t, '{w}')::INT" for w in terms] + [f"2 * regexp_matches(t, '{p}')::INT" for p in patterns]) + f") AS s_{n}" for n, (terms, patterns) in _CATEGORY_RULES.items()) + " FROM (SELECT doc_id, lower(text) AS t FROM documents)))")
def pattern_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each keyword, two for each pattern; the first category on a tie, 'other' without points."""
    category, score = classify.points_category(F.lower("text"), _CATEGORY_RULES, "other")
    return corpus(spark, sf_dir).select("doc_id", category.alias("category"), score.alias("score"))


_NAMES = {"the thing": ("thing part", "thtion"), "of the": ("of tion", "erble")}


def _name_score(name: str, keywords: tuple[str, ...]) -> str:
    parts = [f"CASE WHEN contains(text, '{k}') THEN 2.0 WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{p}{chr(39)})' for p in k.split())} THEN 0.5 ELSE 0.0 END" for k in keywords]
    return " + ".join([*parts, f"CASE WHEN contains(text, '{name}') THEN 3.0 ELSE 0.0 END"])


@query("name_scores", f"""WITH s AS (SELECT item_id AS query_id, {', '.join(f'({_name_score(n, k)})::DOUBLE AS s{i}' for i, (n, k) in enumerate(_NAMES.items()))} FROM benchmark), t AS (SELECT *, greatest(s0, s1) AS top FROM s)
SELECT query_id, CASE WHEN top = 0 THEN NULL {' '.join(f"WHEN s{i} = top THEN '{n}'" for i, n in enumerate(_NAMES))} END AS name, round(least(top / 3, 1.0), 6)::DOUBLE AS confidence FROM t""")
def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best known name of a question: 2 for a keyword, 0.5 for a part of one, 3 for the name itself."""
    name, sure = classify.named_type(F.col("question"), _NAMES)
    return questions(spark, sf_dir).select("query_id", name.alias("name"), sure.alias("confidence"))


_CREATIVE = ("process", "advice")
_CREATIVE_WORDS = ("how", "should", "thtion")


@query("creative_mode", f"WITH k AS (WITH {_type_sql()}), w AS (SELECT item_id AS query_id, list_slice({sql_tokens('text')}, 1, 10) AS words FROM benchmark) SELECT query_id, kind, kind IN ('process', 'advice') OR len(list_intersect(words, {sql_list(_CREATIVE_WORDS)})) > 0 AS creative FROM k JOIN w USING (query_id)")
def creative_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, _ = classify.weighted_type(F.col("question"), _TYPES, "factual")
    creative = classify.asks_for_ideas(kind, F.slice(q_tokens(), 1, 10), _CREATIVE, _CREATIVE_WORDS)
    return questions(spark, sf_dir).select("query_id", kind.alias("kind"), creative.alias("creative"))


_GUIDES = {"question": ("Answer: ", "short, neutral"), "process": ("Give the steps: ", "ordered, practical"), "advice": ("Advise: ", "balanced, with reasons"), "factual": ("State the facts: ", "exact")}


@query("strategy_prompt", f"WITH k AS (WITH {_type_sql()}) SELECT query_id, kind, CASE kind {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {chr(39)}{g}{chr(39)}' for n, (_, g) in _GUIDES.items())} END AS guide, md5(CASE kind {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {chr(39)}{p}{chr(39)}' for n, (p, _) in _GUIDES.items())} END || text) AS prompt_hash FROM k JOIN benchmark ON item_id = query_id")
def strategy_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt and the guideline of the question's type."""
    kind, _ = classify.weighted_type(F.col("question"), _TYPES, "factual")
    guide = F.create_map(*[x for n, (p, g) in _GUIDES.items() for x in (F.lit(n), F.struct(F.lit(p).alias("prompt"), F.lit(g).alias("guide")))])
    typed = questions(spark, sf_dir).withColumn("kind", kind).withColumn("g", guide[F.col("kind")])
    return typed.select("query_id", "kind", "g.guide", F.md5(F.concat("g.prompt", "question")).alias("prompt_hash"))


_INDICATORS, _STRONG = ("thing", "tion"), ("erble",)
_BOOST = "CASE WHEN contains(lower(question), 'thing') OR contains(lower(question), 'tion') OR contains(lower(question), 'erble') THEN 1 + 0.2 * (contains(lower(text), 'thing')::INT + contains(lower(text), 'tion')::INT) + 0.5 * contains(lower(text), 'erble')::INT ELSE 1.0 END"


@query("merge_definition_boost", f"""WITH {_CHANNELS}, {_TEXTED},
keyed AS (SELECT t.*, md5(source || '_' || substring(text, 1, 100)) AS h, (CASE channel WHEN 'vector' THEN 0 ELSE 1 END, rank, chunk_id) AS met, ({_BOOST})::DOUBLE AS boost FROM texted t JOIN q ON q.query_id = t.query_id),
sums AS (SELECT query_id, h, arg_min(chunk_id, met) AS chunk_id, round(sum(score * CASE channel WHEN 'vector' THEN 0.4 ELSE 0.6 END::DOUBLE) * arg_min(boost, met), 6) AS boosted,
  CASE WHEN count(DISTINCT channel) = 2 THEN 'hybrid' ELSE min(channel) END AS source_type FROM keyed GROUP BY query_id, h)
SELECT query_id, chunk_id, source_type, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, chunk_id) AS rank FROM sums QUALIFY rank <= {2 * K}""")
def merge_definition_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels added up by source and beginning, raised for texts that define what the question asks for."""
    asked = main_word_questions(spark, sf_dir)
    hits = _with_texts(spark, sf_dir, channels_of(spark, sf_dir, asked, 2 * K)).join(asked, "query_id")
    return staged.merge_adding(hits, fusion.definition_boost(F.lower("question"), F.lower("text"), _INDICATORS, _STRONG), 2 * K)
