"""The registered queries of the numbered operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, chat, embeddings, filter_audit, hmm, jaccard, packing, quality, sharding, spelling, token_counts, toxicity, warc
from marlstone.llm.common import bounded, table


def _file(name: str) -> str:
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _file("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def packed_documents(docs: DataFrame) -> DataFrame:
    cut = packing.pieces(docs, _file("byte_bpe_50k.json"))
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    # One fixed conversation whose texts hold the template's own marks.
    fixed = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(rows.unionByName(fixed)).withColumn("turns", chat.read_back(F.col("formatted"), F.col("spans")))
    loss = F.array_join(F.filter("turns", lambda t: t["loss"])["under"], "")
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bpe.rank_file_model(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of the pages with damage that follows from the ids: changed, lost and added records."""
    page = F.col("page_id")
    html = F.when(F.pmod(page, F.lit(97)) == 5, F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html"))
    kept = pages.filter(F.coalesce(F.pmod(page, F.lit(89)) != 7, F.lit(True))).select("page_id", "url", html.alias("html"))
    added = pages.filter(F.pmod(page, F.lit(101)) == 11).select((-1 - page).alias("page_id"), "url", "html")
    return kept.unionByName(added)


def op9_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.audit(pages, damaged(pages))


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


#: Shards of equal weight.
SHARDS = 24


def op11_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: bounded(f)
    for f in (
        op1_quality_rules, op2_jaccard_join, op3_embedding_dedup, op4_token_counts, op5_toxicity, op6_packing, op7_chat_format, op8_byte_bpe, op9_merkle_audit, op10_hidden_markov,
        op11_rendezvous, op12_filter_audit, op13_spelling_variants,
    )
}

_LINKS_TO_COMPONENTS = """
reach AS (
  SELECT a AS node, b AS other FROM both_ways
  UNION
  SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a
),
least AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node)"""

#: The table of the byte-wise crc32, and the crc32 of a string by it.
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def _crc32(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _failing(letter: str) -> str:
    return f"(mask >> {'ABCDE'.index(letter)}) & 1 = 1"


ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 75 * (na + nb - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
{_LINKS_TO_COMPONENTS}
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.component, s.doc_id) AS component_id FROM sets s LEFT JOIN least l ON l.node = s.doc_id""",
    "op3_embedding_dedup": f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0
),
both_ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
degrees AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a),
{_LINKS_TO_COMPONENTS}
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, coalesce(l.component, v.vec_id) AS component_id, v.vec_id = coalesce(l.component, v.vec_id) AS kept
FROM embeddings v LEFT JOIN degrees d ON d.a = v.vec_id LEFT JOIN least l ON l.node = v.vec_id""",
    "op7_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
sized AS (
  SELECT *, length('### ') + length(role) + length(': ') + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>')) + length('</turn>') + 2 AS chars FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op9_merkle_audit": r"""
WITH stored AS (
  SELECT 'a' AS side, page_id, url, coalesce(html, '') AS html FROM pages
  UNION ALL SELECT 'b', page_id, url, CASE WHEN page_id % 97 = 5 THEN coalesce(html, '') || '!' ELSE coalesce(html, '') END FROM pages WHERE page_id % 89 <> 7
  UNION ALL SELECT 'b', -1 - page_id, url, coalesce(html, '') FROM pages WHERE page_id % 101 = 11
),
sized AS (
  SELECT side, page_id, html, floor(page_id / 1000)::BIGINT AS file, strlen('WARC/1.0  WARC-Type: response  WARC-Record-ID: <urn:page:' || page_id || '>  WARC-Target-URI: ' || coalesce(url, '') || '  Content-Length: ' || strlen(html) || '        ')
    + strlen(html) AS length FROM stored
),
placed AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY side, file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM sized),
a AS (SELECT * FROM placed WHERE side = 'a'),
b AS (SELECT * FROM placed WHERE side = 'b')
SELECT coalesce(a.page_id, b.page_id) AS page_id,
  CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra' WHEN a.html = b.html THEN 'moved' ELSE 'corrupt' END AS status,
  a.file, a."offset", a.length, b."offset" AS found_offset
FROM a FULL JOIN b ON a.page_id = b.page_id
WHERE a.page_id IS NULL OR b.page_id IS NULL OR a.html <> b.html OR a."offset" <> b."offset" """,
    "op11_rendezvous": rf"""
WITH {_CRC_TABLE},
rows AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS key, coalesce(strlen(text), 0) + 8 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
scored AS (SELECT doc_id, size, text_crc32, list_transform(range({SHARDS + 1}), lambda i: {{'score': 1.0::DOUBLE / -ln((('0x' || md5(i || ':' || key)[1:13])::BIGINT + 0.5) / 4503599627370496.0), 'shard': i}}) AS s FROM rows),
won AS (SELECT doc_id, size, text_crc32, list_max(s[1:{SHARDS}]).shard::INT AS shard, list_max(s).shard::INT AS grown_shard FROM scored)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM won""",
    "op12_filter_audit": rf"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
flags AS (
  SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * list_unique(w) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask FROM words
),
known AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM flags LEFT JOIN known USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) r(step)),
audit AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM audit""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
hashed AS (SELECT run, k, {_crc32("doc_id || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL), crc),
turned AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM turned WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
holes AS MATERIALIZED (SELECT word, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)),
pairs AS (
  SELECT x.word, y.word AS other FROM holes x JOIN holes y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT h.word, w.word FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word FROM holes h JOIN words w ON w.word = h.rest
),
near AS (SELECT pairs.word, count(*) AS n_near, list({{'n': -w.n, 'word': other}} ORDER BY w.n DESC, other)[1] AS best FROM pairs JOIN words w ON w.word = pairs.other GROUP BY pairs.word),
judged AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * w.n THEN best.word END AS form, CASE WHEN -best.n >= 2 * w.n THEN -best.n END AS form_n FROM words w LEFT JOIN near USING (word)
),
paths AS (SELECT word, form AS root FROM judged WHERE form IS NOT NULL UNION ALL SELECT p.word, j.form FROM paths p JOIN judged j ON j.word = p.root WHERE j.form IS NOT NULL),
ends AS (SELECT p.word, p.root FROM paths p JOIN judged j ON j.word = p.root WHERE j.form IS NULL)
SELECT j.word, form, coalesce(root, j.word) AS root, n, n_near, form_n FROM judged j LEFT JOIN ends e ON e.word = j.word""",
}
