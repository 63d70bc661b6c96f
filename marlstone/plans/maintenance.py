"""Named queries: snapshots, versions, incremental updates and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import chunking, incremental, lexical, pruned, store, vector
from marlstone.plans.registry import ORACLE_SQL, query
from marlstone.plans.retrieval import K, d_tokens, q_tokens, sql_tokens
from marlstone.plans.textual import sql_strip
from marlstone.sources import tables
from marlstone.sources.tables import corpus, questions, table

# Two snapshots that follow from all documents: the new one lacks the files of src1 in
# Spanish, has changed texts in German, and holds French files that the old one had not.
_OLD = "SELECT doc_id::VARCHAR AS path, text FROM documents WHERE lang <> 'fr'"
_NEW = "SELECT doc_id::VARCHAR AS path, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS text FROM documents WHERE NOT (lang = 'es' AND source = 'src1')"
_PRINTS = "old AS (SELECT path, md5(text) AS hash, strlen(text) AS size FROM ({old})), new AS (SELECT path, md5(text) AS hash, strlen(text) AS size FROM ({new}))".format(old=_OLD, new=_NEW)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = corpus(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    old = docs.filter("lang <> 'fr'").select("path", "text")
    new = docs.filter("not (lang = 'es' and source = 'src1')").select("path", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return old, new


@query("snapshot_diff", f"WITH {_PRINTS} SELECT path, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash = n.hash AND o.size = n.size THEN 'unchanged' ELSE 'modified' END AS status FROM old o FULL JOIN new n USING (path)")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return incremental.snapshot_diff(incremental.fingerprints(old), incremental.fingerprints(new))


@query("change_summary", f"WITH {_PRINTS} SELECT CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash = n.hash AND o.size = n.size THEN 'unchanged' ELSE 'modified' END AS status, count(*) AS files FROM old o FULL JOIN new n USING (path) GROUP BY 1")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff(spark, sf_dir).groupBy("status").agg(F.count("*").alias("files"))


def _chunks_sql(rows: str) -> str:
    return f"(SELECT path, start, md5(chunk) AS chunk_hash FROM (SELECT path, start, {sql_strip('substring(text, start + 1, 500)')} AS chunk FROM (SELECT path, text, unnest(range(0, length(text), 450)) AS start FROM ({rows}))) WHERE chunk <> '')"


def _chunks(files: DataFrame) -> DataFrame:
    cut = chunking.fixed_chunks(files.withColumnRenamed("path", "doc_id"))
    return cut.select(F.col("doc_id").alias("path"), "chunk_idx", F.md5("chunk").alias("chunk_hash"))


@query("chunk_hash", f"SELECT path, count(*) AS chunk_count, md5(string_agg(chunk_hash, '' ORDER BY start)) AS content_hash FROM {_chunks_sql(_OLD)} GROUP BY path")
def chunk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.content_hash(_chunks(snapshots(spark, sf_dir)[0]))


@query("new_chunks", f"SELECT n.path, count(*) AS chunks FROM {_chunks_sql(_NEW)} n LEFT JOIN (SELECT DISTINCT path, chunk_hash FROM {_chunks_sql(_OLD)}) o USING (path, chunk_hash) WHERE o.path IS NULL GROUP BY n.path")
def new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return incremental.new_chunks(_chunks(old), _chunks(new)).groupBy("path").agg(F.count("*").alias("chunks"))


_VERSIONS = f"""{_PRINTS}, v AS (SELECT path, coalesce(n.hash, o.hash) AS hash, CASE WHEN o.hash IS NULL THEN 1 WHEN n.hash IS NOT NULL AND n.hash <> o.hash THEN 2 ELSE 1 END AS version,
  CASE WHEN o.hash IS NULL THEN 'second' ELSE 'first' END AS created_at, CASE WHEN o.hash IS NULL OR (n.hash IS NOT NULL AND n.hash <> o.hash) THEN 'second' ELSE 'first' END AS updated_at FROM old o FULL JOIN new n USING (path))"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (incremental.fingerprints(x) for x in snapshots(spark, sf_dir))
    stored = old.select("path", "hash", F.lit(1).alias("version"), F.lit("first").alias("created_at"), F.lit("first").alias("updated_at"))
    return incremental.version_upsert(stored, new.select("path", "hash", F.lit("second").alias("seen_at")))


@query("version_upsert", f"WITH {_VERSIONS} SELECT * FROM v")
def version_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir)


@query("version_stats", f"WITH {_VERSIONS} SELECT version, count(*) AS files, count(*) FILTER (updated_at = 'second') AS updated FROM v GROUP BY version")
def version_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).groupBy("version").agg(F.count("*").alias("files"), F.count_if(F.col("updated_at") == "second").alias("updated"))


@query("orphan_cleanup", f"WITH {_PRINTS} SELECT path, hash FROM old WHERE path IN (SELECT path FROM new)")
def orphan_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return incremental.without_missing(incremental.fingerprints(old), new).select("path", "hash")


@query("debounced_updates", """WITH g AS (SELECT user_id, event_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, burst::BIGINT AS burst, epoch_us(max(ts)) AS updated_us, count(*) AS changes FROM b GROUP BY user_id, burst""")
def debounced_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return incremental.debounced(changes).select(F.col("key").alias("user_id"), F.col("burst").cast("long").alias("burst"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"), "changes")


@query("changed_files", f"WITH {_PRINTS}, f AS ({_NEW}) SELECT path, length(f.text) AS chars FROM f JOIN new n USING (path) LEFT JOIN old o USING (path) WHERE o.hash IS NULL OR o.hash <> n.hash OR o.size <> n.size")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that an incremental load reads."""
    old, new = snapshots(spark, sf_dir)
    return incremental.changed_files(incremental.fingerprints(old), new).select("path", F.length("text").alias("chars"))


@query("index_upsert", f"SELECT path, count(*) AS terms, sum(tf)::BIGINT AS tokens FROM (SELECT path, term, count(*) AS tf FROM (SELECT path, unnest({sql_tokens('text')}) AS term FROM ({_NEW})) GROUP BY ALL) GROUP BY path")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical index of the old files, saved and brought up to the new ones, equals that of the new files."""
    old, new = snapshots(spark, sf_dir)
    build = lambda files: lexical.term_counts(files, d_tokens(), "path")
    saved = tables.materialise(build(old))
    updated = incremental.upsert_index(saved, incremental.fingerprints(old), new, build)
    return updated.groupBy("path").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))


@query("saved_index_topk", ORACLE_SQL["bm25_topk"])
def saved_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bm25_topk`` from an index in blocks on disk."""
    docs, path = corpus(spark, sf_dir), tables.shared_path(spark)
    pruned.save(docs, d_tokens(), path)
    return pruned.top_k(pruned.load(spark, path), questions(spark, sf_dir), q_tokens(), K)


@query("saved_vectors_topk", ORACLE_SQL["vector_topk"])
def saved_vectors_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vector_topk`` from inverted lists on disk."""
    path = tables.shared_path(spark)
    vector.save(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id"), path)
    saved = vector.load(spark, path)
    return vector.search(saved, saved.lists.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), K)


@query("store_upsert", f"""WITH {_PRINTS}, cut AS (SELECT path, chunk_hash FROM {_chunks_sql(_NEW)}), had AS (SELECT DISTINCT path, chunk_hash FROM {_chunks_sql(_OLD)}),
laid AS (SELECT path, count(*) AS chunks, count(DISTINCT chunk_hash) FILTER (h.path IS NULL) AS written FROM cut LEFT JOIN had h USING (path, chunk_hash) GROUP BY path)
SELECT path, CASE WHEN o.hash IS NOT NULL AND (o.hash <> n.hash OR o.size <> n.size) THEN 2 ELSE 1 END AS version, coalesce(chunks, 0) AS chunks, coalesce(written, 0) AS written FROM new n LEFT JOIN old o USING (path) LEFT JOIN laid USING (path)""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old files stored, then the new ones: each file's version, its chunks, and those that the second version had to write."""
    old, new = snapshots(spark, sf_dir)
    kept = store.Store(spark, tables.shared_path(spark))
    kept.upsert(old)
    kept.upsert(new)
    files, before, after = kept.files(), kept.manifest(1), kept.manifest(2)
    chunks = kept.read().groupBy("path").agg(F.count("*").alias("chunks"))
    added = kept._read("chunks", {"chunks": [n for n in after["chunks"] if n not in before["chunks"]]})
    written = added.groupBy("path").agg(F.count("*").alias("written"))
    return files.select("path", "version").join(chunks, "path", "left").join(written, "path", "left").na.fill(0, ["chunks", "written"])
