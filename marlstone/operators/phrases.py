"""Phrases from a positional index: where a text holds a string, blanks and parts of words included.

A text is its words between single blanks, so a phrase of m words occurs where a
word ends with its first, the next ones equal its inner ones, and the last
begins with its last (a phrase of one word: where a word holds it).  Words of the
vocabulary that fit a part are found through runs of a few letters, which
either side has, and are then compared; texts are not read again.  Postings hold
character offsets, so each fitting word tells where the phrase would begin,
and the parts meet on (phrase, text, beginning).

Defined results: null texts hold nothing; null and blank phrases, and phrases
with nothing but blanks, match nothing; phrases may repeat and give rows once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.substrings import first_gram, grams
from marlstone.sources.tables import materialise


#: Words that are placed in one array.
RUN = 128


class Index(NamedTuple):
    """postings: term, chunk_id, at; terms: term; texts: chunk_id, chars, digest."""

    postings: DataFrame
    terms: DataFrame
    texts: DataFrame


def save(corpus: DataFrame, path: str) -> Index:
    """Write the index of (chunk_id, text) below ``path``; postings are made and written beside the scan."""
    spark = corpus.sparkSession
    words = F.split("text", " ")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<term:string,at:int>>").alias("out"))
    # Words are placed by a running length, within runs of RUN words, as a long array is costly to extend; the runs by the lengths before them.
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / RUN).cast("int")), lambda i: F.slice("w", i * RUN + 1, F.lit(RUN)))
    placed = F.aggregate("block", begin, lambda s, w: F.struct((s["at"] + F.length(w) + 1).alias("at"), F.array_append(s["out"], F.struct(w.alias("term"), s["at"].alias("at"))).alias("out")))["out"]
    lengths = F.transform("blocks", lambda b: F.length(F.array_join(b, " ")) + 1)
    cut = corpus.filter("text IS NOT NULL").select("chunk_id", words.alias("w")).select("chunk_id", blocks.alias("blocks")).withColumn("sizes", lengths)
    cut = cut.select("chunk_id", "sizes", F.posexplode("blocks").alias("b", "block"))
    base = F.aggregate(F.slice("sizes", F.lit(1), F.col("b")), F.lit(0), lambda a, x: a + x)
    rows = cut.select("chunk_id", base.alias("base"), F.explode(placed).alias("p")).filter("p.term <> ''")
    rows.select("p.term", "chunk_id", (F.col("base") + F.col("p.at")).alias("at")).write.mode("error").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").select("term").distinct().write.mode("error").parquet(f"{path}/terms")
    corpus.filter("text IS NOT NULL").select("chunk_id", F.length("text").alias("chars"), F.md5("text").alias("digest")).write.mode("error").parquet(f"{path}/texts")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in Index._fields])


def parts_of(phrases: DataFrame) -> DataFrame:
    """phrase, parts, part, kind, rel: a row per part with letters; kind: whole, suffix, prefix or inside; rel: its place in the phrase."""
    split = phrases.select("phrase").filter("phrase IS NOT NULL AND trim(phrase) <> ''").distinct().withColumn("w", F.split("phrase", " "))
    rows = split.select("phrase", F.size("w").alias("m"), "w", F.posexplode("w").alias("i", "part")).filter("part <> ''")
    rel = F.length(F.array_join(F.slice("w", F.lit(1), F.col("i")), " ")) + F.when(F.col("i") > 0, 1).otherwise(0)
    kind = F.when(F.col("m") == 1, "inside").when(F.col("i") == 0, "suffix").when(F.col("i") == F.col("m") - 1, "prefix").otherwise("whole")
    return rows.select("phrase", "part", kind.alias("kind"), rel.alias("rel"), F.size(F.filter("w", lambda x: x != "")).alias("parts"))


def fitting_terms(index: Index, parts: DataFrame) -> DataFrame:
    """The rows of ``parts`` with each term of the vocabulary that fits."""
    whole = parts.filter("kind = 'whole'").join(index.terms, F.col("part") == F.col("term"))
    # a fitting term holds the first run of the part
    keyed = parts.filter("kind <> 'whole'").withColumn("gram", first_gram(F.col("part")))
    held = index.terms.select("term", F.explode(grams(F.col("term"))).alias("gram"))
    fits = F.when(F.col("kind") == "suffix", F.endswith("term", F.col("part"))).when(F.col("kind") == "prefix", F.startswith("term", F.col("part"))).otherwise(F.contains("term", F.col("part")))
    return whole.unionByName(held.join(keyed, "gram").filter(fits).drop("gram"))


def matches(index: Index, phrases: DataFrame) -> DataFrame:
    """phrase, chunk_id, matches, score = matches / (length + 1) * 1000, digest of every text that holds a phrase; occurrences do not overlap."""
    fitted = materialise(fitting_terms(index, parts_of(phrases)))
    met = index.postings.join(fitted, "term")
    size, part = F.length("phrase"), F.length("part")
    within = lambda t, p: F.filter(F.transform(F.sequence(F.lit(0), F.length(t) - F.length(p)), lambda i: F.when(F.substring(t, i + 1, F.length(p)) == p, i)), lambda i: i.isNotNull())
    inner = F.when(F.col("kind") == "inside", within(F.col("term"), F.col("part"))).when(F.col("kind") == "suffix", F.array(F.length("term") - part)).otherwise(F.array(F.lit(0)))
    begins = F.transform("inner", lambda i: F.col("at") + i - F.col("rel"))
    rows = met.withColumn("inner", inner).select("phrase", "chunk_id", "rel", "parts", begins.alias("begins"))
    # one row per phrase, text and part; then those beginnings that every part has
    by_part = rows.groupBy("phrase", "chunk_id", "parts", "rel").agg(F.flatten(F.collect_list("begins")).alias("begins"))
    common = by_part.groupBy("phrase", "chunk_id", "parts").agg(F.collect_list("begins").alias("all")).filter(F.size("all") == F.col("parts"))
    shared = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    found = common.select("phrase", "chunk_id", F.array_sort(F.array_distinct(shared)).alias("at")).join(index.texts, "chunk_id")
    found = found.withColumn("at", F.filter("at", lambda a: (a >= 0) & (a + size <= F.col("chars"))))
    greedy = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("free")), lambda s, a: F.when(a >= s["free"], F.struct((s["n"] + 1).alias("n"), (a + size).alias("free"))).otherwise(s))["n"]
    counted = found.select("phrase", "chunk_id", greedy.alias("matches"), "chars", "digest").filter("matches > 0")
    return counted.select("phrase", "chunk_id", "matches", F.round(F.col("matches") / (F.col("chars") + 1) * 1000, 6).alias("score"), "digest")


def forced_recall(found: DataFrame, asked: DataFrame, k: int = 20, boost: float = 1000.0) -> DataFrame:
    """query_id, chunk_id, score: texts that hold a forced phrase of the question, the best of equal texts.

    ``found``: the rows of ``matches`` over the texts; ``asked``: query_id, phrase, its rows over the questions.
    """
    place = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    best = found.withColumn("r", place(["phrase"], F.desc("score"), "chunk_id")).filter(F.col("r") <= k)
    met = asked.select("query_id", "phrase").join(best, "phrase").withColumn("score", F.col("score") + boost)
    unique = met.withColumn("u", place(["query_id", "digest"], F.desc("score"), "chunk_id", "phrase")).filter("u = 1")
    return unique.withColumn("r", place(["query_id"], F.desc("score"), "chunk_id")).filter(F.col("r") <= k).select("query_id", "chunk_id", "score")
