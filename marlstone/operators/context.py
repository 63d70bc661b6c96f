"""Packing retrieved text into a bounded context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators.chunking import paragraphs


def length_weight(n: Column, low: int = 50, high: int = 300, least: float = 0.5) -> Column:
    return F.when(n < low, F.greatest(F.lit(least), n / low)).when(n <= high, 1.0).otherwise(F.greatest(F.lit(least), high / n))


def paragraph_scores(contexts: DataFrame, keywords: Column, keyword_weight: Column | float = 0.4, similarity_weight: Column | float = 0.6) -> DataFrame:
    """query_id, idx, paragraph, score: keyword share and similarity to the question, by a length weight.

    ``contexts``: query_id, question, text.  keywords: the question's, an array column.  The
    similarity is that of ``tfidf_similarity``; weights may be columns of the question.
    """
    weights = [w if isinstance(w, Column) else F.lit(w) for w in (keyword_weight, similarity_weight)]
    cut = contexts.select("query_id", "question", keywords.alias("words"), weights[0].alias("by_word"), weights[1].alias("by_text"), F.posexplode(paragraphs(F.col("text"))).alias("idx", "paragraph"))
    pairs = cut.select(F.struct("query_id", "idx").alias("pair_id"), F.col("question").alias("a"), F.col("paragraph").alias("b"))
    alike = tfidf_similarity(pairs).select("pair_id.query_id", "pair_id.idx", "similarity")
    low = F.lower("paragraph")
    share = F.coalesce(F.try_divide(F.size(F.filter("words", lambda w: F.contains(low, w))), F.size("words")), F.lit(0.0))
    score = (F.col("by_word") * share + F.col("by_text") * F.coalesce("similarity", F.lit(0.0))) * length_weight(F.length("paragraph"))
    return cut.join(alike, ["query_id", "idx"], "left").select("query_id", "idx", "paragraph", F.round(score, 6).alias("score"))


def compress(scored: DataFrame, contexts: DataFrame | None = None, limit: int = 1500) -> DataFrame:
    """query_id, context, kept: best paragraphs until the limit would be passed; a first one too long is cut.

    With ``contexts`` (query_id, text) a text of at most ``limit`` characters stays as it is, and
    ratio says what is left of each text.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "idx")
    running = F.sum(F.length("paragraph")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = scored.withColumn("place", F.row_number().over(order)).withColumn("running", running)
    kept = placed.filter((F.col("running") <= limit) | (F.col("place") == 1))
    shown = F.when((F.col("place") == 1) & (F.col("running") > limit), F.concat(F.substring("paragraph", 1, limit - 3), F.lit("..."))).otherwise(F.col("paragraph"))
    gathered = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("shown")))).alias("parts"))
    if contexts is None:
        return gathered.select("query_id", F.array_join("parts.shown", "\n\n").alias("context"), F.size("parts").alias("kept"))
    whole = contexts.select("query_id", "text").join(gathered, "query_id", "left")
    context = F.when(F.length("text") <= limit, F.col("text")).otherwise(F.coalesce(F.array_join("parts.shown", "\n\n"), F.lit("")))
    ratio = F.coalesce(F.try_divide(F.length("context").cast("double"), F.length("text")), F.lit(1.0))
    sized = whole.select("query_id", "text", context.alias("context"), F.coalesce(F.size("parts"), F.lit(0)).alias("kept"))
    return sized.select("query_id", "context", "kept", F.round(ratio, 6).alias("ratio"))


def tfidf_similarity(pairs: DataFrame, least: int = 1, most: int = 3) -> DataFrame:
    """pair_id, similarity: cosine of character n-gram tf-idf fitted on just the two texts (a, b).

    Smooth idf over two documents is ln(3 / (1 + df)) + 1: ln(1.5) + 1 for a gram of one text, 1 for both's.
    """
    def grams(c: str) -> Column:
        # Runs of characters by zipping shifted arrays: linear in the text's length.
        characters = F.filter(F.split(F.lower(c), ""), lambda x: x != "")
        size, out, run = F.size(characters), [], characters
        for n in range(1, most + 1):
            if n > 1:
                count = F.greatest(size - n + 1, F.lit(0))
                run = F.zip_with(F.slice(run, F.lit(1), count), F.slice(characters, F.lit(n), count), lambda x, y: F.concat(x, y))
            if n >= least:
                out.append(run)
        return F.concat(*out)

    a = pairs.select("pair_id", F.explode(grams("a")).alias("gram"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    b = pairs.select("pair_id", F.explode(grams("b")).alias("gram"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    counts = a.unionByName(b).groupBy("pair_id", "gram").agg(F.sum("in_a").alias("x"), F.sum("in_b").alias("y"))
    weight = F.when((F.col("x") > 0) & (F.col("y") > 0), 1.0).otherwise(F.log(F.lit(1.5)) + 1)
    w2 = weight * weight
    sums = counts.groupBy("pair_id").agg(F.sum(F.col("x") * F.col("y") * w2).alias("dot"), F.sum(F.col("x") * F.col("x") * w2).alias("xx"), F.sum(F.col("y") * F.col("y") * w2).alias("yy"))
    return sums.select("pair_id", F.round(F.coalesce(F.try_divide("dot", F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0)), 6).alias("similarity"))


def budgeted_context(hits: DataFrame, limit: int = 1500, least_rest: int = 100) -> DataFrame:
    """query_id, context: numbered texts in order of rank up to ``limit`` characters; the first that does not fit is cut if enough room is left."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source", F.lit("\n"), "text")
    order = Window.partitionBy("query_id").orderBy("rank")
    placed = hits.withColumn("block", block).withColumn("end", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest = F.lit(limit) - (F.col("end") - F.length("block"))
    shown = F.when(F.col("end") <= limit, F.col("block")).when(rest > least_rest, F.concat(F.substring("block", F.lit(1), rest.cast("int")), F.lit("...")))
    kept = placed.withColumn("shown", shown).filter("shown is not null")
    gathered = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "shown"))).alias("parts"))
    return gathered.select("query_id", F.array_join("parts.shown", "\n\n").alias("context"), F.size("parts").alias("texts"))


def formatted_documents(hits: DataFrame) -> DataFrame:
    """query_id, formatted, texts: numbered header with the source, then the text, joined by blank lines; their number."""
    block = F.concat(F.lit("Document "), F.col("rank").cast("string"), F.lit(" (source: "), "source", F.lit(")\n"), "text")
    gathered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("parts"))
    return gathered.select("query_id", F.array_join("parts.block", "\n\n").alias("formatted"), F.size("parts").alias("texts"))
