"""Grounding of answers in the turns or documents they rest on, which stay rows.

``said``: answer_id, group, question, answer.  ``turns``: group, place, text; the
rows of a group, in the order of ``place``, are the context of its answers.  No
context is put together: what an answer and its context share (tokens, pairs of
tokens, characters, facts) meets on (group, item).
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import lexicons as L
from marlstone.functions import text as X
from marlstone.operators import validate as V
from marlstone.sources.tables import materialise


def _characters(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[ \n]", ""), ""), lambda x: x != "")


def _items(rows: DataFrame, key: str, items: Column) -> DataFrame:
    return rows.select(key, F.explode(F.array_distinct(items)).alias("item"))


def _shares(said: DataFrame, own: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """answer_id, name: the share of an answer's items that its group knows; 0 for an answer without any."""
    met = own.join(known.withColumn("found", F.lit(1)), ["group", "item"], "left")
    counted = met.groupBy("answer_id").agg(F.round(F.count("found") / F.count("*"), 6).alias(name))
    return said.select("answer_id").join(counted, "answer_id", "left").na.fill(0.0, [name])


def shared_tokens(said: DataFrame, turns: DataFrame) -> DataFrame:
    """answer_id, rouge."""
    own = said.select("answer_id", "group", F.explode(F.array_distinct(X.tokens(F.col("answer"), least=1))).alias("item"))
    return _shares(said, own, _items(turns, "group", X.tokens(F.col("text"), least=1)).distinct(), "rouge")


def shared_characters(said: DataFrame, turns: DataFrame) -> DataFrame:
    """answer_id, overlap."""
    own = said.select("answer_id", "group", F.explode(F.array_distinct(_characters(F.col("answer")))).alias("item"))
    return _shares(said, own, _items(turns, "group", _characters(F.col("text"))).distinct(), "overlap")


def shared_bigrams(said: DataFrame, turns: DataFrame) -> DataFrame:
    """answer_id, bleu.  A pair may cross from one row of the context to the next, of which each row's first and last token are needed only."""
    own = said.select("answer_id", "group", F.explode(V.bigrams(F.col("answer"))).alias("item"))
    tokens = X.tokens(F.col("text"), least=1)
    within = _items(turns, "group", V.bigrams(F.col("text")))
    ends = turns.select("group", "place", "text", tokens.alias("t")).filter(F.size("t") > 0).select("group", "place", F.md5("text").alias("by"), F.get("t", F.lit(0)).alias("first"), F.element_at("t", -1).alias("last"))
    before = F.lag("last").over(Window.partitionBy("group").orderBy("place", "by"))
    across = ends.select("group", F.concat_ws(" ", before, F.col("first")).alias("item"), before.alias("b")).filter("b IS NOT NULL").drop("b")
    return _shares(said, own, within.unionByName(across).distinct(), "bleu")


#: Facts of a bucket of groups, about; facts of a block of either side of a large one; counted letter classes; shared words that are counted at a time.
BUCKET, BLOCK, CLASSES, MEETINGS = 256, 2048, 64, 1 << 20


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        both = row & places.get(c, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def _by_words(own: np.ndarray, known: np.ndarray, group: np.ndarray, words: pa.ListArray, share: float) -> np.ndarray:
    """Which of the rows ``own`` have at least ``share`` of their distinct words in one row of ``known`` of their group; one without words needs any row there."""
    n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    codes = words.flatten().dictionary_encode()
    word, first, many = codes.indices.to_numpy().astype(np.int64), np.cumsum(n) - n, max(len(codes.dictionary), 1)
    place = lambda rows: np.repeat(first[rows] - (np.cumsum(n[rows]) - n[rows]), n[rows]) + np.arange(n[rows].sum())  # noqa: E731  of the rows' words
    held = np.repeat(group[known], n[known]) * many + word[place(known)]
    order = np.argsort(held, kind="stable")
    held, holder = held[order], np.repeat(np.arange(len(known)), n[known])[order]
    asked = np.repeat(group[own], n[own]) * many + word[place(own)]
    low, high = np.searchsorted(held, asked), np.searchsorted(held, asked, "right")
    met = np.cumsum(np.concatenate([[0], high - low]))[np.cumsum(np.concatenate([[0], n[own]]))]  # words met by the rows before
    found = (n[own] == 0) & np.isin(group[own], group[known])
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(met, met[at] + MEETINGS, "right")) - 1)
        lo, hi = n[own][:at].sum(), n[own][:to].sum()
        size = high[lo:hi] - low[lo:hi]
        rows = holder[np.repeat(low[lo:hi] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        pair, common = np.unique(np.repeat(np.repeat(np.arange(at, to), n[own][at:to]), size) * max(len(known), 1) + rows, return_counts=True)
        asks = pair // max(len(known), 1)
        found[asks[common >= n[own][asks] * share]] = True
        at = to
    return found


def _alike(similarity: float, share: float | None):
    """A function of a block's rows that gives the facts that a known fact of their group holds by words or by edit ratio."""

    def compare(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        asks = block.column("asks").to_numpy(zero_copy_only=False)
        fact = block.column("fact").to_pylist()
        length = np.fromiter(map(len, fact), np.int64, len(fact))
        letters = np.frombuffer("".join(fact).encode("utf-32-le"), np.uint32).astype(np.int64) % CLASSES
        counts = np.bincount(np.repeat(np.arange(len(fact)), length) * CLASSES + letters, minlength=len(fact) * CLASSES).reshape(-1, CLASSES)
        group = pc.rank(block.column("group"), tiebreaker="dense").to_numpy().astype(np.int64)
        own, known = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        out: list[int] = []
        if share is not None and len(own):
            held = _by_words(own, known, group, block.column("words").combine_chunks(), share)
            out, own = own[held].tolist(), own[~held]
        known = known[np.lexsort((length[known], group[known]))]
        reach = int(length.max(initial=0)) + 1
        key = group[known] * reach + length[known]
        for i in own:
            # the matched characters are at most the shorter text's, and at most those that both have of each class
            least, most = np.ceil(length[i] * similarity / (2 - similarity) - 1e-9), np.floor(length[i] * (2 - similarity) / similarity + 1e-9)
            same = known[np.searchsorted(key, group[i] * reach + least) : np.searchsorted(key, group[i] * reach + min(most, reach - 1), "right")]
            same = same[np.minimum(counts[i], counts[same]).sum(axis=1) >= similarity * (length[i] + length[same]) / 2]
            for j in same:
                total = len(fact[i]) + len(fact[j])
                if 2 * subsequence(fact[i], fact[j]) >= similarity * total and difflib.SequenceMatcher(None, fact[i], fact[j]).ratio() >= similarity:
                    out.append(i)
                    break
        return block.select(["group", "fact"]).take(pa.array(out, pa.int64()))

    return compare


def similar_facts(own: DataFrame, known: DataFrame, similarity: float = 0.6, share: float | None = None) -> DataFrame:
    """group, fact of ``own`` (distinct) with a fact of edit ratio ``similarity`` among the group's ``known`` ones (distinct) or,
    if ``share`` is given, with one that holds that share of its distinct words.

    Groups are dealt to buckets of about BUCKET facts, and a larger bucket's sides to blocks that meet in pairs, so
    neither many small groups nor a large one make a task large.  Words are counted where the facts meet, so a fact travels once
    for each block of the other side and not once for each of its words.  Within a block, lengths, counts of letters and
    the longest common subsequence bound the ratio from above; it is computed for what is left.
    """
    kind = dict(own.dtypes)["group"]
    size = known.count()
    buckets = max(1, -(-size // BUCKET))
    deal = lambda df: df.select("group", "fact", F.pmod(F.xxhash64("group"), F.lit(buckets)).alias("bucket"))
    own, known = deal(own), deal(known)
    blocks = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = materialise(blocks(own, "no").join(blocks(known, "nk"), "bucket"))
    large = F.broadcast(sizes.filter("no > 1 OR nk > 1"))  # of which there are at most a BLOCK-th of the facts
    place = lambda n: F.pmod(F.xxhash64("fact"), F.coalesce(F.col(n), F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    words = (F.array().cast("array<string>") if share is None else F.array_distinct(X.tokens(F.col("fact")))).alias("words")
    a = own.join(large, "bucket", "left").withColumn("bo", place("no")).select("bucket", "bo", every("nk").alias("bk"), F.lit(True).alias("asks"), "group", "fact", words)
    b = known.join(large, "bucket", "left").withColumn("bk", place("nk")).select("bucket", every("no").alias("bo"), "bk", F.lit(False).alias("asks"), "group", "fact", words)
    return a.unionByName(b).groupBy("bucket", "bo", "bk").applyInArrow(_alike(similarity, share), f"group {kind}, fact string").distinct()


def facts_of(rows: DataFrame, text: str, keys: tuple[str, ...], patterns: tuple[str, ...], indicators: str, delimiters: str) -> DataFrame:
    """The keys and each fact of the text; a factual sentence that repeats is a fact each time."""
    return rows.select(*keys, F.explode(V.facts(F.col(text), patterns, indicators, delimiters)).alias("fact"))


def support(said: DataFrame, turns: DataFrame, patterns: tuple[str, ...] = L.FACT_PATTERNS, indicators: str = L.FACT_INDICATORS, delimiters: str = "。！？\n", fuzzy: bool = True) -> DataFrame:
    """answer_id, n_facts, n_supported, dated (a fact holds a date).

    A fact is supported by an equal one of its group and, if ``fuzzy``, by one of edit ratio 0.6 or one that holds 60 % of its words.
    Each way looks only at what the one before has left.
    """
    own = materialise(facts_of(said, "answer", ("answer_id", "group"), patterns, indicators, delimiters))
    known = materialise(facts_of(turns, "text", ("group",), patterns, indicators, delimiters).distinct())
    backed = own.select("group", "fact").distinct().join(known, ["group", "fact"], "left_semi")
    if fuzzy:
        backed = materialise(backed)
        left = materialise(own.select("group", "fact").distinct().join(backed, ["group", "fact"], "left_anti"))
        backed = backed.unionByName(similar_facts(left, known, share=0.6))
    met = own.join(backed.withColumn("found", F.lit(1)), ["group", "fact"], "left")
    counted = met.groupBy("answer_id").agg(F.count("*").alias("n_facts"), F.count("found").alias("n_supported"), F.max(F.col("fact").rlike(L.DATE_PATTERN)).alias("dated"))
    return said.select("answer_id").join(counted, "answer_id", "left").na.fill(0, ["n_facts", "n_supported"]).na.fill(False, ["dated"])


def validate(said: DataFrame, turns: DataFrame, patterns: tuple[str, ...] = L.FACT_PATTERNS, indicators: str = L.FACT_INDICATORS, delimiters: str = "。！？\n", fuzzy: bool = True, off_topic: tuple[float, float, float] = (0.3, 0.2, 0.25), hallucination: float = 0.2) -> DataFrame:
    """answer_id, rouge, bleu, overlap, n_facts, n_supported, off_topic, confidence, coverage, hallucination of every answer whose group has a context."""
    said = said.join(turns.select("group").distinct(), "group", "left_semi")
    measures = support(said, turns, patterns, indicators, delimiters, fuzzy)
    for part in (shared_tokens, shared_bigrams, shared_characters):
        measures = measures.join(part(said, turns), "answer_id")
    rouge, bleu, overlap, n, k = (F.col(c) for c in ("rouge", "bleu", "overlap", "n_facts", "n_supported"))
    off = (rouge < off_topic[0]) & (bleu < off_topic[1]) & (overlap < off_topic[2])
    out = measures.withColumns({"off_topic": off, "confidence": F.round(V.confidence(rouge, bleu, overlap, n, k, F.col("dated")), 6)})
    coverage = F.round(F.coalesce(F.try_divide(k.cast("double"), n.cast("double")), F.lit(1.0)), 6)
    return out.withColumns({"coverage": coverage, "hallucination": F.col("off_topic") | (F.col("confidence") < hallucination)}).drop("dated")


def _times(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]))


def enhance(validated: DataFrame, said: DataFrame, turns: DataFrame, pairs: tuple[tuple[str, str], ...] = L.CONTRADICTIONS, times: tuple[str, ...] = L.TIME_PATTERNS, uncertain: tuple[str, ...] = L.UNCERTAIN, hallucination: float = 0.2, shared: int = 3) -> DataFrame:
    """Add contradicts, times_agree and complete; an answer that fails any of them has its confidence times 0.8, and is judged by that.

    A contradiction: the answer holds a negation whose positive the context holds, and they share more than ``shared`` tokens.  Times agree when the context has each of the answer's.
    """
    cased = lambda c: X.tokens(F.col(c), lower=False, least=1)
    own = said.select("answer_id", "group", F.explode(F.array_distinct(cased("answer"))).alias("item"))
    met = own.join(_items(turns, "group", cased("text")).distinct(), ["group", "item"]).groupBy("answer_id").agg(F.count("*").alias("common"))
    holds = turns.groupBy("group").agg(*[F.max(F.contains("text", F.lit(p))).alias(f"p{i}") for i, (_, p) in enumerate(pairs)])
    asked = said.select("answer_id", "group", F.explode(_times(F.col("answer"), times)).alias("item")).join(_items(turns, "group", _times(F.col("text"), times)).distinct(), ["group", "item"], "left_anti").select("answer_id").distinct().withColumn("late", F.lit(True))
    rows = said.join(met, "answer_id", "left").join(holds, "group", "left").join(asked, "answer_id", "left")
    against = F.lit(False)
    for i, (negation, _) in enumerate(pairs):
        against = against | (F.contains("answer", F.lit(negation)) & F.coalesce(f"p{i}", F.lit(False)))
    checks = rows.select("answer_id", (against & (F.coalesce("common", F.lit(0)) > shared)).alias("contradicts"), F.col("late").isNull().alias("times_agree"), V.complete(F.col("question"), F.col("answer"), uncertain).alias("complete"))
    out = validated.join(checks, "answer_id")
    failed = F.col("contradicts") | ~F.col("times_agree") | ~F.col("complete")
    lowered = F.when(failed, F.round(F.col("confidence") * 0.8, 6)).otherwise(F.col("confidence"))
    return out.withColumn("confidence", lowered).withColumn("hallucination", F.col("off_topic") | (F.col("confidence") < hallucination))
