"""Words of scripts without blanks: a dictionary learnt from the corpus, and the best path of its words over each run.

A run is a maximal stretch of letters of the script.  Runs are counted once, and
everything below works on distinct runs with their counts.  A gram is a word if
it is frequent, coheres (it is more frequent than any split of it would let
expect) and is free (many different letters, and run ends, stand on either side).  A
single letter is always a word.  A run's best path has the largest sum of its
words' weights, the logarithms of their shares in millionths, as whole numbers, so sums are
exact; among equal paths, later words are the longer ones.

Defined results: null and empty texts have no runs; case is kept; a run longer than ``LONGEST`` is cut there, into runs of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.sources.tables import materialise

#: Ideographs; letters of a word at most.
SCRIPT, MOST = "[一-龥]", 4
#: Letters of a run, as the path's arrays grow with it.
LONGEST = 1000


def runs(corpus: DataFrame, script: str = SCRIPT) -> DataFrame:
    """run, n of the texts."""
    return corpus.select(F.explode(F.regexp_extract_all("text", F.lit(f"{script}{{1,{LONGEST}}}"), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def _grams(counted: DataFrame, most: int) -> DataFrame:
    """gram, n of every gram of up to ``most`` letters of the runs."""
    length = F.length("run")
    places = F.sequence(F.lit(0), length - 1)
    cut = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), length - i)), lambda k: F.substring("run", i + 1, k))))
    return counted.select("n", F.explode(cut).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))


def _freedom(grams: DataFrame, side: str) -> DataFrame:
    """gram, side: entropy of the letter before or after a gram; where a run ends beside it, that is a letter of its own."""
    length = F.length("gram")
    inner = F.substring("gram", F.lit(2), length) if side == "before" else F.substring("gram", F.lit(1), length - 1)
    longer = grams.filter(length >= 2).select(inner.alias("gram"), F.col("n").alias("k"))
    # -sum p ln p with p = k / n is ln n - sum(k ln k) / n
    sums = longer.groupBy("gram").agg(F.sum("k").alias("inside"), F.sum(F.col("k") * F.log("k")).alias("kk"))
    met = grams.join(sums, "gram", "left").na.fill(0, ["inside"]).na.fill(0.0, ["kk"])
    ends = F.col("n") - F.col("inside")
    total = F.col("kk") + F.when(ends > 0, ends * F.log(ends)).otherwise(0.0)
    return met.select("gram", F.round(F.log("n") - total / F.col("n"), 6).alias(side))


def learn(counted: DataFrame, most: int = MOST, least: int = 5, cohesion: float = 10.0, freedom: float = 1.0) -> DataFrame:
    """word, n, weight of the words of the runs (run, n)."""
    everything = materialise(_grams(counted, most + 1))
    grams = everything.filter(F.length("gram") <= most)
    total = everything.filter(F.length("gram") == 1).agg(F.sum("n").alias("total"))  # one row
    longer = grams.filter((F.length("gram") >= 2) & (F.col("n") >= least))
    splits = longer.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("i"))
    splits = splits.select("gram", "n", F.substring("gram", F.lit(1), F.col("i")).alias("head"), F.substring("gram", F.col("i") + 1, F.length("gram")).alias("tail"))
    part = lambda name, count: grams.select(F.col("gram").alias(name), F.col("n").alias(count))
    held = splits.join(part("head", "nh"), "head").join(part("tail", "nt"), "tail").join(F.broadcast(total))
    bound = held.groupBy("gram").agg(F.min(F.round(F.col("n") * F.col("total") / F.col("nh") / F.col("nt"), 6)).alias("cohesion"))
    free = _freedom(everything, "before").join(_freedom(everything, "after"), "gram")
    words = longer.join(bound.filter(F.col("cohesion") >= cohesion), "gram").join(free.filter((F.col("before") >= freedom) & (F.col("after") >= freedom)), "gram").select("gram", "n")
    chosen = words.unionByName(grams.filter(F.length("gram") == 1).select("gram", "n")).join(F.broadcast(total))
    return chosen.select(F.col("gram").alias("word"), "n", F.round(F.log(F.col("n") / F.col("total")) * 1_000_000).cast("long").alias("weight"))


def segment(distinct: DataFrame, dictionary: DataFrame, most: int = MOST) -> DataFrame:
    """run, words: the best path over every run of ``distinct`` (run), all of whose single letters the dictionary (word, weight) holds.

    The words that lie in a run meet the dictionary once; the path is a fold over the places of the run, which keeps
    each place's best score and where its last word begins.
    """
    length = F.length("run")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), length), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), i)), lambda k: F.struct(i.alias("end"), k.alias("size"), F.substring("run", i - k + 1, k).alias("word")))))
    lying = distinct.select("run", F.explode(spans).alias("s")).select("run", "s.end", "s.size", "s.word").join(dictionary.select("word", "weight"), "word")
    by_place = lying.groupBy("run", "end").agg(F.collect_list(F.struct("size", "weight")).alias("edges"))  # ``most`` at most
    placed = by_place.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("end", "edges"))).alias("places"))
    kind = "array<struct<score:bigint,size:int>>"

    def step(best: Column, place: Column) -> Column:
        reached = F.transform(place["edges"], lambda e: F.struct((F.get(best, place["end"] - e["size"])["score"] + e["weight"]).alias("score"), e["size"].alias("size")))
        return F.array_append(best, F.array_max(reached))

    folded = placed.withColumn("best", F.aggregate("places", F.array(F.struct(F.lit(0).cast("long").alias("score"), F.lit(0).alias("size"))).cast(kind), step))
    begin = F.struct(length.alias("at"), F.array().cast("array<string>").alias("words"))

    def back(state: Column, _: Column) -> Column:
        return X.let(F.get("best", state["at"])["size"], lambda size: F.when(state["at"] > 0, F.struct((state["at"] - size).alias("at"), F.array_append(state["words"], F.substring("run", state["at"] - size + 1, size)).alias("words"))).otherwise(state))

    return folded.select("run", F.reverse(F.aggregate(F.sequence(F.lit(1), length), begin, back)["words"]).alias("words"))
