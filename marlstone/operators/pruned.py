"""BM25 over a saved index in blocks: blocks that cannot reach a question's k best are never opened.

Documents of like length share a block of PER_BLOCK.  A block is one row: its
documents, its terms in order, for each term the most often that one document
holds it, and its postings, packed as Spark takes longer for the elements of an
array than for all else.  So a block is made beside the scan, and its bounds are
read without its postings.  Three steps answer all questions of a batch:

1. seeds: the blocks that promise a question most are scored first;
2. bounds: the k-th best score so far is a question's threshold.  A block's
   most for each of the question's terms, summed up, bounds every score in the
   block, and blocks below the threshold stay closed to the question;
3. scores: what is open is scored from its postings, and the threshold rises.

The questions' terms travel to the blocks, so that no posting is shuffled.  The
result is that of ``lexical.bm25_scores``, ties included, whatever is skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from marlstone.operators import lexical
from marlstone.sources.tables import materialise, shared_path

#: Documents of a block, and seed blocks of a question for each of its k places.
PER_BLOCK, SEEDS = 16, 2
#: Tokens that are dealt to blocks at a time; questions of a tile; cells of a table of blocks and a tile's terms, or of its terms and questions; postings that are summed at a time.
TOKENS, TILE, CELLS, ENTRIES = 1 << 22, 64, 1 << 20, 1 << 20
#: Scores are rounded to six digits, and sums of parts differ in their last bits.
SLACK = 1e-5

#: Bytes of a row group, which a task holds while it reads or writes.
GROUP = 32 << 20

_BOUNDS = ("block", "least", "term", "size", "n", "most")
_POSTINGS = ("chunk_id", "dl", "place", "tf")


class Index(NamedTuple):
    """blocks: block, its documents (chunk_id, dl), least dl with a token, its terms (term, its size in bytes, n documents, most tf) and, term by term, its postings (place of the document, tf); terms: term, df; stats: n, avgdl, k1, b.

    A block's terms are one after the other in UTF-8, its numbers are integers of 32 bits; ``postings`` gives them as rows.
    """

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame


def save(corpus: DataFrame, tokens: Column, path: str, k1: float = 1.5, b: float = 0.75, per_block: int = PER_BLOCK) -> Index:
    """Write the index of (chunk_id, text) below ``path``.  The texts are read once, and their blocks are written beside the scan; only terms are shuffled."""
    spark = corpus.sparkSession
    put = lambda df, name: df.write.mode("error").options(**{"compression": "zstd", "parquet.block.size": GROUP}).parquet(f"{path}/{name}") or spark.read.parquet(f"{path}/{name}")
    kind = corpus.schema["chunk_id"].dataType.simpleString()
    layout = f"block long, least int, term binary, size binary, n binary, most binary, chunk_id array<{kind}>, dl array<int>, place binary, tf binary"

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for batch in batches:
            held = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + TOKENS, "right")))
                rows = _laid(batch.slice(at, to - at), block, per_block)
                yield rows
                at, block = to, block + rows.num_rows

    blocks = put(corpus.select("chunk_id", tokens.alias("toks")).mapInArrow(laid, layout), "blocks")
    put(blocks.select("term", "size", "n").mapInArrow(_counted, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")), "terms")
    put(blocks.select(F.explode("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).withColumns({"k1": F.lit(k1), "b": F.lit(b)}), "stats")
    return load(spark, path)


def _laid(texts: pa.RecordBatch, block: int, per_block: int) -> pa.RecordBatch:
    """Blocks, numbered from ``block``, of some texts (chunk_id, toks) in order of their length."""
    length = pc.list_value_length(texts.column(1))
    dl = pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(dl, kind="stable")
    blocks = -(-len(dl) // per_block)
    coded = texts.column(1).flatten().dictionary_encode()
    names = pc.array_sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    code = np.empty(len(names), np.int64)
    code[names] = np.arange(len(names))
    code = code[coded.indices.to_numpy(zero_copy_only=False)]
    row = np.empty(len(dl), np.int64)
    row[order] = np.arange(len(dl))
    row = np.repeat(row, dl)
    key, tf = np.unique((row // per_block * max(len(names), 1) + code) * per_block + row % per_block, return_counts=True)
    pair, place = np.divmod(key, per_block)
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    of_pair, code = np.divmod(pair[first], max(len(names), 1))
    cut = lambda of_block: np.searchsorted(of_block, np.arange(blocks + 1))
    docs, terms, posts = np.minimum(np.arange(blocks + 1) * per_block, len(dl)), cut(of_pair), cut(pair // max(len(names), 1))
    listed = lambda values: pa.ListArray.from_arrays(pa.array(docs.astype(np.int32)), values)
    least = np.where(dl[order] > 0, dl[order], np.iinfo(np.int32).max)
    term = coded.dictionary.take(pa.array(names[code]))
    size = pc.binary_length(term).to_numpy(zero_copy_only=False)
    return pa.RecordBatch.from_pydict({
        "block": pa.array(block + np.arange(blocks)), "least": pa.array(np.minimum.reduceat(least, docs[:-1]).astype(np.int32)),
        "term": _binary(term.buffers()[2], np.append(0, np.cumsum(size))[terms]), "size": _packed(size, terms), "n": _packed(np.diff(first, append=len(pair)), terms), "most": _packed(np.maximum.reduceat(tf, first) if len(first) else tf, terms),
        "chunk_id": listed(texts.column(0).take(pa.array(order))), "dl": listed(length.take(pa.array(order)).cast(pa.int32())), "place": _packed(place, posts), "tf": _packed(tf, posts),
    })


def _binary(values: pa.Buffer | None, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), values or pa.py_buffer(b"")])


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Each row's numbers, those between two cuts, as binary."""
    return _binary(pa.py_buffer(values.astype("<i4")), 4 * cuts)


def _bytes(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of all rows, and where each row's begin and end."""
    cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2] or b"")[cuts[0] : cuts[-1]], cuts - cuts[0]


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows one after the other, and how many each row has."""
    held, cuts = _bytes(column)
    return np.frombuffer(held, "<i4"), np.diff(cuts) // 4


def _terms(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The terms of all blocks one after the other, and how many each block has."""
    size, n = _numbers(batch.column("size"))
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(_bytes(batch.column("term"))[0])]), n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term, summed up over the blocks of a batch."""
    for batch in batches:
        found = pa.table({"term": _terms(batch)[0], "df": pa.array(_numbers(batch.column("n"))[0].astype(np.int64))}).group_by("term").aggregate([("df", "sum")])
        yield from found.select(["term", "df_sum"]).rename_columns(["term", "df"]).to_batches()


def load(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in Index._fields])


def build(corpus: DataFrame, tokens: Column) -> Index:
    return save(corpus, tokens, shared_path(corpus.sparkSession))


def weights(index: Index, questions: DataFrame, query_tokens: Column) -> DataFrame:
    """query_id, term, weight: repeats in the question times idf; written, as each step reads it."""
    raw = index.terms.join(F.broadcast(index.stats)).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    idf = raw.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = lexical.question_terms(questions, query_tokens)
    return materialise(asked.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")))


class _Asked:
    """The terms of a bounded number of questions, by question; and the gain of the index, by (tf, dl)."""

    def __init__(self, index: Index, asked: DataFrame, least: DataFrame | None = None) -> None:
        rows = asked.select("query_id", "term", "weight").toArrow()  # bounded by the caller
        self.words = rows["term"].combine_chunks().unique().sort() if rows.num_rows else pa.array([], pa.string())
        term = pc.index_in(rows["term"], value_set=self.words).to_numpy().astype(np.int64)
        self.ids, query = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
        order = np.lexsort((term, query))
        self.term, self.query, self.weight = term[order], query[order], rows["weight"].to_numpy()[order]
        self.least = np.full(len(self.ids), -np.inf)
        if least is not None:
            known = least.select("query_id", "least").toArrow()  # a row a question
            at = np.searchsorted(self.ids, known["query_id"].to_numpy())
            self.least[at] = known["least"].to_numpy()
        row = index.stats.first()
        self.avgdl, self.k1, self.b = (row["avgdl"] or 1.0, row["k1"], row["b"]) if row else (1.0, 1.5, 0.75)

    def gain(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl))

    def tiles(self) -> Iterator[_Tile]:
        cuts = np.searchsorted(self.query, np.arange(len(self.ids) + 1))
        at = 0
        while at < len(self.ids):
            to = min(at + TILE, len(self.ids))
            to = next(t for t in (*range(to, at + 1, -1), at + 1) if (cuts[t] - cuts[at]) * (t - at) <= 4 * CELLS or t == at + 1)
            yield _Tile(self, at, to, slice(cuts[at], cuts[to]))
            at = to


class _Tile:
    """Some questions and their terms; the most that each block can give them."""

    def __init__(self, asked: _Asked, at: int, to: int, own: slice) -> None:
        self.at, self.n = at, to - at
        self.terms, self.term = np.unique(asked.term[own], return_inverse=True)
        self.query, self.weight = asked.query[own] - at, asked.weight[own]
        self.count = np.bincount(self.query, minlength=self.n)
        self.first = np.cumsum(self.count) - self.count
        self.matrix = np.zeros((len(self.terms), self.n))
        self.matrix[self.term, self.query] = np.maximum(self.weight, 0)
        self.asks = None
        if (self.weight <= 0).any():  # then a bound tells nothing of the terms shared
            self.asks = np.zeros((len(self.terms), self.n))
            self.asks[self.term, self.query] = 1

    def slabs(self, blocks: _Blocks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First block, entry of each (block, term) or -1, bound of each (block, question) or -inf where they share no term."""
        local = np.searchsorted(self.terms, blocks.code).clip(0, len(self.terms) - 1)
        met = np.flatnonzero(self.terms[local] == blocks.code)
        row, local, step = blocks.row[met], local[met], max(1, CELLS // len(self.terms))
        for at in range(0, len(blocks.block), step):
            lo, hi = np.searchsorted(row, [at, at + step])
            shape = (min(step, len(blocks.block) - at), len(self.terms))
            entry, most = np.full(shape, -1), np.zeros(shape)
            entry[row[lo:hi] - at, local[lo:hi]] = met[lo:hi]
            most[row[lo:hi] - at, local[lo:hi]] = blocks.most[met[lo:hi]]
            bound = most @ self.matrix
            shared = bound > 0 if self.asks is None else (most > 0) @ self.asks > 0
            yield at, entry, np.where(shared, bound, -np.inf)


class _Blocks:
    """Rows of blocks, their entries (block, term) of asked terms and, if they were read, their postings."""

    def __init__(self, batch: pa.RecordBatch, asked: _Asked) -> None:
        flat = lambda name: _numbers(batch.column(name))[0]
        self.asked, self.block = asked, batch.column("block").to_numpy()
        term, held = _terms(batch)
        code = pc.fill_null(pc.index_in(term, value_set=asked.words), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(self.block)), held)
        met, n = code >= 0, flat("n").astype(np.int64)
        self.row, self.code, self.n, self.start = row[met], code[met], n[met], (np.cumsum(n) - n)[met]
        self.most = asked.gain(flat("most")[met], batch.column("least").to_numpy()[self.row])
        if "place" in batch.schema.names:
            ids, held = batch.column("chunk_id").flatten(), batch.column("chunk_id").value_lengths().to_numpy().astype(np.int64)
            self.docs, self.width = np.cumsum(held) - held, int(held.max(initial=1))
            self.chunk, self.known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)  # without an id a text counts but is no hit
            self.dl, self.place, self.tf = batch.column("dl").flatten().fill_null(0).to_numpy(), flat("place"), flat("tf")

    def scores(self, tile: _Tile, entry: np.ndarray, at: int, block: np.ndarray, query: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Question, chunk_id and score of every text of some pairs (block, question) of a slab that shares a term."""
        total, lo = np.cumsum(tile.count[query]) * self.width, 0
        while lo < len(query):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + ENTRIES, "right")))
            q, b = query[lo:hi], block[lo:hi]
            m = tile.count[q]
            asks = np.repeat(tile.first[q] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            pair = np.repeat(np.arange(len(q)), m)
            found = entry[b[pair], tile.term[asks]]
            asks, pair, found = asks[found >= 0], pair[found >= 0], found[found >= 0]
            n = self.n[found]
            post = np.repeat(self.start[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pair, weight, place = np.repeat(pair, n), np.repeat(tile.weight[asks], n), self.place[post]
            part = weight * self.asked.gain(self.tf[post], self.dl[self.docs[at + b[pair]] + place])
            cell = pair * self.width + place
            hit = np.flatnonzero(np.bincount(cell, minlength=1))
            score = np.round(np.bincount(cell, part, 1)[hit], 6)
            pair, place = np.divmod(hit, self.width)
            doc = self.docs[at + b[pair]] + place
            known = self.known[doc]
            yield q[pair][known] + tile.at, self.chunk[doc][known], score[known]
            lo = hi


def _met(blocks: DataFrame, asked: _Asked, visit: Callable[[Iterator[_Blocks], _Asked], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``visit`` makes of each task's blocks, to which the questions travel: columns (question, long, double) with the questions' ids put in."""
    shipped = blocks.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        for q, *rest in visit((_Blocks(batch, asked) for batch in batches if batch.num_rows), asked):
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.float64())], names=[c.split()[0] for c in schema.split(", ")])

    return blocks.mapInArrow(run, schema)


def _ranked(scores: DataFrame, *order: Column) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def kth_scores(scores: DataFrame, k: int) -> DataFrame:
    """query_id, least: the k-th largest score, for questions that have as many."""
    return _ranked(scores, F.desc("score")).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))


def seed_blocks(index: Index, asked: DataFrame, seeds: int) -> DataFrame:
    """query_id, block: the blocks of the largest bounds."""

    def best(batches: Iterator[_Blocks], asked: _Asked) -> Iterator[tuple]:
        kept = lexical.RunningBest(len(asked.ids), seeds)
        for blocks in batches:
            for tile in asked.tiles():
                for at, _, bound in tile.slabs(blocks):
                    b, q = np.nonzero(bound > kept.least[tile.at : tile.at + tile.n])
                    kept.add(q + tile.at, blocks.block[at + b], bound[b, q])
        yield kept.rows()

    found = _met(index.blocks.select(*_BOUNDS), _Asked(index, asked), best, "query_id long, block long, bound double")
    return _ranked(found, F.desc("bound"), F.col("block")).filter(F.col("rank") <= seeds).select("query_id", "block")


def open_blocks(index: Index, asked: DataFrame, least: DataFrame) -> DataFrame:
    """query_id, block of the blocks that may hold a document of the question's best."""

    def may(batches: Iterator[_Blocks], asked: _Asked) -> Iterator[tuple]:
        for blocks in batches:
            for tile in asked.tiles():
                for at, _, bound in tile.slabs(blocks):
                    b, q = np.nonzero((bound > -np.inf) & (bound >= asked.least[tile.at : tile.at + tile.n] - SLACK))
                    yield q + tile.at, blocks.block[at + b], bound[b, q]

    return _met(index.blocks.select(*_BOUNDS), _Asked(index, asked, least), may, "query_id long, block long, bound double").select("query_id", "block")


def score_blocks(index: Index, asked: DataFrame, chosen: DataFrame) -> DataFrame:
    """query_id, chunk_id, score of every document that shares a term with the question, in the chosen (query_id, block)."""
    wanted = chosen.groupBy("block").agg(F.collect_set("query_id").alias("queries"))
    needed = index.blocks.select(*_BOUNDS, *_POSTINGS).join(F.broadcast(wanted) if wanted.count() <= lexical.MOST_TERMS else wanted, "block")
    shipped = _Asked(index, asked)
    broadcast = chosen.sparkSession.sparkContext.broadcast(shipped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = broadcast.value
        for batch in batches:
            blocks, queries = _Blocks(batch, asked), batch.column("queries")
            b = np.repeat(np.arange(batch.num_rows), queries.value_lengths().to_numpy())
            q = np.searchsorted(asked.ids, queries.flatten().to_numpy())
            for tile in asked.tiles():
                inside = (q >= tile.at) & (q < tile.at + tile.n)
                for at, entry, _ in tile.slabs(blocks):
                    own = inside & (b >= at) & (b < at + len(entry))
                    for question, chunk, score in blocks.scores(tile, entry, at, b[own] - at, q[own] - tile.at):
                        yield pa.RecordBatch.from_arrays([pa.array(asked.ids[question]), pa.array(chunk), pa.array(score)], names=["query_id", "chunk_id", "score"])

    return needed.mapInArrow(run, "query_id long, chunk_id long, score double")


def _best(index: Index, asked: DataFrame, least: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score: each task's k best of each question, from the blocks that the questions' thresholds leave open."""

    def best(batches: Iterator[_Blocks], asked: _Asked) -> Iterator[tuple]:
        kept = lexical.RunningBest(len(asked.ids), k)
        kept.least = np.nextafter(asked.least, -np.inf)  # what equals the threshold is a hit
        for blocks in batches:
            for tile in asked.tiles():
                own = slice(tile.at, tile.at + tile.n)
                for at, entry, bound in tile.slabs(blocks):
                    b, q = np.nonzero((bound > -np.inf) & (bound >= kept.least[own] - SLACK))
                    for found in blocks.scores(tile, entry, at, b, q):
                        kept.add(*found)
        yield kept.rows()

    rows = lexical.few_tasks(index.blocks.select(*_BOUNDS, *_POSTINGS), index.stats.first()["n"], asked.select("query_id").distinct().count() * k)
    return _met(rows, _Asked(index, asked, least), best, "query_id long, chunk_id long, score double")


def postings(index: Index) -> DataFrame:
    """chunk_id, dl, term, tf: the whole index, a row for each term of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            (place, posts), (n, _) = _numbers(batch.column("place")), _numbers(batch.column("n"))
            held = batch.column("chunk_id").value_lengths().to_numpy().astype(np.int64)
            doc = pa.array(np.repeat(np.cumsum(held) - held, posts) + place)
            yield pa.RecordBatch.from_pydict({
                "chunk_id": batch.column("chunk_id").flatten().take(doc), "dl": batch.column("dl").flatten().take(doc),
                "term": _terms(batch)[0].take(pa.array(np.repeat(np.arange(len(n)), n))), "tf": pa.array(_numbers(batch.column("tf"))[0]),
            })

    kind = index.blocks.schema["chunk_id"].dataType.elementType.simpleString()
    return index.blocks.select("term", "size", "n", *_POSTINGS).mapInArrow(rows, f"chunk_id {kind}, dl int, term string, tf int").filter("chunk_id IS NOT NULL")


def top_k(index: Index, questions: DataFrame, query_tokens: Column, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best of each question by falling score, then chunk_id."""
    asked = weights(index, questions, query_tokens)
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars"), F.countDistinct("query_id").alias("asked")).first()
    parts = max(-(-size["n"] // (8 * lexical.MOST_TERMS)), -(-size["chars"] // (8 * lexical.MOST_CHARACTERS)), -(-size["asked"] * SEEDS * k // lexical.MOST_KEPT), 1)
    if parts > lexical.MOST_BLOCKS or index.blocks.schema["chunk_id"].dataType.elementType != LongType() or asked.schema["query_id"].dataType != LongType():
        return lexical.top_k(_scored(index, asked), k)
    found = None
    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        first = materialise(seed_blocks(index, own, SEEDS * k))
        rows = _best(index, own, kth_scores(score_blocks(index, own, first), k), k)
        found = rows if found is None else found.unionByName(rows)
    return lexical.top_k(found, k)


def _scored(index: Index, asked: DataFrame) -> DataFrame:
    """query_id, chunk_id, score of every pair that shares a term: for ids that are no numbers, and for more questions than can travel."""
    tf, norm = F.col("tf"), 1 - F.col("b") + F.col("b") * F.col("dl") / F.col("avgdl")
    part = F.col("weight") * (tf * (F.col("k1") + 1) / (tf + F.col("k1") * norm))
    return lexical._hits(postings(index), asked, asked.join(F.broadcast(index.stats))).groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
