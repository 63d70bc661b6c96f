"""Vector retrieval: exact squared-L2 top-k, distances, normalisation, and an index of inverted lists.

Vectors have equal, fixed size.  ``top_k`` compares questions with all vectors.
The index deals vectors to the cell of their nearest centroid and keeps each
cell's radius; a search probes the nearest cells first, and opens another only
if its bound does not exceed the k-th distance found, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.lexical import RunningBest, few_tasks
from marlstone.sources.tables import materialise

#: Vectors, and questions, that are compared at a time.
BLOCK, TILE = 1024, 1024
#: Question vectors, in numbers, that travel to the tasks at a time (16 MB), and blocks of them, each of which reads the corpus once.
MOST_NUMBERS, MOST_BLOCKS = 1 << 21, 16
FOUND = "query_id long, chunk_id long, distance double"


def normalised(vector: Column) -> Column:
    """The vector at length one; null for a vector without length."""
    square = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(square > 0, F.transform(vector, lambda x: x.cast("double") / F.sqrt(square)))


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.round(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0), 6)


def _best(distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k smallest distances, ties by id."""
    order = np.lexsort((np.broadcast_to(ids, distance.shape), distance))[:, :k]
    return np.repeat(np.arange(len(distance)), order.shape[1]), order.ravel()


def _table(query: np.ndarray, chunk: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"query_id": pa.array(query, pa.int64()), "chunk_id": pa.array(chunk, pa.int64()), "distance": pa.array(distance, pa.float64())})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, distance, rank: the k nearest of each query.

    Blocks of questions of a checked size travel to the vectors, which stay
    where they are; each task keeps a question's running k nearest, and takes up only what may be among them.  Beyond
    MOST_BLOCKS both sides are dealt to blocks that meet in pairs.
    """
    width = (corpus.filter("embedding IS NOT NULL").select(F.size("embedding").alias("n")).first() or {"n": 1})["n"]
    asked = queries.filter("embedding IS NOT NULL").select("query_id", "embedding")
    blocks = max(1, -(-asked.count() * max(width, 1) // MOST_NUMBERS))
    vectors = few_tasks(corpus.filter("embedding IS NOT NULL").select("chunk_id", "embedding"), corpus.count(), asked.count() * k)
    if blocks > MOST_BLOCKS:
        return _ranked(_blockwise(asked.withColumn("cell", F.lit(0)), vectors.withColumn("cell", F.lit(0)), k), k)
    found = None
    for block in range(blocks):
        part = _nearest_of(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block), vectors, k)
        found = part if found is None else found.unionByName(part)
    return _ranked(found, k)


def _score(distance: np.ndarray) -> np.ndarray:
    """Falls with the distance; what is not a number comes after all numbers."""
    return np.where(np.isnan(distance), -np.inf, -np.minimum(distance, np.finfo(float).max))


def _distance(score: np.ndarray) -> np.ndarray:
    return np.where(np.isneginf(score), np.nan, np.where(score == -np.finfo(float).max, np.inf, np.abs(score)))


def _nearest_of(asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    rows = asked.toArrow()  # bounded by the caller
    shipped = vectors.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), _matrix(rows["embedding"])))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shipped.value
        own = (x**2).sum(axis=1)
        tiles = [(slice(at, at + TILE), RunningBest(min(TILE, len(ids) - at), k)) for at in range(0, len(ids), TILE)]
        for some in (batch.slice(at, BLOCK) for batch in batches for at in range(0, batch.num_rows, BLOCK)):
            chunk, y = some.column(0).to_numpy(), _matrix(some.column(1))
            squares = (y**2).sum(axis=1)
            for tile, best in tiles:
                square = own[tile, None] + squares[None, :] - 2 * x[tile] @ y.T
                most = -best.least + 1e-5  # distances are rounded to six digits
                if np.isinf(most).any() and len(chunk) > k:
                    most = np.fmin(most, np.partition(square, k - 1, axis=1)[:, k - 1] + 1e-5)
                q, c = np.divmod(np.flatnonzero(~(square > most[:, None])), len(chunk))  # what is not a number is farthest, and stays until there are k nearer
                best.add(q, chunk[c], _score(np.round(np.maximum(square[q, c], 0), 6)))
        for tile, best in tiles:
            q, c, score = best.rows()
            yield _table(ids[tile][q], c, _distance(score))

    return vectors.mapInArrow(nearest, FOUND)


def _blockwise(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, chunk_id, distance: the k nearest in each block of a query's cells (both sides have a ``cell``).

    Each side of a cell is dealt to blocks by a hash of the id, and a task sees
    one block of either, however many a cell holds.
    """
    n = vectors.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("nc"))
    m = queries.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("nq"))
    sizes = F.broadcast(n.join(m, "cell"))  # a row per cell, whose number is bounded
    deal = lambda own, count: F.pmod(F.xxhash64(own), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    c = vectors.join(sizes, "cell").withColumn("bc", deal("chunk_id", "nc")).select("cell", "bc", every("nq").alias("bq"), F.lit(False).alias("asks"), F.col("chunk_id").alias("id"), "embedding")
    q = queries.join(sizes, "cell").withColumn("bq", deal("query_id", "nq")).select("cell", every("nc").alias("bc"), "bq", F.lit(True).alias("asks"), F.col("query_id").alias("id"), "embedding")

    def nearest(group: pa.Table) -> pa.Table:
        asks, ids, vectors_ = group.column("asks").to_numpy(), group.column("id").to_numpy(), _matrix(group.column("embedding"))
        if asks.all() or not asks.any():
            return pa.Table.from_batches([_table(*[np.zeros(0)] * 3)])
        square = _squares(vectors_[asks], vectors_[~asks])
        row, column = _best(square, ids[~asks], k)
        return pa.Table.from_batches([_table(ids[asks][row], ids[~asks][column], square[row, column])])

    return c.unionByName(q).groupBy("cell", "bc", "bq").applyInArrow(nearest, FOUND)


#: Vectors that centroids are fitted on, at most; rounds of the fit; cells at most; cells of a query that are probed first.
SAMPLE, ROUNDS, MOST_CELLS, PROBES = 8192, 8, 1024, 2


class Index(NamedTuple):
    """lists: cell, chunk_id, embedding; cells: cell, centroid, radius (the largest distance of a member), n."""

    lists: DataFrame
    cells: DataFrame


def _centroids(vectors: DataFrame, cells: int) -> np.ndarray:
    """Means of a bounded sample, the rows of least id hash: the same for the same rows, whatever their order."""
    rows = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).toArrow()
    x = _matrix(rows["embedding"])
    means = x[: max(1, min(cells, len(x)))].copy()
    for _ in range(ROUNDS if len(x) else 0):
        own = _squares(x, means).argmin(axis=1)
        count = np.bincount(own, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, own, x)
        means[count > 0] = sums[count > 0] / count[count > 0][:, None]
    return means


def save(vectors: DataFrame, path: str, cells: int | None = None) -> Index:
    """Write the index of (chunk_id, embedding) below ``path``; rows without a vector are left out.  Lists are clustered by cell, large ones over several files."""
    spark = vectors.sparkSession
    vectors = vectors.filter("embedding IS NOT NULL").select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = vectors.count()
    means = _centroids(vectors, min(MOST_CELLS, cells or max(1, int(n**0.5))))
    shipped = spark.sparkContext.broadcast(means)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                square = np.maximum((x**2).sum(axis=1)[:, None] + (shipped.value**2).sum(axis=1)[None, :] - 2 * x @ shipped.value.T, 0)
                cell = square.argmin(axis=1)
                reach = np.sqrt(((x - shipped.value[cell]) ** 2).sum(axis=1))
                yield pa.record_batch({"cell": pa.array(cell, pa.int32()), "chunk_id": batch.column(0), "embedding": batch.column(1), "reach": pa.array(reach)})

    dealt = vectors.mapInArrow(assign, "cell int, chunk_id long, embedding array<double>, reach double")
    dealt.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id").write.mode("error").parquet(f"{path}/lists")
    held = spark.read.parquet(f"{path}/lists").groupBy("cell").agg(F.max("reach").alias("radius"), F.count("*").alias("n"))
    centroids = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(means)], "cell int, centroid array<double>")
    centroids.join(held, "cell").coalesce(1).write.mode("error").parquet(f"{path}/cells")  # MOST_CELLS rows at most
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/lists").drop("reach"), spark.read.parquet(f"{path}/cells"))


def _opened(queries: DataFrame, index: Index, first: bool) -> DataFrame:
    """query_id, embedding, cell: the PROBES nearest cells of each query, or (with a column ``least``) the others that may hold a nearer vector.

    The bounds: a member is no nearer than the centroid less the radius, nor, as
    it lies on its own centroid's side of the plane half way to the query's
    nearest centroid, than that plane.
    """
    rows = index.cells.toArrow()  # MOST_CELLS rows at most
    shipped = queries.sparkSession.sparkContext.broadcast((rows["cell"].to_numpy(), _matrix(rows["centroid"]), rows["radius"].to_numpy()))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, means, radius = shipped.value
        apart = np.sqrt(np.maximum((means**2).sum(axis=1)[:, None] + (means**2).sum(axis=1)[None, :] - 2 * means @ means.T, 0))
        for batch in batches:
            if not batch.num_rows or not len(cell):
                continue
            x = _matrix(batch.column(1))
            square = np.maximum((x**2).sum(axis=1)[:, None] + (means**2).sum(axis=1)[None, :] - 2 * x @ means.T, 0)
            place = np.argsort(np.argsort(square, axis=1, kind="stable"), axis=1)
            chosen = place < PROBES
            if not first:
                nearest = square.argmin(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.nan_to_num((square - square.min(axis=1)[:, None]) / (2 * apart[nearest]), nan=0.0, posinf=0.0)
                bound = np.maximum(np.maximum(np.sqrt(square) - radius, plane), 0)
                least = np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
                chosen = ~chosen & (bound**2 <= least[:, None] + 1e-5)  # distances are rounded to six digits
            row, column = np.nonzero(chosen)
            yield pa.record_batch({"query_id": batch.column(0).take(row), "embedding": batch.column(1).take(row), "cell": pa.array(cell[column], pa.int32())})

    return queries.mapInArrow(choose, "query_id long, embedding array<double>, cell int")


def probes(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, embedding, cell of the lists that are read first."""
    return _opened(queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), index, True)


def still_open(queries: DataFrame, index: Index, found: DataFrame, k: int) -> DataFrame:
    """query_id, embedding, cell of the lists that ``found`` (query_id, distance, rank) does not rule out."""
    least = found.filter(F.col("rank") == k).select("query_id", F.col("distance").alias("least"))
    asked = queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return _opened(asked.join(least, "query_id", "left"), index, False)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``top_k`` over the index: exact, whatever lists stay closed."""
    found = materialise(_ranked(_blockwise(probes(queries, index), index.lists, k), k))
    more = _blockwise(materialise(still_open(queries, index, found, k)), index.lists, k)
    return _ranked(found.drop("rank").unionByName(more), k)
