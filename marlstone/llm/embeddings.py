"""Operator 3: embedding near-duplicates by product quantisation.

Method: vectors of length one are assigned to coarse cells; the residual is
coded per subspace.  A query probes every cell that can hold a vector within
the radius (its distance to the plane between the cell and its own is no more
than that), compares by table look-up of asymmetric distances, less each
vector's own coding error, and the survivors are reranked by the exact cosine.
Both cuts are lower bounds of the true distance, so no link is lost, however
the centroids came out; they are fitted on a bounded sample (``SAMPLE``).

Equal vectors of a label form one class with a count and are compared once.
Cells are cut into blocks of ``BLOCK`` vectors, and blocks meet in pairs: no
task sees more than two blocks at a time.

Contract: one row per input row.  A vector that is null, empty, zero or holds
null or non-finite components, or whose label is null, links with nothing.
Vectors of different sizes do not link.  Repeated rows of an id with the same
vector count as one vector; a null id links with nothing.  Extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialise
from marlstone.llm.components import connected_components

LEAST_COSINE = 0.98
SAMPLE = 8192
SUBSPACES, CODES = 8, 64
BLOCK = 512


@dataclass(frozen=True)
class Quantiser:
    coarse: np.ndarray  # cells x dim
    codebooks: np.ndarray  # subspaces x codes x width
    dim: int  # padded to a multiple of SUBSPACES


def _kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(rounds):
        nearest = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        size = np.bincount(nearest, minlength=k)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def unit(rows: list, dim: int) -> np.ndarray:
    """Vectors of length one, padded with zeros.  A power of two, which changes no digit, brings the largest component near one first, so no square under- or overflows."""
    out = np.zeros((len(rows), dim))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    out = np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, keepdims=True, initial=0))[1])
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, cells: int) -> Quantiser:
    coarse = _kmeans(sample, cells)
    nearest = ((coarse**2).sum(axis=1) - 2 * sample @ coarse.T).argmin(axis=1)
    parts = (sample - coarse[nearest]).reshape(len(sample), SUBSPACES, -1)
    return Quantiser(coarse, np.stack([_kmeans(parts[:, s], CODES) for s in range(SUBSPACES)]), sample.shape[1])


def _assign(q: Quantiser, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of each vector; which cells each must probe."""
    square = (x**2).sum(axis=1)[:, None] + (q.coarse**2).sum(axis=1)[None, :] - 2 * x @ q.coarse.T
    own = square.argmin(axis=1)
    between = np.sqrt(np.maximum((q.coarse**2).sum(axis=1)[:, None] + (q.coarse**2).sum(axis=1)[None, :] - 2 * q.coarse @ q.coarse.T, 0))[own]
    plane = (square - square[np.arange(len(x)), own][:, None]) / (2 * np.maximum(between, 1e-12))
    probe = plane <= radius + 1e-6
    probe[np.arange(len(x)), own] = True
    return own, probe


def _links(q: Quantiser, cell: int, x: np.ndarray, y: np.ndarray, radius: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, item of the cell) of cosine ``least`` or more."""
    residual = (y - q.coarse[cell]).reshape(len(y), SUBSPACES, -1)
    codes = np.stack([((residual[:, s, None, :] - q.codebooks[s][None]) ** 2).sum(axis=2).argmin(axis=1) for s in range(SUBSPACES)], axis=1)
    decoded = np.stack([q.codebooks[s][codes[:, s]] for s in range(SUBSPACES)], axis=1)
    error = np.sqrt(((residual - decoded) ** 2).sum(axis=(1, 2)))
    query = (x - q.coarse[cell]).reshape(len(x), SUBSPACES, -1)
    near = np.zeros((len(x), len(y)))
    for s in range(SUBSPACES):  # asymmetric: the query is exact, the item is its code
        table = ((query[:, s, None, :] - q.codebooks[s][None]) ** 2).sum(axis=2)
        near += table[:, codes[:, s]]
    i, j = np.nonzero(np.sqrt(near) <= radius + error[None, :] + 1e-6)
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 14):
        b = slice(a, a + (1 << 14))
        keep[b] = np.einsum("ij,ij->i", x[i[b]], y[j[b]]) >= least
    return i[keep], j[keep]


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect, one fewer than its nodes for each part."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    out = []
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    radius = float(np.sqrt(2 - 2 * least))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", "embedding", sound.alias("sound"))
    key = ["label", "embedding"]
    distinct = rows.filter("sound").select("vec_id", *key).distinct()
    classes = materialise(distinct.groupBy(*key).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    n = classes.count()
    cells = int(min(1024, max(8, round(n**0.5 / 4))))
    head = classes.orderBy(F.xxhash64("node"), "node").limit(min(SAMPLE, 64 * cells)).select("embedding").toArrow()  # bounded
    raw = head.column(0).to_pylist()
    widest = classes.agg(F.max(F.size("embedding"))).first()[0] or SUBSPACES
    dim = -(-widest // SUBSPACES) * SUBSPACES
    q = fit(unit(raw, dim) if raw else np.eye(SUBSPACES), cells if raw else 1)
    shipped = spark.sparkContext.broadcast(q)  # at most 1024 cells

    kind = F.struct("label", F.size("embedding").alias("size"))
    base = classes.select(F.xxhash64(kind).alias("group"), kind.alias("kind"), "node", "copies", "embedding")

    @F.arrow_udf("struct<cell: int, probes: array<int>>")
    def place(embedding: pa.Array) -> pa.Array:
        own, probe = _assign(shipped.value, unit(embedding.to_pylist(), shipped.value.dim), radius)
        r, c = np.nonzero(probe)
        offsets = np.searchsorted(r, np.arange(len(own) + 1)).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(own.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(c.astype(np.int32)))], names=["cell", "probes"])

    placed = materialise(base.select("kind", "node", "copies", "embedding", place("embedding").alias("p")).select("kind", "node", "copies", "embedding", "p.cell", "p.probes"))
    queries = placed.select("kind", "node", "copies", "embedding", F.explode("probes").alias("cell"))
    # Blocks of each cell: as many as its items and its queries need.
    held = placed.groupBy("kind", "cell").agg(F.count("*").alias("items"))
    asked = queries.groupBy("kind", "cell").agg(F.count("*").alias("queries"))
    blocks = materialise(held.join(asked, ["kind", "cell"]).select("kind", "cell", F.ceil(F.col("items") / block).cast("int").alias("ni"), F.ceil(F.col("queries") / block).cast("int").alias("nq")))
    numbered = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    items = placed.select("kind", "cell", "node", "copies", "embedding").join(blocks, ["kind", "cell"])
    items = items.select("kind", "cell", F.pmod(F.xxhash64("node"), F.col("ni")).cast("int").alias("bi"), F.explode(numbered("nq")).alias("bq"), F.lit(True).alias("item"), "node", "copies", "embedding")
    queries = queries.join(blocks, ["kind", "cell"])
    queries = queries.select("kind", "cell", F.explode(numbered("ni")).alias("bi"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("nq")).cast("int").alias("bq"), F.lit(False).alias("item"), "node", "copies", "embedding")

    def meet(group: pa.Table) -> pa.Table:
        q = shipped.value
        item = group.column("item").to_numpy()
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        vector = unit(group.column("embedding").to_pylist(), q.dim)
        ix, iy = np.flatnonzero(~item), np.flatnonzero(item)
        counts = np.zeros(len(ix), np.int64)
        edges: list[tuple[int, int]] = []
        if len(ix) and len(iy):
            i, j = _links(q, int(group.column("cell")[0].as_py()), vector[ix], vector[iy], radius, least)
            other = node[ix[i]] != node[iy[j]]
            i, j = i[other], j[other]
            counts = np.bincount(i, copies[iy[j]], minlength=len(ix)).astype(np.int64)
            edges = _forest(list(zip(node[ix[i]].tolist(), node[iy[j]].tolist(), strict=True)))
        some = counts > 0
        a = node[ix][some].tolist() + [x for x, _ in edges]
        b = [None] * int(some.sum()) + [y for _, y in edges]
        links = counts[some].tolist() + [0] * len(edges)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    met = materialise(items.unionByName(queries).groupBy("kind", "cell", "bi", "bq").applyInArrow(meet, "a long, b long, links long"))
    components = connected_components(met.filter("b is not null").select("a", "b"))
    counted = met.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    found = classes.join(counted, "node", "left").join(components, "node", "left")
    found = found.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    good = rows.filter("sound").join(found, key).select("vec_id", "n_links", "component_id")
    rest = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
