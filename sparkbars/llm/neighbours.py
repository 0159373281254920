"""Nearest neighbours by largest inner product: a block join of int8 tiles with error bounds, exact on what survives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tiles

TILE_BYTES = 2 << 20  # vectors of a block, as doubles
QUERY_STEP = 20       # rows whose vec_id is divisible by this are queries
NEAREST = 20
SLICE = 1024           # components; so many products of two int8 values stay below 2**24


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, ids, vectors): valid vectors of one dimension, as bytes of longs and doubles."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def packed(dim: int) -> pa.RecordBatch:
        ids, vectors = (np.concatenate(x) for x in zip(*waiting.pop(dim), strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], ["dim", "ids", "vectors"])

    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("embedding")), 0).to_numpy(zero_copy_only=False)
        usable = pc.is_valid(batch.column("vec_id")).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[usable & (sizes > 0)]).tolist():
            rows = np.flatnonzero(usable & (sizes == dim))
            vectors = batch.column("embedding").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)  # a null component reads as not a number
            ids = batch.column("vec_id").take(pa.array(rows[good])).to_numpy(zero_copy_only=False)
            vectors, most = vectors[good], max(1, TILE_BYTES // (8 * dim))
            for start in range(0, len(ids), most):
                waiting.setdefault(dim, []).append((ids[start:start + most], vectors[start:start + most]))
                if sum(len(x[0]) for x in waiting[dim]) >= most:
                    yield packed(dim)
    for dim in list(waiting):
        yield packed(dim)


class Quantised:
    """int8 values with a scale each, and the norms that bound the error of their products."""

    def __init__(self, vectors: np.ndarray):
        top = np.abs(vectors).max(axis=1)
        unit = vectors / top[:, None]  # also where values are so small or large that their squares are not finite
        whole = np.rint(unit * 127)
        self.values, self.top = whole.astype(np.int8), top
        self.error = np.sqrt(((unit - whole / 127) ** 2).sum(axis=1)) + 1e-12
        self.norm, self.whole_norm = np.sqrt((unit**2).sum(axis=1)), np.sqrt(((whole / 127) ** 2).sum(axis=1))


def tile(one: Quantised, two: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above the inner products of unit-scaled vectors. int8 products are exact in single precision over SLICE
    components, and so are the sums of slices in doubles."""
    product = np.zeros((len(one.values), len(two.values)))
    for start in range(0, one.values.shape[1], SLICE):
        part = slice(start, start + SLICE)
        product += one.values[:, part].astype(np.float32) @ two.values[:, part].astype(np.float32).T
    near = product / 127**2
    error = one.error[:, None] * two.whole_norm + one.norm[:, None] * two.error + 1e-9
    return near - error, near + error


def inner(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components."""
    total = np.zeros(len(vectors))
    for k in range(vectors.shape[1]):
        total += vectors[:, k] * query[k]
    return total


def _nearest(k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                dim = batch.column("dim")[row].as_py()
                ids = [np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in ("query_ids", "ids")]
                vectors = [np.frombuffer(batch.column(c)[row].as_buffer(), np.float64).reshape(-1, dim) for c in ("query_vectors", "vectors")]
                one, two = (Quantised(v) for v in vectors)
                low, high = tile(one, two)
                low, high = low * two.top, high * two.top  # the query's own scale does not change its order
                own = ids[0][:, None] == ids[1]
                low[own] = high[own] = -np.inf
                out = []
                unique = len(np.unique(ids[1])) == len(ids[1])
                count = len(ids[1])
                floor = np.partition(low, count - k, axis=1)[:, count - k] if unique and count > k else np.full(len(ids[0]), -np.inf)
                for q in range(len(ids[0])):
                    at = np.flatnonzero((high[q] >= floor[q]) & ~own[q])
                    score = inner(vectors[0][q], vectors[1][at])
                    order = np.lexsort((ids[1][at], -score))
                    if not unique:
                        order = order[np.sort(np.unique(ids[1][at][order], return_index=True)[1])]
                    order = order[:k]
                    out.append((np.full(len(order), ids[0][q]), ids[1][at][order], score[order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])
    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, groups: int | None = None) -> DataFrame:
    """vectors and queries (vec_id, embedding, ...) -> (query_id, rank, vec_id, score): each query's k largest inner products.

    Every block of queries meets every block of vectors of the same dimension once, in a join on `groups` keys. A tile's k-th
    best lower bound rejects what cannot be among its best; the rest is computed in doubles, and the tiles' lists are merged.
    So the result is exact. Ties go to the smaller vec_id; rows of the query's own vec_id are no candidates; a vec_id that
    repeats counts once, with its best score. Vectors null, empty, zero or with null or non-finite components and rows without
    vec_id take no part, nor do vectors of other dimensions than the query's. Other columns are ignored.
    """
    spark = vectors.sparkSession
    groups = groups or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = [f.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(
        _blocks, "dim int, ids binary, vectors binary") for f in (queries, vectors)]
    found = tiles(*packed, groups).mapInArrow(_nearest(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_of_every(vectors: DataFrame, step: int = QUERY_STEP, k: int = NEAREST) -> DataFrame:
    """The k nearest of each vector whose vec_id is divisible by `step`, among all others."""
    return nearest(vectors, vectors.where(F.col("vec_id") % step == 0), k)
