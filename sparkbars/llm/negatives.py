"""Hard negatives by the threshold algorithm: sorted lists per dimension, read from the anchor's side, until no unseen row can matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tiles

BLOCK_BYTES = 4 << 20  # vectors of a block, as doubles, at most
SCALE = 256            # a component x counts as floor(SCALE * x)
ANCHOR_STEP = 50       # rows whose vec_id is divisible by this are anchors
SHIFT_STEP = 7         # rows whose vec_id is divisible by this get the next label, of so many:
LABELS = 10
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95     # a negative's score, in percent of the positive's
FIRST_DEPTH = 8        # rows of each list in the first round; every round reads twice as deep as the one before
EXACT = 2.0**53        # doubles hold every whole number below
EXACT_SINGLE = 2.0**24  # and floats
ANCHORS = 256          # anchors searched together
BLOCKS = 4             # of rows for each group of tiles, while they have
LEAST_ROWS = 512
LONG = 2**63 - 1


def relabelled(vectors: DataFrame, step: int = SHIFT_STEP, labels: int = LABELS) -> DataFrame:
    moved = (F.col("vec_id") % step == 0) & F.col("vec_id").isNotNull()
    return vectors.withColumn("label", F.when(moved, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label").cast("long")))


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, one a vec_id."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    least = F.min(F.struct("label", "embedding")).alias("least")
    return rows.groupBy("vec_id").agg(least).select("vec_id", "least.label", "least.embedding")


def _packed(scale: int, windows: int, rows: int) -> Callable:
    """Blocks of rows of one dimension: ids, labels and whole-numbered vectors as bytes, with the score windows of anchors if they have any."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                every, most = np.flatnonzero(sizes == dim), max(1, min(rows, BLOCK_BYTES // (8 * max(dim, 1))))
                for start in range(0, len(every), most):
                    own = batch.take(pa.array(every[start:start + most]))
                    with np.errstate(over="ignore"):
                        whole = np.nan_to_num(np.floor(scale * own.column("embedding").flatten().to_numpy(zero_copy_only=False)))
                    parts = [own.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("vec_id", "label")] + [whole.tobytes()]
                    if windows:
                        given = np.full((len(own), windows, 2), -1, np.int64)
                        count = pc.list_value_length(own.column("positives")).to_numpy(zero_copy_only=False)
                        flat = own.column("positives").flatten()
                        at = np.repeat(np.arange(len(own)), count), np.concatenate([np.arange(n) for n in count] or [np.empty(0, np.int64)]).astype(np.int64)
                        for k, name in enumerate(("score", "place")):
                            given[(*at, k)] = flat.field(name).to_numpy(zero_copy_only=False)
                        parts.append(given.tobytes())
                    names = ["ids", "labels", "vectors", "windows"][:len(parts)]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32())] + [pa.array([p], pa.binary()) for p in parts], ["dim", *names])
    return pack


class Lists:
    """Rows of a block by rising id with, for every dimension, their order by falling component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.order = np.argsort(-self.vectors, axis=0, kind="stable").astype(np.int32)
        self.most = float(np.abs(vectors).max(initial=0.0))

    def products(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whole inner products: in floats where they are exact, else in Python's numbers, cut at the limits of a long."""
        bound = anchors.shape[1] * self.most * float(np.abs(anchors).max(initial=0.0))
        if bound < EXACT:
            kind = np.float32 if bound < EXACT_SINGLE else np.float64
            return (anchors.astype(kind) @ rows.astype(kind).T).astype(np.int64)
        if not anchors.shape[1]:
            return np.zeros((len(anchors), len(rows)), np.int64)
        whole = [np.array([[int(x) for x in v] for v in part.tolist()], object).reshape(part.shape) for part in (anchors, rows)]
        return np.clip(whole[0] @ whole[1].T, -LONG, LONG).astype(np.int64)

    def search(self, anchors: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(anchor, window, id, score) of the first k allowed rows, ties by smaller id, in each anchor's windows low..high of scores.

        Sorted access reads each dimension's list from the sides that the anchors' signs favour, in rounds that read twice as deep
        each time; rows not seen before are scored by random access, for all anchors still open. A row unseen so far scores no more
        than an anchor's threshold, the sum of what its lists show, from its sides, at the depth read. An anchor is done once the
        threshold is strictly below the k-th score of each of its windows, or below the window while that has fewer rows.
        """
        n, (m, windows) = len(self.ids), low.shape
        seen, depth, step = np.zeros(n, bool), 0, FIRST_DEPTH
        best = [np.empty(0, np.int64)] * 4
        kth = np.maximum(low, -LONG)  # of windows with fewer than k rows: their lower end
        live = np.flatnonzero((low <= high).any(axis=1))
        while len(live) and depth < n:
            last, depth, step = depth, min(n, depth + step), step * 2
            signs = anchors[live]
            up, down = (signs > 0).any(axis=0), (signs < 0).any(axis=0)
            fresh = np.zeros(n, bool)
            fresh[self.order[last:depth, up].ravel()] = True
            fresh[self.order[n - depth:n - last, down].ravel()] = True
            if depth == n:
                fresh[:] = True
            fresh = np.flatnonzero(fresh & ~seen)
            seen[fresh] = True
            score = self.products(signs, self.vectors[fresh])
            for w in range(windows):
                hit = allowed[np.ix_(live, fresh)] & (score >= kth[live, w, None]) & (score <= high[live, w, None])
                a, r = np.nonzero(hit)
                if len(a) > 4 * k * len(live) and len(fresh) > k:
                    floor = np.partition(np.where(hit, score, -LONG - 1), len(fresh) - k, axis=1)[:, len(fresh) - k]
                    a, r = np.nonzero(hit & (score >= floor[:, None]))
                more = [live[a], np.full(len(a), w), self.ids[fresh[r]], score[a, r]]
                best = [np.concatenate(x) for x in zip(best, more, strict=True)]
            best, full = _first(best, k)
            kth[best[0][full], best[1][full]] = best[3][full]
            top, bottom = (self.vectors[self.order[at], np.arange(anchors.shape[1])][None] for at in (depth - 1, n - depth))
            threshold = self.products(np.maximum(signs, 0), top)[:, 0] + self.products(np.minimum(signs, 0), bottom)[:, 0]
            live = live[((threshold[:, None] >= kth[live]) & (low[live] <= high[live])).any(axis=1)]
        return tuple(best)


def _first(found: list[np.ndarray], k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The first k of each (anchor, window), and the places of the k-th ones."""
    anchor, window, ids, score = found
    order = np.lexsort((ids, -score, window, anchor))
    found = [x[order] for x in found]
    new = np.ones(len(order), bool)
    new[1:] = (found[0][1:] != found[0][:-1]) | (found[1][1:] != found[1][:-1])
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    found = [x[place < k] for x in found]
    return found, np.flatnonzero(place[place < k] == k - 1)


def bounds(score: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest whole number x with low * score <= 100 * x <= high * score, without leaving longs."""
    whole, rest = np.divmod(score, 100)
    return low * whole - (-low * rest // 100), high * whole + high * rest // 100


def _search(same: bool, k: int, windows: int, low: int, high: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                dim = batch.column("dim")[row].as_py()

                def part(name: str, kind: type = np.int64, batch: pa.RecordBatch = batch, row: int = row) -> np.ndarray:
                    return np.frombuffer(batch.column(name)[row].as_buffer(), kind)

                ids = part("ids")
                lists = Lists(ids, part("labels"), part("vectors", np.float64).reshape(len(ids), dim))
                anchors, labels = part("query_ids"), part("query_labels")
                vectors = part("query_vectors", np.float64).reshape(len(anchors), dim)
                given = part("query_windows").reshape(len(anchors), windows, 2) if windows else None
                for start in range(0, len(anchors), ANCHORS):
                    own = slice(start, start + ANCHORS)
                    alike = labels[own, None] == lists.labels
                    allowed = alike & (anchors[own, None] != lists.ids) if same else ~alike
                    if windows:
                        score, place = given[own, :, 0], given[own, :, 1]
                        least, most = bounds(score, low, high)
                        least = np.where(place > 0, least, 1)
                        most = np.where(place > 0, most, 0)
                    else:
                        place = np.zeros((len(alike), 1), np.int64)
                        least, most = place - LONG, place + LONG
                    a, w, found, score = lists.search(vectors[own], allowed, least, most, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors[own][a], place[a, w], found, score)], ["anchor_id", "place", "vec_id", "score"])
    return search


def hard_negatives(vectors: DataFrame, anchors: DataFrame | None = None, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, groups: int | None = None) -> DataFrame:
    """vectors(vec_id, label, embedding, ...) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as floor(scale * x), scores are whole inner products. An anchor's positives are its first `positives` other
    rows of the same label; for each, the first `negatives` rows of other labels whose score is `low` to `high` percent of the
    positive's are returned. Higher scores come first, ties by smaller vec_id; `anchors` (default: the rows with a vec_id
    divisible by ANCHOR_STEP) names the anchors by vec_id. Anchors without a positive, and positives without a negative in the
    window (all of negative score), have no row.

    Rows with a null vec_id, label or vector or with null or non-finite components take no part, nor do vectors of other
    dimensions than the anchor's. Of rows that repeat a vec_id, the one with the smallest label, then vector, counts. Empty
    vectors have the score 0. Scores beyond a long are given as its limits. Other columns are ignored.

    Two passes of the same join: blocks of anchors meet blocks of rows, and in each tile the threshold algorithm runs for every
    anchor, first for the positives, then for the windows that they set. A tile returns at most k rows a window. The blocks
    and the positives are written to the shared folder between the passes.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    groups = groups or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = scratch.save(_usable(vectors))
    named = rows.where(F.col("vec_id") % ANCHOR_STEP == 0) if anchors is None else rows.join(anchors.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi")
    block = "dim int, ids binary, labels binary, vectors binary"
    most = max(LEAST_ROWS, rows.count() // (BLOCKS * groups))
    blocks = scratch.save(rows.mapInArrow(_packed(scale, 0, most), block))
    kind = "anchor_id long, place long, vec_id long, score long"
    order = [F.desc("score"), F.asc("vec_id")]

    tile = tiles(named.mapInArrow(_packed(scale, 0, most), block), blocks, groups)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(*order)).cast("long")
    best = tile.mapInArrow(_search(True, positives, 0, low, high), kind).withColumn("place", place).where(F.col("place") <= positives)
    best = scratch.save(best)

    listed = best.groupBy("anchor_id").agg(F.collect_list(F.struct("score", "place")).alias("positives"))  # at most `positives` entries
    given = named.join(listed, named["vec_id"] == listed["anchor_id"]).select("vec_id", "label", "embedding", "positives")
    tile = tiles(given.mapInArrow(_packed(scale, positives, most), f"{block}, windows binary"), blocks, groups)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(*order))
    found = tile.mapInArrow(_search(False, negatives, positives, low, high), kind).withColumn("rank", rank).where(F.col("rank") <= negatives)
    found = found.select("anchor_id", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = best.select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(known, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
