"""Substring dedup: content-defined chunks, cut by a gear rolling hash and deduplicated by digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, utf8
from .words import BYTE_VALUES, mix, prefix_hash

MEAN = 20       # bytes between cuts on average
LONGEST = 1024  # bytes after which a chunk is cut anyhow
SHORTEST = 100  # bytes of consecutive repeated chunks that are worth removing

GEAR = np.random.default_rng(3).integers(0, 2**32, 256, np.uint32)
REACH = 16      # bytes that a hash depends on


def gear_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the hash (h << 1) + GEAR of it and the bytes before it, started anew in each text.

    The hash is a sum over REACH bytes, built by doubling.
    """
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data)) + REACH * (owner + 1)
    h = np.zeros(len(data) + REACH * len(offsets), np.uint32)
    h[at] = GEAR[data]
    for shift in (1, 2, 4, 8):
        h[shift:] += h[:-shift] << np.uint32(shift)
    return h[at]


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the chunks of all texts."""
    cut = np.flatnonzero(gear_hashes(data, offsets) < np.uint32(2**32 // MEAN)) + 1
    starts = np.unique(np.concatenate([cut, offsets[:-1]]))
    starts = starts[starts < len(data)]
    size = np.diff(np.append(starts, len(data)))
    if len(size) and size.max() > LONGEST:
        pieces = -(-size // LONGEST)
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + LONGEST * (np.arange(pieces.sum()) - first)
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums, down = prefix_hash(BYTE_VALUES[data])
    raw = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return mix(raw).view(np.int64), (mix(raw ^ BYTE_VALUES[7]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        data, offsets = utf8(block.column("text"))
        starts, ends, owner = chunk_bounds(data, offsets)
        digest, check = digests(data, starts, ends)
        number = np.arange(len(starts)) - np.searchsorted(owner, owner)
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id").take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(digest), pa.array(check)],
            ["doc_id", "number", "digest", "check"])


def _runs(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of the runs of flagged chunks that are long enough."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    runs = [(int(starts[a]), int(ends[b - 1])) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return [r for r in runs if r[1] - r[0] >= SHORTEST]


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "marks")), strict=True):
            raw = (text or "").encode()
            data = np.frombuffer(raw, np.uint8)
            starts, ends, _ = chunk_bounds(data, np.array([0, len(data)]))
            digest, _ = digests(data, starts, ends)
            shared, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
            met = set()  # digests of chunks that stay here, at their first place
            for m in sorted(marks, key=lambda m: m["number"]):
                stays = m["first"] and m["digest"] not in met
                if stays:
                    met.add(m["digest"])
                if m["number"] < len(starts) and digest[m["number"]] == m["digest"]:
                    shared[m["number"]] = True
                    later[m["number"]] = not stays
            if not _runs(shared, starts, ends):
                continue
            gone, kept, at = _runs(later, starts, ends), [], 0
            for a, b in gone:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            out.append((doc_id, len(raw), len(starts), int(shared.sum()), len(raw) - len(kept), len(gone), kept,
                        hashlib.sha256(kept).hexdigest()))
        names = ["doc_id", "n_bytes", "n_chunks", "n_shared", "n_removed", "n_spans", "kept", "kept_sha256"]
        kinds = [pa.int64()] * 6 + [pa.binary(), pa.string()]
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def shared_passages(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, n_chunks, n_shared, n_removed, n_spans, kept, kept_sha256), one row for each
    document that shares a passage: consecutive chunks of at least 100 bytes that occur elsewhere, in it or in another.

    The first occurrence of a chunk (smallest doc_id, then place) stays, the later ones go where they make up 100 bytes or more
    in a row; `kept` are the remaining bytes. Cuts depend on the 16 bytes before them only, so an insertion moves no cut beyond
    its own chunk. Null and empty texts have no chunk; rows without doc_id are left out. Rows that repeat a doc_id stand for one
    document; where their texts differ, marks only apply to chunks of the same digest. Other columns are ignored.

    Counts and least ids are combined before the shuffle, in hash aggregates; the first place within the least id is found where
    that document is cleaned. Chunks meet the repeated digests in a merge join, whose hot keys can be split.
    """
    scratch = Scratch(docs.sparkSession, "chunks")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    chunks = docs.where("text is not null").mapInArrow(_rows, "doc_id long, number int, digest long, check int")
    first = F.min("doc_id").alias("first")
    repeated = scratch.save(chunks.groupBy("digest", "check").agg(F.count("*").alias("n"), first).where("n > 1").drop("n"))
    met = chunks.join(repeated.hint("merge"), ["digest", "check"])
    is_first = (F.col("doc_id") == F.col("first")).alias("first")
    marks = scratch.save(met.groupBy("doc_id").agg(F.collect_set(F.struct("number", "digest", is_first)).alias("marks")))
    return docs.join(marks.hint("merge"), "doc_id").mapInArrow(
        _cleaned, "doc_id long, n_bytes long, n_chunks long, n_shared long, n_removed long, n_spans long, kept binary, kept_sha256 string")
