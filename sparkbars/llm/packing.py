"""Best-fit-decreasing packing of token sequences, planned on the counts of lengths."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, lists

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
OTHER_SIGNS = re.compile("[^\u0000-\u024f]")


class Encoder:
    """Token ids of texts, as bytes of little-endian unsigned 32-bit numbers.

    The ids are those of the tokenizers file. Texts of Latin signs take a faster way with the same merges, if there is one;
    texts with other signs, where the libraries might part words differently, or with special tokens do not.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._ranks()

    def _ranks(self) -> tiktoken.Encoding | None:
        """The same byte-pair merges in a faster library. It takes a merge's rank for its id, so it is used only for vocabularies
        whose ids follow the order of their merges, as those of byte-level GPT files do."""
        whole = json.loads(self.tokenizer.to_str())
        vocabulary, merges = whole["model"].get("vocab"), whole["model"].get("merges")
        if whole["model"]["type"] != "BPE" or whole["normalizer"] or whole["pre_tokenizer"]["type"] != "ByteLevel" or whole["pre_tokenizer"]["add_prefix_space"]:
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
        if merged != sorted(merged) or len(set(vocabulary.values())) != 256 + len(merges):
            return None
        ranks = {bytes(byte[c] for c in token): k for token, k in vocabulary.items()}
        return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast and not OTHER_SIGNS.search(text) and not any(s in text for s in self.special):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each worker, kept from task to task."""
    return Encoder(path)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of that many ids: one, or a shorter first piece and then full ones."""
    first = length % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, length, capacity)]


def _pieces(path: str, capacity: int, keep_ids: bool) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        for block in blocks(batches):
            rows, piece, start, length, crc, place, kept = [], [], [], [], [], [], []
            for row, text in enumerate(block.column("text").to_pylist()):
                ids = encoder(path).encode(text or "") + end
                for k, (s, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * s:4 * (s + n)]
                    rows.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    place.append(int(seen[n]))
                    seen[n] += 1
                    if keep_ids:
                        kept.append(own)
            columns = [block.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                       *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(rows), pa.int64()), pa.array(place, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
            if keep_ids:
                columns.append(lists(np.frombuffer(b"".join(kept), "<i4"), np.concatenate([[0], np.cumsum(length)]), pa.int32()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    return encode


class OpenBins:
    """Ranges of open bins by remaining room, under a segment tree that finds the tightest sufficient room in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.filled[node] += by
            node //= 2

    def add(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.ranges[room].append((first, count))
            self._change(room, 1)

    def take(self, length: int) -> tuple[int, int, int] | None:
        """Remove and return (room, first bin, bins) of a range with the least room of at least `length`."""
        node = length + self.size
        while not self.filled[node]:
            while node & 1:
                node //= 2
            if not node:
                return None
            node += 1
        while node < self.size:
            node = 2 * node + (not self.filled[2 * node])
        room = node - self.size
        self._change(room, -1)
        return (room, *self.ranges[room].pop())


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, offset, pieces a bin): where the pieces of each length go, by rank.

    Best-fit decreasing on counts: longest first, each into the tightest open bin. Pieces of one length fill a bin as far as
    they go before the next one is touched, as they do one by one, so a range of equal bins takes them in one step.
    """
    bins, opened, rows = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            found = bins.take(length)
            room, first, count = found or (capacity, opened, -(-left // (capacity // length)))
            if not found:
                opened += count
            each = room // length
            used = min(count, -(-left // each))
            placed = min(left, used * each)
            rows.append((length, rank, first, capacity - room, each))
            full, over = divmod(placed, each)
            bins.add(room - each * length, first, full)
            bins.add(room - over * length, first + full, used - full)
            bins.add(room, first + used, count - used)
            rank, left = rank + placed, left - placed
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(plan: np.ndarray) -> Callable:
    keys = (plan[:, 0] << 48) | plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, (length << 48) | rank, "right") - 1]
            ahead = rank - row[:, 1]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(row[:, 2] + ahead // row[:, 4]), pa.array(row[:, 3] + ahead % row[:, 4] * length)],
                [*names, "sequence_id", "offset"])
    return place


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one row per piece.

    A document is the ids of its text and END_ID; only those longer than `capacity` are cut. Null and empty texts are END_ID
    alone. Rows that repeat a doc_id, or have none, are packed one by one. Other columns are ignored.

    The pieces are written once. A piece's rank among those of its length is the count of that length in the parts before its
    own plus its place there. To the driver come the counts of at most `capacity` lengths.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ids = ", ids array<int>" if keep_ids else ""
    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long, part long, place long{ids}"
    pieces = scratch.save(docs.mapInArrow(_pieces(path or public_tokenizers.path(VOCABULARY), capacity, keep_ids), schema))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")), ["length", "part"])
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long"
    return ranked.select(*columns, (F.col("before") + F.col("place")).alias("rank")).mapInArrow(_placed(best_fit(total, capacity)), schema)
