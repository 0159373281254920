"""Suffix-array dedup: repeated 400-byte strings, found by externally induced sorting of the suffixes of content-dealt shards."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, utf8
from .words import BYTE_VALUES, mix, prefix_hash

WIDTH = 400               # bytes of a string that must not repeat
KMER = 32                 # bytes whose least hash within a string is the key that brings equal strings together
SHARD_BYTES = 2 << 20     # text that is sorted at once; a shard ends with its last key
HOT = SHARD_BYTES // WIDTH  # distinct slices of one key that are sorted together, about a shard; more are dealt out string by string
QUEUE_ENTRIES = 1 << 18   # suffix tuples that the queues of a sweep keep in memory before they go to disk
RANGE = 1 << 14           # suffixes of the symbols that a sweep takes at once; at least one symbol, and at least 1 in 64 of all suffixes
COMMON_BITS = 16          # of a tuple, for the common prefix
PLACE_BITS = np.uint64(31)


# ---- sorting -------------------------------------------------------------------------------------------------------------

class Queues:
    """Queues of suffix tuples by range of symbols: the ranges are taken in order, so together they are a priority queue. A tuple
    is a place and the common prefix with the tuple before it, packed in one number. Beyond the memory budget, tuples wait in one
    temporary file beside Spark's own spill files, which is gone when the sweep ends and which nothing but its task reads."""

    def __init__(self, ranges: int, budget: int = QUEUE_ENTRIES):
        self.parts: list[list] = [[] for _ in range(ranges)]
        self.held, self.budget, self.file, self.end = 0, budget, None, 0

    def add(self, places: np.ndarray, common: np.ndarray, ranges: np.ndarray) -> None:
        """Add tuples, in order of their ranges, to the queues of these."""
        if not len(places):
            return
        edges = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [len(ranges)]]).tolist()
        tuples = (places << COMMON_BITS) | common
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            part = tuples[start:end]
            if self.held + len(part) > self.budget:
                self.file = self.file or tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
                self.file.seek(self.end)
                self.file.write(part.tobytes())
                self.parts[ranges[start]].append((self.end, len(part)))
                self.end += part.nbytes
            else:
                self.held += len(part)
                self.parts[ranges[start]].append(part)

    def take(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        parts, out = self.parts[number], [np.empty(0, np.int64)]
        self.parts[number] = []
        for part in parts:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                out.append(np.frombuffer(self.file.read(8 * part[1]), np.int64))
            else:
                self.held -= len(part)
                out.append(part)
        tuples = np.concatenate(out)
        return tuples >> COMMON_BITS, tuples & (2**COMMON_BITS - 1)

    def close(self) -> None:
        if self.file:
            self.file.close()


class RangeMin:
    """Least values of ranges (from, to], both positions of one array of common prefixes, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.table = np.empty((max(1, int(len(values)).bit_length()), len(values)), np.uint16)
        self.table[0] = values
        for level in range(1, len(self.table)):
            half, fits = 2 ** (level - 1), len(values) - 2**level + 1
            np.minimum(self.table[level - 1, :fits], self.table[level - 1, half:half + fits], out=self.table[level, :fits])

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, low + 1], self.table[level, high + 1 - (1 << level)]).astype(np.int64)


def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of values; by digits where they lie close together."""
    if len(values):
        values = values - values.min()
        values = values.astype(np.uint16) if values.max() < 2**16 else values
    return np.argsort(values, kind="stable")


OUTSIDE, INSIDE, SEED = 0, 1, 2  # how a suffix came into its range: by the queue, induced within the range, given


def _chained(parent: np.ndarray, kind: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of one range: by key, then those that came by the queue, those induced in the range in the order
    of what induced them, and the seeds. Chains of inducing are compared by doubling the steps looked at."""
    count = len(key)
    group = key.astype(np.int64) * 3 + kind
    order = _order(group)
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    tied = order[kind[order] == INSIDE]
    if not len(tied):
        return rank

    def ranked() -> np.ndarray:
        """Give each of the tied, which are in order, the rank of the first that is equal; the tied among them are left."""
        new = np.append(True, np.any([np.diff(x) != 0 for x in marks], axis=0))
        first = np.flatnonzero(new)
        rank[tied] = place[first[np.cumsum(new) - 1]]
        alone = new & np.append(new[1:], True)
        return ~alone

    place, marks = rank[tied], [group[tied]]
    left = ranked()
    jump = parent
    while left.any():
        tied, place = tied[left], place[left]
        above = np.where(jump[tied] >= 0, rank[jump[tied]], -1)
        by = np.lexsort((above, rank[tied]))
        tied, marks = tied[by], [rank[tied[by]], above[by]]
        left = ranked()
        jump = np.where(jump >= 0, jump[jump], -1)
    return rank


def sweep(keys: np.ndarray, wanted: np.ndarray, runs: np.ndarray, seeds: np.ndarray, common: np.ndarray, reach: int,
          budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the wanted type, induced from seeds in order of keys, and the seeds: places in order, and each one's common
    prefix with the one before it. Ranges of symbols are taken in order; what they induce waits in the queues of later ranges."""
    total = np.cumsum(np.bincount(keys))
    size = max(RANGE, len(keys) >> 6)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(total // size)) + 1, [len(total)]])
    range_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    cuts = np.searchsorted(keys[seeds], edges)
    target = np.full(len(keys), -1, np.int32)  # key of the suffix that each one induces
    target[1:] = np.where(wanted[:-1], keys[:-1], -1)
    queues, out_places, out_common = Queues(len(edges) - 1, budget), [], []
    for number in range(len(edges) - 1):
        stop = edges[number + 1]
        queued, carried = queues.take(number)
        by = _order(keys[queued])
        queued, carried = queued[by], carried[by]
        given, given_common = seeds[cuts[number]:cuts[number + 1]], common[cuts[number]:cuts[number + 1]]
        now, first = np.concatenate([queued, given]), 0
        places, parents, targets = [now], [np.full(len(now), -1)], []
        while len(now):
            targets.append(target[now])
            at = np.flatnonzero((targets[-1] >= 0) & (targets[-1] < stop))
            places.append(now[at] - 1)
            parents.append(first + at)
            first, now = first + len(now), places[-1]
        place, parent = np.concatenate(places), np.concatenate(parents)
        if not len(place):
            continue
        kind = np.repeat([OUTSIDE, SEED, INSIDE], [len(queued), len(given), len(place) - len(queued) - len(given)])
        key = keys[place]
        rank = _chained(parent, kind, key)
        order = np.empty(len(place), np.int64)
        order[rank] = np.arange(len(place))
        known = np.zeros(len(place), np.int64)  # of what came by the queue and of the seeds, in their own orders
        known[:len(queued)], known[len(queued):len(queued) + len(given)] = carried, given_common
        if len(queued):
            known[:len(queued)][np.concatenate([[True], np.diff(key[:len(queued)]) != 0])] = 0

        a, b = order[:-1].copy(), order[1:].copy()
        steps = np.zeros(len(a), np.int64)
        active = np.flatnonzero((kind[a] == INSIDE) & (kind[b] == INSIDE) & (key[a] == key[b]))
        while len(active):
            a[active], b[active] = parent[a[active]], parent[b[active]]
            steps[active] += 1
            active = active[(kind[a[active]] == INSIDE) & (kind[b[active]] == INSIDE) & (key[a[active]] == key[b[active]]) & (steps[active] < reach)]
        before, after = kind[a], kind[b]
        found = np.where(before == after, known[b], 1)  # right for neighbours, and where only the second was induced in the range
        meet = np.flatnonzero((after == SEED) & (before != SEED))
        found[meet] = np.minimum(runs[place[a[meet]]], runs[place[b[meet]]])
        both = np.flatnonzero((before == after) & (after != INSIDE) & (steps > 0))
        if len(both):
            found[both] = RangeMin(known)(a[both], b[both])
        found[key[a] != key[b]] = 0
        mine = np.concatenate([[0], np.minimum(steps + found, reach)])
        place, goes = place[order], np.concatenate(targets)[order]
        out_places.append(place)
        out_common.append(mine.astype(np.uint16))

        at = np.flatnonzero(goes >= stop)
        at = at[_order(goes[at])]
        goes = goes[at]
        passed = np.ones(len(at), np.int64)
        again = np.flatnonzero(np.diff(goes) == 0) + 1
        if len(again):
            passed[again] = np.minimum(1 + RangeMin(mine)(at[again - 1], at[again]), reach)
        queues.add(place[at] - 1, passed, range_of[goes])
    queues.close()
    return np.concatenate(out_places), np.concatenate(out_common)


def induced(text: np.ndarray, rising: np.ndarray, runs: np.ndarray, stars: np.ndarray, common: np.ndarray, reach: int,
            budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order and their common prefixes, induced from the S*-suffixes in order: falling ones upwards, then rising
    ones downwards."""
    up, up_common = sweep(text, ~rising, runs, stars, common, reach, budget)
    falls = ~rising[up]
    falling, fall_common = up[falls], up_common[falls]
    del up, up_common
    down, down_common = sweep(text.max() - text, rising, runs, falling[::-1], np.concatenate([[0], fall_common[:0:-1]]), reach, budget)
    last = len(text) - 1  # the end comes before all others
    down_common = np.append(down_common, text[down[-1]] == text[last])
    return np.append(last, down[::-1]), np.append(0, down_common[:0:-1])


def named(text: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    """Names, in order, of the S*-substrings from places, each up to the next place. They are sorted by words of as many symbols
    as fit in 63 bits; those that are equal so far go on with the next word. A substring comes after those it begins."""
    length = np.append(np.diff(places) + 1, 1)
    bits = (int(text.max()) + 2).bit_length()
    per, last = 63 // bits, len(text) - 1
    symbols = text.astype(np.int64) + 1
    symbols[last] = 0  # the end is the least

    def words(of: np.ndarray, offset: int) -> np.ndarray:
        out, place, size = np.zeros(len(of), np.int64), places[of], length[of]
        for k in range(offset, offset + per):
            out = (out << bits) | np.where(k < size, symbols[np.minimum(place + k, last)], 2**bits - 1)
        return out

    rank, tied, offset = np.zeros(len(places), np.int64), np.arange(len(places)), 0
    while len(tied) and offset < reach:
        word = words(tied, offset)
        by = np.lexsort((word, rank[tied])) if offset else np.argsort(word, kind="stable")
        tied, word = tied[by], word[by]
        before, turn = rank[tied], np.arange(len(tied))
        group = np.append(True, np.diff(before) != 0)
        new = group | np.append(True, np.diff(word) != 0)
        rank[tied] = before + np.maximum.accumulate(np.where(new, turn, 0)) - np.maximum.accumulate(np.where(group, turn, 0))
        offset += per
        tied = tied[~(new & np.append(new[1:], True)) & (length[tied] >= offset)]
    return np.unique(rank, return_inverse=True)[1]


def suffix_order(text: np.ndarray, reach: int = WIDTH, budget: int = QUEUE_ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """Places of text ordered by their suffixes, and each one's common prefix with the one before it, exact for the first `reach` symbols.

    The last symbol of text is 0, the one before it not. S*-substrings are sorted and named. Where names repeat, the string of
    names is sorted by this same function. Its order and common prefixes give those of the S*-suffixes, from which all others
    are induced, common prefixes carried along.
    """
    n, text = len(text), text.astype(np.int32)
    if n < 2:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    change = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 1)
    change = np.append(np.minimum.accumulate(change[::-1])[::-1], n - 1)
    rising = np.ones(n, bool)
    rising[:-1] = text[change[:-1]] < text[change[:-1] + 1]
    runs = np.minimum(change - np.arange(n) + 1, reach).astype(np.int32)
    star = np.zeros(n, bool)
    star[1:] = rising[1:] & ~rising[:-1]
    star[n - 1] = True
    places = np.flatnonzero(star)
    names = named(text, places, reach)
    if names.max() == len(names) - 1:
        ranked, shared = np.argsort(names), np.zeros(len(names), np.int64)
    else:
        ranked, shared = suffix_order(names, reach, budget)

    a, b, ended = places[ranked[:-1]], places[ranked[1:]], np.append(text, -1)
    same = places[np.minimum(ranked[1:] + shared[1:], len(places) - 1)] - b
    active = np.flatnonzero(same < reach)
    while len(active):  # beyond the names in common, within one S*-substring and the run after it
        active = active[ended[a[active] + same[active]] == ended[b[active] + same[active]]]
        same[active] += 1
        active = active[same[active] < reach]
    return induced(text, rising, runs, places[ranked], np.append(0, np.minimum(same, reach)), reach, budget)


def repeated_starts(slices: list[bytes]) -> list[np.ndarray]:
    """For each slice, whether the WIDTH bytes from each of its starts also start elsewhere in these slices."""
    lengths = np.array([len(s) for s in slices])
    text = np.frombuffer(b"\0".join([*slices, b""]), np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(lengths + 1) - 1
    text[ends] = 0
    is_start = np.zeros(len(text) + 1, np.int32)
    np.add.at(is_start, ends - lengths, 1)
    np.add.at(is_start, ends - WIDTH + 1, -1)
    is_start = np.cumsum(is_start[:-1]) > 0
    order, common = suffix_order(text)
    starts = np.flatnonzero(is_start[order])
    common = np.minimum.reduceat(common[:starts[-1] + 1], np.append(0, starts[:-1] + 1))
    order = order[starts]
    same = common[1:] >= WIDTH
    again = np.zeros(len(text), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return [again[e - n:e - WIDTH + 1] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


# ---- dealing out ---------------------------------------------------------------------------------------------------------

def slices_of(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one text: first starts, numbers of starts, keys and digests of its slices.

    The key of a start is the least hash among the KMER-byte strings within the WIDTH bytes from it, leftmost of equals: it
    depends on those bytes alone. A slice is a run of starts whose keys lie at the same place.
    """
    starts = len(data) - WIDTH + 1
    if starts < 1:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    sums, down = prefix_hash(BYTE_VALUES[data])
    kmers = mix((sums[KMER:] - sums[:-KMER]) * down[:-KMER])
    window, n = WIDTH - KMER + 1, len(kmers)
    low = ((kmers >> PLACE_BITS) << PLACE_BITS) | np.arange(n, dtype=np.uint64)
    rows = -(-n // window)
    padded = np.full(rows * window, np.uint64(2**64 - 1))
    padded[:n] = low
    padded = padded.reshape(rows, window)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[:starts], ahead[window - 1:window - 1 + starts]) & np.uint64(2**31 - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    count = np.diff(np.append(first, starts))
    end = first + count + WIDTH - 1
    return first, count, kmers[place[first]], mix((sums[end] - sums[first]) * down[first] + count.astype(np.uint64))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        data, offsets = utf8(block.column("text"))
        found = [slices_of(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        owner = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        first, count, key, digest = (np.concatenate([f[k] for f in found]) for k in range(4))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), block.column("text_id").take(pa.array(owner)),
             pa.array(first), pa.array(count.astype(np.int32))], ["key", "digest", "text_id", "first", "count"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text_id, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("text_id", "text", "wanted")), strict=True):
            raw = text.encode()
            out += [(w["key"], w["hot"], text_id, w["first"], raw[w["first"]:w["first"] + w["count"] + WIDTH - 1]) for w in wanted]
        kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.binary()]
        columns = zip(*out, strict=True) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "hot", "text_id", "first", "slice"])


SPANS = "text_id binary, start long, stop long"


def _span_batch(text_ids: list[bytes], starts: list[int], stops: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(text_ids, pa.binary()), *(pa.array(x, pa.int64()) for x in (starts, stops))], ["text_id", "start", "stop"])


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices in order of their keys -> covered byte ranges. A shard ends where a key ends, once it is large enough."""
    waiting, size = [], 0

    def finished() -> pa.RecordBatch:
        out = ([], [], [])
        for (_, text_id, first, _), again in zip(waiting, repeated_starts([w[3] for w in waiting]), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))).tolist()
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                for column, value in zip(out, (text_id, first + a, first + b - 1 + WIDTH), strict=True):
                    column.append(value)
        return _span_batch(*out)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "text_id", "first", "slice")), strict=True):
            if size >= SHARD_BYTES and row[0] != waiting[-1][0]:
                yield finished()
                waiting, size = [], 0
            waiting.append(row)
            size += len(row[3])
    if waiting:
        yield finished()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each single WIDTH-byte string of hot slices by two digests."""
    for batch in batches:
        for text_id, first, raw in zip(*(batch.column(c).to_pylist() for c in ("text_id", "first", "slice")), strict=True):
            data = np.frombuffer(raw, np.uint8)
            sums, down = prefix_hash(BYTE_VALUES[data])
            string = (sums[WIDTH:] - sums[:-WIDTH]) * down[:-WIDTH]
            count = len(string)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(string).view(np.int64)), pa.array(mix(string ^ BYTE_VALUES[9]).view(np.int64)), pa.array([text_id] * count, pa.binary()),
                 pa.array(np.arange(first, first + count))], ["digest", "check", "text_id", "start"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            raw, kept, at, gone, runs = (text or "").encode(), [], 0, 0, 0
            for span in sorted((s["start"], s["stop"]) for s in spans or []):
                if span[0] > at or not runs:
                    kept.append(raw[at:span[0]])
                    runs += 1
                    at = span[0]
                gone += max(0, span[1] - at)
                at = max(at, span[1])
            kept.append(raw[at:])
            kept = b"".join(kept)
            out.append((doc_id, len(raw), gone, runs, kept, hashlib.sha256(kept).hexdigest()))
        columns = zip(*out, strict=True) if out else [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def repeated_strings(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256), one row per row of docs.

    Every byte covered by a 400-byte string that also starts elsewhere, in the same text or another, is removed; `kept` are the
    remaining bytes of the UTF-8 text. Null texts are empty; texts under 400 bytes lose nothing. Repeated rows are two
    documents, so from 400 bytes on they are removed in full. Rows without doc_id are treated alike. Other columns are ignored.

    Equal strings have equal keys, so a slice whose key occurs once is done. Equal slices become one by digest: all that occur
    twice is repeated. What is left, distinct slices of a shared key, is dealt out by key and sorted. A key of very many
    distinct slices (a passage in ever new surroundings) is split into its single strings, counted by digest, so no task holds
    a hot key. Texts are told apart by a hash of 128 bits, equal ones having equal results.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_id", F.unhex(F.md5(F.col("text").cast("binary"))))
    long_enough = docs.where(F.octet_length("text") >= WIDTH)
    slices = long_enough.select("text", "text_id").mapInArrow(_slices, "key long, digest long, text_id binary, first long, count int")
    slices = scratch.save(slices)
    one = F.min(F.struct("text_id", "first", "count")).alias("one")
    classes = scratch.save(slices.groupBy("key", "digest").agg(F.count("*").alias("n"), one))
    whole = slices.join(classes.where("n > 1").select("key", "digest").hint("merge"), ["key", "digest"], "left_semi")
    spans = whole.select("text_id", F.col("first").alias("start"), (F.col("first") + F.col("count") + WIDTH - 1).alias("stop"))

    keys = classes.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = classes.join(keys.hint("merge"), "key").select("key", (F.col("kinds") > HOT).alias("hot"), "one.*")
    wanted = mixed.groupBy("text_id").agg(F.collect_list(F.struct("key", "hot", "first", "count")).alias("wanted"))
    texts = long_enough.select("text_id", "text").join(wanted.hint("merge"), "text_id").dropDuplicates(["text_id"])
    cut = scratch.save(texts.select("text_id", "text", "wanted").mapInArrow(_cut, "key long, hot boolean, text_id binary, first long, slice binary"))
    sorted_spans = cut.where("not hot").select("key", "text_id", "first", "slice").repartition("key").sortWithinPartitions("key").mapInArrow(
        _sorted_shards, SPANS)
    strings = cut.where("hot").select("text_id", "first", "slice").mapInArrow(_strings, "digest long, check long, text_id binary, start long")
    again = strings.groupBy("digest", "check").agg(F.count("*").alias("n")).where("n > 1").select("digest", "check")
    hot_spans = strings.join(again.hint("merge"), ["digest", "check"], "left_semi").select("text_id", "start", (F.col("start") + WIDTH).alias("stop"))
    spans = scratch.save(spans.unionByName(sorted_spans).unionByName(hot_spans).groupBy("text_id").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")))
    scratch.drop(slices, classes, cut)
    return docs.join(spans.hint("merge"), "text_id", "left").select("doc_id", "text", "spans").mapInArrow(
        _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
