"""Near duplicates: banded MinHash candidates, checked by odd sketches, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, lists, utf8
from .graph import components
from .words import PLACES, mix, shingle_sets

WIDTH = 5            # words of a shingle
PERCENT = 75         # least Jaccard similarity of a link, in hundredths
BANDS, ROWS = 32, 4  # a pair at the least similarity shares no band with probability (1 - .75**4)**32 = 5e-6
SAMPLES = 1024       # MinHash samples in a sketch; the first BANDS * ROWS of them make the bands
SKETCH_WORDS = 32    # the odd sketch has 2048 bits: at the least similarity its estimate has a deviation of 0.02
SIGNED = 512         # texts signed at once
PAIRWISE = 64        # pairs a text up to which the rest of shared bands is compared pair by pair
ORDERED = 4096       # texts from which frequent shingles are learned, about,
FREQUENT = 1 << 16   # and so many shingles at most; both only set the order of shingles, any order gives the same links
SKETCH_SLACK = 0.09  # a candidate stays unless its estimate is this far below the least similarity, 4.5 deviations

_random = np.random.default_rng(8)
MULTIPLIERS = _random.integers(0, 2**32, SAMPLES, np.uint32) | np.uint32(1)
SHIFTS = _random.integers(0, 2**32, SAMPLES, np.uint32)
SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)]
SCHEMA = "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, 2**32 - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), 256):
        np.minimum(low, (short[start:start + 256, None] * MULTIPLIERS + SHIFTS).min(axis=0), out=low)
    return low


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Fold each row of samples into 256 bits: a bit is the parity of the samples that fall on it."""
    numbered = mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)))
    cells = (numbered % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
    rows = np.repeat(np.arange(len(samples)), SAMPLES)
    parity = np.bincount(rows * 64 * SKETCH_WORDS + cells.ravel(), minlength=len(samples) * 64 * SKETCH_WORDS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(samples), SKETCH_WORDS)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, rows=SIGNED):  # the samples of a text take four KB, however short it is
        data, offsets = utf8(block.column("text"))
        sizes = np.zeros(len(block), np.int64)
        digests = np.zeros((len(block), 2), np.uint64)
        samples = np.zeros((len(block), SAMPLES), np.uint32)
        for row, hashes in enumerate(shingle_sets(data, offsets, WIDTH)):
            sizes[row] = len(hashes)
            if len(hashes):
                digests[row] = hashes.sum(dtype=np.uint64), mix(hashes ^ PLACES[9]).sum(dtype=np.uint64)
                samples[row] = min_hashes(hashes)
        grouped = samples[:, :BANDS * ROWS].reshape(len(block), BANDS, ROWS).astype(np.uint64) * PLACES[:ROWS]
        bands = mix(grouped.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * PLACES[8])
        sketch = odd_sketches(samples)
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pa.array(sizes), *(pa.array(digests[:, k].view(np.int64)) for k in range(2)),
             lists(bands.ravel().view(np.int64), np.arange(len(block) + 1) * BANDS, pa.int64()),
             *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH_WORDS))],
            ["doc_id", "n_shingles", "digest_a", "digest_b", "bands", *SKETCH])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, rows=4 * SIGNED):
        data, offsets = utf8(block.column("text"))
        sets = [x.tobytes() for x in shingle_sets(data, offsets, WIDTH)]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "hashes"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = np.zeros(len(batch), bool)
        heads, members = batch.column("head_hashes"), batch.column("hashes")
        last, head = "", np.empty(0, np.uint64)
        for row in range(len(batch)):
            if batch.column("head")[row].as_py() != last:
                last, head = batch.column("head")[row].as_py(), np.frombuffer(heads[row].as_buffer(), np.uint64)
            member = np.frombuffer(members[row].as_buffer(), np.uint64)
            if len(head) and len(member):
                at = np.minimum(np.searchsorted(head, member), len(head) - 1)
                both = int(np.count_nonzero(head[at] == member))
                links[row] = 100 * both >= PERCENT * (len(head) + len(member) - both)
        yield pa.RecordBatch.from_arrays([batch.column("head"), batch.column("doc"), pa.array(links)], ["head", "doc", "linked"])


def _likely(one: str, two: str) -> Column:
    """Whether sizes and odd sketches leave it open that texts are similar enough; their columns have these prefixes."""
    unlike = sum(F.bit_count(F.col(f"{one}_{s}").bitwiseXOR(F.col(f"{two}_{s}"))) for s in SKETCH)
    bits = 64 * SKETCH_WORDS
    estimate = 1 + bits / (4 * SAMPLES) * F.log(F.greatest(F.lit(1e-9), 1 - 2 * unlike / bits))
    sizes = F.col(f"{one}_n_shingles"), F.col(f"{two}_n_shingles")
    return (100 * F.least(*sizes) >= PERCENT * F.greatest(*sizes)) & (estimate >= PERCENT / 100 - SKETCH_SLACK)


def _prefixed(frame: DataFrame, prefix: str) -> DataFrame:
    return frame.select(*(F.col(c).alias(f"{prefix}_{c}") for c in frame.columns))


def _links(docs: DataFrame, likely: DataFrame, scratch: Scratch) -> DataFrame:
    """Of likely pairs (head, doc), those whose full shingle sets are similar enough, as (a, b).

    Texts are shuffled by merge joins at every size, so that the cost follows the input.
    """
    likely = scratch.save(likely)
    if not likely.limit(1).count():
        none = likely.select(F.col("head").alias("a"), F.col("doc").alias("b"))
        none.scratch_path = likely.scratch_path
        return none
    wanted = likely.select(F.col("head").alias("doc_id")).distinct().union(likely.select("doc").distinct()).distinct()
    sets = docs.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_full_sets, "doc_id long, hashes binary")
    full = likely.join(sets.withColumnRenamed("doc_id", "doc").hint("merge"), "doc").join(
        sets.select(F.col("doc_id").alias("head"), F.col("hashes").alias("head_hashes")).hint("merge"), "head")
    links = full.select("head", "doc", "head_hashes", "hashes").mapInArrow(_confirmed, "head long, doc long, linked boolean")
    links = scratch.save(links.where("linked").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct())
    scratch.drop(likely)
    return links


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        sets = list(shingle_sets(*utf8(block.column("text")), WIDTH))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])


def _prefixes(late: np.ndarray, place: np.ndarray) -> Callable:
    """The first shingles of each text, frequent ones last: texts that are similar enough share one of them."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, rows=4 * SIGNED):
            sets, sizes = [], []
            for hashes in shingle_sets(*utf8(block.column("text")), WIDTH):
                if len(late) and len(hashes):
                    at = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
                    hashes = hashes[np.argsort(np.where(late[at] == hashes, place[at], -1), kind="stable")]
                sizes.append(len(hashes) - -(-PERCENT * len(hashes) // 100) + 1 if len(hashes) else 0)
                sets.append(hashes[:sizes[-1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), lists(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]), pa.int64())],
                                             ["doc_id", "shingles"])
    return cut


def _by_prefixes(docs: DataFrame, placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(one_doc_id, two_doc_id) of texts in different components that may be similar enough, by a join on their rarest shingles.

    A pair at PERCENT hundredths shares one of the first |x| - ceil(PERCENT * |x| / 100) + 1 shingles of both, in any order of all
    shingles. Shingles that many texts share come last, so that texts with a common frame, but contents of their own, do not meet.
    """
    members = scratch.save(placed.select("doc_id", "component", "n_shingles").distinct())
    own = docs.join(members.select("doc_id"), "doc_id", "left_semi")
    share = max(1, members.count() // ORDERED)
    seen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).mapInArrow(_shingles, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    common = seen.where("n > 1").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    late, count = common["shingle"].to_numpy().view(np.uint64), common["n"].to_numpy()
    order = np.argsort(late)
    parts = own.mapInArrow(_prefixes(late[order], count[order]), "doc_id long, shingles array<long>")
    parts = scratch.save(parts.join(members, "doc_id").select("doc_id", "component", "n_shingles", F.explode("shingles").alias("shingle")))
    met = _prefixed(parts, "one").join(_prefixed(parts, "two"), F.expr(
        f"one_shingle = two_shingle and one_component < two_component and 100 * least(one_n_shingles, two_n_shingles) >= {PERCENT} * greatest(one_n_shingles, two_n_shingles)"))
    return met.select("one_doc_id", "two_doc_id").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept).

    Words are parted by white space, A-Z lower-cased; a text of fewer than five words is one shingle. Null and empty texts
    have no shingle, are linked with nothing and kept. A row without doc_id is kept without a component. Rows that repeat a
    doc_id share its links. Other columns are ignored.

    Texts with equal shingle sets become one before any pair is made. A band that many texts share is compared with its
    smallest member only. What those links leave in different components within a band is then compared across components: pair
    by pair while these are few, else by a join on each text's rarest shingles, which finds every pair that is similar enough.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = scratch.save(docs.mapInArrow(_signatures, SCHEMA))
    keys = ["digest_a", "digest_b", "n_shingles"]
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(filled.groupBy(keys).agg(F.min("doc_id").alias("class_id")))
    texts = scratch.save(filled.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    bands = texts.select("doc_id", F.posexplode("bands").alias("place", "band"))
    shared = scratch.save(bands.groupBy("band").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"))
    member = scratch.save(bands.join(shared, "band"))
    known = texts.select("doc_id", "n_shingles", *SKETCH)
    tried = member.where("head <> doc_id").select(F.col("head").alias("head_doc_id"), F.col("doc_id").alias("own_doc_id")).distinct()
    tried = tried.join(_prefixed(known, "head"), "head_doc_id").join(_prefixed(known, "own"), "own_doc_id").where(_likely("head", "own"))
    links = _links(docs, tried.select(F.col("head_doc_id").alias("head"), F.col("own_doc_id").alias("doc")), scratch)

    found = scratch.save(components(links, scratch))
    placed = member.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "band", "place", "doc_id", "head", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    placed = scratch.save(placed.join(mixed, "band", "left_semi").where("doc_id <> head").drop("head").join(texts.select("doc_id", "n_shingles", "bands", *SKETCH), "doc_id"))
    work = placed.groupBy("band").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
    if (work[0] or 0) > PAIRWISE * (work[1] or 0):
        apart = _by_prefixes(docs, placed, scratch)
        across = apart.join(_prefixed(known, "one"), "one_doc_id").join(_prefixed(known, "two"), "two_doc_id").where(_likely("one", "two"))
    else:
        # a pair is made in one band only, told by the whole value of the earlier ones
        met_before = F.expr(" or ".join(f"(one_place > {k} and one_bands[{k}] = two_bands[{k}])" for k in range(BANDS - 1)))
        across = _prefixed(placed, "one").join(
            _prefixed(placed, "two"), F.expr("one_band = two_band and one_component < two_component") & _likely("one", "two") & ~met_before)
    across = across.select(F.least("one_doc_id", "two_doc_id").alias("head"), F.greatest("one_doc_id", "two_doc_id").alias("doc")).distinct()
    more = _links(docs, across, scratch)
    if more.limit(1).count():
        found = scratch.save(components(links.unionByName(more), scratch))
    scratch.drop(texts, shared, member, placed, links, more)
    classed = classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left")
    classed = classed.select(*keys, F.coalesce("component", "class_id").alias("component_id"))
    out = signed.select("doc_id", *keys).join(classed, keys, "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps: one document of each group; rows without doc_id, text or words stay.

    The ids to leave out are written first: while their files are below Spark's threshold the texts are not shuffled.
    """
    repeated = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    repeated = Scratch(docs.sparkSession, "repeated").save(repeated)
    return docs.join(repeated, "doc_id", "left_anti").select(docs.columns)
