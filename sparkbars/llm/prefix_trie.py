"""Prefix trie of conversations: shards of sorted paths as balanced parentheses, merged where neighbouring shards share a spine."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

GROUP = 5             # conversations that begin like the one whose conv_id is divisible by this
HEADS = 9             # a rebuilt conversation takes fewer turns than this from the first of its group
BAND = 64             # levels of a band; longer paths are cut into bands, so a path's list stays short
SHARD_NODES = 1 << 18  # entries of paths that one encoding holds
BLOCK = 32            # parentheses of a block whose least excess is kept
CHUNK = 512           # conv_ids of a piece of a list of ends
KEY = ["depth", "hi", "lo"]
ABOVE = Window.unboundedPreceding


def ordered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, part, place, digest, n_bytes): turns numbered from 1, by turn (null first), then by the digest of role and text.

    Rows are dealt by ranges of (conv_id, turn, digest), so a long conversation spreads over parts; a turn's number is the count
    of its conversation's turns in the parts before and its place in its own part. Null roles and texts are empty; rows without
    conv_id take no part; equal turns count each. Texts become digests here and are not shuffled.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("spread"))
    order = [F.col("turn").asc_nulls_first(), "digest", "spread"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(rows.repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(ABOVE, -1))
    counts = counts.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    numbered = dealt.withColumn("place", place).join(counts, ["conv_id", "part"])
    return scratch.save(numbered.select("conv_id", "part", (F.col("before") + F.col("place")).alias("place"), "digest", "n_bytes"))


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """The same columns: every conversation c begins with the first h turns of conversation c - c % group, h = crc32(c) % heads, all
    if there are fewer and none if it is absent, and goes on with its own turns after its first h. One row of place 0 and no
    digest stands for each conversation, so that those left without turns stay."""
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    sizes = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    lead = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.select("conv_id", share, (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(lead, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    first = turns.where(F.col("place") < heads).select(F.col("conv_id").alias("base"), "place", "digest", "n_bytes")
    head = convs.where("taken > 0").join(first, "base").where("place <= taken").select("conv_id", F.lit(-1).alias("part"), "place", "digest", "n_bytes")
    known = turns.select("conv_id", "part").distinct().join(convs.select("conv_id", "h", "taken"), "conv_id")
    own = turns.join(known, ["conv_id", "part"]).where("place > h")
    own = own.select("conv_id", "part", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "digest", "n_bytes")
    return head.unionByName(own).unionByName(_starts(sizes))


def _starts(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("digest"),
                        F.lit(0).cast("long").alias("n_bytes"))


def _keyed(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, hi, lo, up_hi, up_lo, n_bytes): the key of a node is the exclusive or of a 128-bit digest of each (depth, turn) of its path.

    That sum runs over parts like the numbers of turns do. The root has the key 0.
    """
    term = F.md5(F.concat_ws(":", F.col("place").cast("string"), "digest").cast("binary"))
    own = [F.when(F.col("digest").isNull(), F.lit(0)).otherwise(F.conv(F.substring(term, k, 16), 16, -10).cast("long")) for k in (1, 17)]
    rows = paths.select("conv_id", "part", F.col("place").alias("depth"), own[0].alias("own_hi"), own[1].alias("own_lo"), "n_bytes")
    sums = rows.groupBy("conv_id", "part").agg(F.bit_xor("own_hi").alias("hi"), F.bit_xor("own_lo").alias("lo"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(ABOVE, -1)
    carried = sums.select("conv_id", "part", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"past_{c}") for c in ("hi", "lo")))
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(ABOVE, 0)
    rows = rows.select("*", *(F.bit_xor(f"own_{c}").over(so_far).alias(f"here_{c}") for c in ("hi", "lo"))).join(carried, ["conv_id", "part"])
    for c in ("hi", "lo"):
        rows = rows.withColumn(c, F.col(f"past_{c}").bitwiseXOR(F.col(f"here_{c}"))).withColumn(f"up_{c}", F.col(c).bitwiseXOR(F.col(f"own_{c}")))
    return rows.select("conv_id", *KEY, "up_hi", "up_lo", "n_bytes")


def _nodes(rows: DataFrame) -> DataFrame:
    """One row a node: (key, conv_id, parent_conv_id, n_convs, n_children, weight), weight being what the node itself saves."""
    least = [F.min(c).alias(c) for c in ("conv_id", "up_hi", "up_lo", "n_bytes")]
    nodes = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), *least)
    weight = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("weight")
    nodes = nodes.select(*KEY, "conv_id", "n_convs", weight, (F.col("depth") - 1).alias("up_depth"), "up_hi", "up_lo")
    return nodes


def _related(nodes: DataFrame) -> DataFrame:
    up = [F.col(f"up_{c}") for c in KEY]
    children = nodes.where("depth > 0").groupBy(*(c.alias(k) for c, k in zip(up, KEY, strict=True))).agg(F.count("*").alias("n_children"))
    parents = nodes.select(*(F.col(c).alias(f"up_{c}") for c in KEY), F.col("conv_id").alias("parent_conv_id"))
    related = nodes.join(parents, [f"up_{c}" for c in KEY], "left").join(children, KEY, "left")
    return related.select(*KEY, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "weight")


def _paths(rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Distinct paths within bands of `width` levels: (band, path, hi, lo, weight, leaf, below_saved, below_leaves).

    A node's owner is its smallest member; a conversation owns the end of its path, from some depth on. It gives a path in each
    band in which it owns a node, with weights and leaves of its own nodes only, so each counts once whatever shard it falls in.
    What lies in deeper bands is summed per conversation and added at the node where the band ends, again at its owner.
    """
    own = nodes.select("conv_id", "depth", "weight", (F.col("n_children") == 0).cast("long").alias("leaf"))
    step = F.struct("depth", "hi", "lo", "weight", "leaf")
    steps = rows.select("conv_id", *KEY).join(own, ["conv_id", "depth"], "left").withColumn("band", F.floor(F.col("depth") / width))
    bands = steps.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list(step)).alias("path"), F.coalesce(F.sum("weight"), F.lit(0)).alias("saved"),
                                                 F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"))
    wide = F.floor(F.col("band") / 1024)
    bands = bands.withColumn("wide", wide)
    outer = bands.groupBy("conv_id", "wide").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("wide")).rowsBetween(ABOVE, -1)
    outer = outer.select("conv_id", "wide", *(F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(f"far_{c}") for c in ("saved", "leaves")))
    deeper = Window.partitionBy("conv_id", "wide").orderBy(F.desc("band")).rowsBetween(ABOVE, -1)
    near = [(F.coalesce(F.sum(c).over(deeper), F.lit(0))).alias(f"near_{c}") for c in ("saved", "leaves")]
    bands = bands.select("conv_id", "band", "wide", "path", *near).join(outer, ["conv_id", "wide"])
    for c in ("saved", "leaves"):
        bands = bands.withColumn(f"below_{c}", F.col(f"near_{c}") + F.col(f"far_{c}"))
    end = F.element_at("path", -1)
    whole = bands.where(F.size("path") == width)
    sums = whole.groupBy("band", end["hi"].alias("hi"), end["lo"].alias("lo")).agg(
        F.min("conv_id").alias("conv_id"), F.sum("below_saved").alias("below_saved"), F.sum("below_leaves").alias("below_leaves"))
    owned = bands.where(end["weight"].isNotNull()).select("conv_id", "band", "path")
    return owned.join(sums.drop("hi", "lo"), ["conv_id", "band"], "left").select(
        "band", F.transform("path", lambda x: F.struct(x["hi"], x["lo"])).alias("keys"),
        *(F.col("path")[c].alias(c) for c in ("hi", "lo")), *(F.transform(F.col("path")[c], lambda x: F.coalesce(x, F.lit(0))).alias(c) for c in ("weight", "leaf")),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("below_saved", "below_leaves")))


class Parentheses:
    """A balanced sequence of parentheses, and the least excess of each block and of each range of blocks above them."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = max(1, -(-len(opens) // BLOCK))
        self.size = 1 << (blocks - 1).bit_length()
        padded = np.full(self.size * BLOCK, np.iinfo(np.int64).max)
        padded[:len(opens)] = self.excess
        self.padded = padded
        self.least = np.empty(2 * self.size, np.int64)
        self.least[self.size:] = padded.reshape(-1, BLOCK).min(axis=1)
        level = self.size
        while level > 1:
            level //= 2
            self.least[level:2 * level] = np.minimum(self.least[2 * level:4 * level:2], self.least[2 * level + 1:4 * level:2])

    def _within(self, start: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first place from `start` to the end of its block whose excess is at most `goal`, or -1."""
        found, place = np.full(len(start), -1), start.copy()
        left = np.arange(len(start))
        for _ in range(BLOCK):
            hit = self.padded[place[left]] <= goal[left]
            found[left[hit]] = place[left[hit]]
            left = left[~hit]
            place[left] += 1
            left = left[place[left] % BLOCK != 0]
            if not len(left):
                break
        return found

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the next place where the excess is one less."""
        goal, nxt = self.excess[at] - 1, at + 1
        close = np.where(nxt % BLOCK == 0, -1, -2)
        inside = np.flatnonzero(close == -2)
        close[inside] = self._within(nxt[inside], goal[inside])
        left = np.flatnonzero(close < 0)
        node = at[left] // BLOCK + self.size
        climbing = np.ones(len(left), bool)
        while climbing.any():  # up, until the range to the right goes low enough
            right = climbing & (node % 2 == 0)
            low = np.zeros(len(left), bool)
            low[right] = self.least[node[right] + 1] <= goal[left[right]]
            node = np.where(low, node + 1, np.where(climbing, node // 2, node))
            climbing &= ~low
        while len(node) and node.min() < self.size:  # and down to its first block that does
            down = node < self.size
            child = 2 * node[down]
            node[down] = np.where(self.least[child] <= goal[left[down]], child, child + 1)
        close[left] = self._within((node - self.size) * BLOCK, goal[left])
        return close


def encoded(length: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Parentheses of sorted paths of these lengths, each sharing its first `common` nodes with the path before: close what ends, open what begins."""
    turns = np.empty(2 * len(length) + 1, np.int64)
    turns[0], turns[2:-1:2], turns[-1] = 0, length[:-1] - common[1:], length[-1]
    turns[1::2] = length - common
    return np.repeat(np.arange(len(turns)) % 2 == 1, turns)


def shard(hi: np.ndarray, lo: np.ndarray, weight: np.ndarray, leaf: np.ndarray, length: np.ndarray, saved: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sorted paths, laid end to end: (entry of each node's first path, what its subtree saves, its leaves), each as far as these paths know."""
    start = np.cumsum(length) - length
    row = np.repeat(np.arange(len(length)), length)
    level = np.arange(len(hi)) - start[row]
    before = np.where(row > 0, start[row - 1] + level, 0)
    alike = (row > 0) & (level < length[row - 1])
    alike &= (hi[before * alike] == hi) & (lo[before * alike] == lo)
    common = np.minimum.reduceat(np.where(alike, length.max(), level), start)
    common = np.minimum(common, length)
    tree = Parentheses(encoded(length, common))
    opening = np.flatnonzero(tree.opens)
    closing = tree.find_close(opening)
    entry = np.flatnonzero(level >= common[row])  # of each node, in the order in which they open
    count = len(entry) + 1
    by_level = np.argsort(level, kind="stable")
    first = np.full(len(hi), -1)
    first[entry] = np.arange(len(entry)) + level[entry] * count
    node = np.empty(len(hi), np.int64)  # of each entry: the one that its level opened last
    node[by_level] = np.maximum.accumulate(first[by_level]) - level[by_level] * count
    weights, true, extra = (np.zeros(len(entry), np.int64) for _ in range(3))
    np.add.at(weights, node, weight)
    np.add.at(true, node, leaf)
    ends = node[start + length - 1]
    np.add.at(weights, ends, saved)
    np.add.at(extra, ends, leaves)
    pair = tree.opens & ~np.append(tree.opens[1:], True)
    extra -= pair[opening] & (true == 0)  # paths that end here, but go on in another shard or band
    rank_pair, rank_open = (np.concatenate([[0], np.cumsum(x)]) for x in (pair, tree.opens))
    past = rank_open[closing]
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (weights, extra)]
    each = [x[past] - x[:-1] for x in sums]
    return entry, each[0], rank_pair[closing] - rank_pair[opening] + each[1]


def _encode(width: int, limit: int) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("hi").offsets.to_numpy())
            before, row = np.concatenate([[0], np.cumsum(sizes)]), 0
            while row < len(batch):
                end = max(row + 1, int(np.searchsorted(before, before[row] + limit, "right")) - 1)
                own, length = batch.slice(row, end - row), sizes[row:end]
                hi, lo, weight, leaf = (own.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("hi", "lo", "weight", "leaf"))
                band, saved, leaves = (own.column(c).to_numpy(zero_copy_only=False) for c in ("band", "below_saved", "below_leaves"))
                entry, subtree, inside = shard(hi, lo, weight, leaf, length, saved, leaves)
                start = np.cumsum(length) - length
                depth = np.repeat(band * width - start, length) + np.arange(len(hi))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (depth[entry], hi[entry], lo[entry], subtree, inside)], [*KEY, "saved_tokens", "n_leaves"])
                row = end
    return encode


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a node from sorted pieces of its list, which are hashed one after the other."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        out = []
        for *now, piece in zip(*(batch.column(c).to_pylist() for c in (*KEY, "piece")), strict=True):
            if now != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield _digest_rows(out)
    if key:
        yield _digest_rows([(*key, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of the ascending conv_ids that end at a node, joined by commas, for nodes that have any.

    Ranges of CHUNK ids become one string each before the shuffle by node. A digest has to read its list in order, so the
    strings of one node pass through one task, a batch at a time.
    """
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("end")).select("conv_id", *(F.col("end")[c].alias(c) for c in KEY))
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = last.groupBy(*KEY, F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_join(ids, ",").alias("piece"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, *KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "piece")
    return dealt.mapInArrow(_digests, "depth long, hi long, lo long, ends_sha256 string")


def trie(paths: DataFrame, scratch: Scratch, width: int = BAND, limit: int = SHARD_NODES) -> DataFrame:
    """The nodes of the trie of numbered turns (see ordered and rebuilt), with a row of place 0 for each conversation."""
    rows = scratch.save(_keyed(paths))
    nodes = scratch.save(_related(_nodes(rows)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_paths = _paths(rows, nodes, width).repartitionByRange(parts, "band", "keys").sortWithinPartitions("band", "keys").drop("keys")
    known = sorted_paths.mapInArrow(_encode(width, limit), "depth long, hi long, lo long, saved_tokens long, n_leaves long")
    merged = known.groupBy(*KEY).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    whole = nodes.join(merged, KEY).join(_ends(rows), KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, rebuild: bool = False, width: int = BAND, limit: int = SHARD_NODES) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> the nodes of their prefix trie, one row each.

    A node is a distinct sequence of first turns (role, text), from the textless root of depth 0: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of the subtree's turns that a shared copy saves),
    ends_sha256 (of the conversations that end there). With `rebuild`, conversations are first made to share beginnings.

    Nulls in role and text are empty strings; a null turn comes first; turns of one number follow the digests of their role and
    text; repeated rows are turns of their own; rows without conv_id take no part. No rows give no nodes. Other columns are ignored.

    Sequences are compared by 128-bit keys. Paths are sorted by ranges and cut into bands of `width` levels, so neither a first turn
    that most conversations share nor a conversation of very many turns is held by one task. Each shard is encoded as balanced
    parentheses; nodes on the spines that shards share are merged by sums.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = ordered(conversations, scratch)
    paths = rebuilt(turns) if rebuild else turns.unionByName(_starts(turns.select("conv_id").distinct()))
    return trie(paths, scratch, width, limit)
