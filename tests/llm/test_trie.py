"""The prefix trie against a trie built node by node."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np

from sparkbars.llm.prefix_trie import Parentheses, encoded, prefix_trie

ROOT = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


class Node:
    def __init__(self, up, turn):
        self.up, self.depth, self.size = up, up.depth + 1 if up else 0, len(turn[1].encode()) if turn else 0
        self.children, self.members, self.ends = {}, [], []

    def rows(self):
        own, leaves, saved = [], 0, (len(self.members) - 1) * self.size
        for child in self.children.values():
            below, more, bytes_ = child.rows()
            own, leaves, saved = own + below, leaves + more, saved + bytes_
        leaves = leaves or 1
        ends = hashlib.sha256(",".join(map(str, sorted(self.ends))).encode()).hexdigest()
        up = min(self.up.members) if self.up else None
        return own + [(min(self.members), self.depth, up, len(self.members), len(self.children), leaves, saved, ends)], leaves, saved


def brute(rows, rebuild):
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        if conv is not None:
            given[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in given.items()}
    root = Node(None, None)
    for conv, own in turns.items():
        if rebuild:
            share = zlib.crc32(str(conv).encode()) % 9
            own = turns.get(conv - int(math.fmod(conv, 5)), [])[:share] + own[share:]
        at = root
        at.members.append(conv)
        for turn in own:
            at = at.children.setdefault(turn, Node(at, turn))
            at.members.append(conv)
        at.ends.append(conv)
    return sorted(root.rows()[0], key=repr) if turns else []


def found(frame, *more):
    return sorted(map(tuple, prefix_trie(frame, *more).collect()), key=repr)


def test_given_conversations(spark):
    frame = spark.read.parquet(f"{ROOT}/conversations.parquet")
    rows = list(map(tuple, frame.select("conv_id", "turn", "role", "text").collect()))
    assert found(frame, True) == brute(rows, True) and found(frame) == brute(rows, False)


def test_bands_and_shards_of_a_few_nodes(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice("ua"), rng.choice("xyz") * rng.randint(1, 2)) for c in range(-7, 40) for t in range(rng.choice([0, 3, 20]))]
    rows += [(7, t, "u", "same") for t in range(300)] + [(8, t, "u", "same") for t in range(200)] + [(100 + k, 0, "u", "first") for k in range(2000)]
    rows += [(9, 3, "u", "q")] * 5 + [(11, None, None, None), (11, 1, None, "é"), (11, 1, "", ""), (None, 1, "u", "x")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "'x' as digest", "2 as n_children")
    assert found(frame, True, 4, 23) == brute(rows, True) and found(frame, False, 4, 23) == brute(rows, False)


def test_turnless_conversations_end_at_the_root(spark):
    share = {c: zlib.crc32(str(c).encode()) % 9 for c in range(200)}
    short = [c for c in range(200) if c % 5 and share[c] > 1][:7]
    frame = spark.createDataFrame([(c, 1, "u", "t") for c in short], SCHEMA)
    none = hashlib.sha256(",".join(map(str, short)).encode()).hexdigest()
    assert found(frame, True) == [(short[0], 0, None, 7, 0, 1, 0, none)]


def test_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == found(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA), True) == []


def test_find_close_matches_a_stack():
    rng = np.random.default_rng(3)
    for paths in (1, 5, 400):
        length = rng.integers(1, 64, paths)
        common = np.concatenate([[0], np.minimum(rng.integers(0, 64, paths - 1), np.minimum(length[1:] - 1, length[:-1]))])
        opens = encoded(length, common)
        stack, want = [], {}
        for place, opening in enumerate(opens):
            if opening:
                stack.append(place)
            else:
                want[stack.pop()] = place
        at = np.flatnonzero(opens)
        assert not stack and Parentheses(opens).find_close(at).tolist() == [want[k] for k in at]
