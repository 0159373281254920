"""Hard negatives against all scores in Python's whole numbers."""

from __future__ import annotations

import math

import numpy as np

from sparkbars.llm.negatives import LONG, Lists, bounds, hard_negatives, relabelled

SCHEMA = "vec_id long, embedding array<float>, label int, score long, place long"


def brute(rows, positives=5, negatives=3):
    known = {}
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            own = (label, [float(np.float32(x)) for x in e])
            known[i] = min(known.get(i, own), own)
    whole = {i: (label, [math.floor(256 * x) for x in e]) for i, (label, e) in known.items()}
    out = []
    for a, (label, e) in whole.items():
        if a % 50:
            continue
        score = {i: sum(x * y for x, y in zip(e, v, strict=True)) for i, (_, v) in whole.items() if i != a and len(v) == len(e)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == label][:positives]:
            inside = [i for i in order if whole[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(inside[:negatives])]
    return sorted(out)


def found(spark, rows, **more):
    frame = spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives(frame, **more).collect()))


def test_ties_signs_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).tolist(), int(rng.integers(0, 3))) for i in range(600)]
    rows += [(i, [1.0, -1.0, 0.5] + [0.0] * 9, int(i % 2)) for i in range(600, 1200)]  # one vector, over and over
    rows += [(i, [0.0] * 12, 1) for i in range(1200, 1260)] + [(i, rng.normal(size=5).tolist(), 1 + i % 2) for i in range(1300, 1400)]
    rows += [(i, [], i % 2) for i in range(1450, 1460)]
    rows += [(None, [1.0] * 12, 1), (2000, None, 1), (2050, [1.0] * 11 + [None], 1), (2100, [math.nan] * 12, 1), (2150, [math.inf] * 12, 1), (2200, [1.0] * 12, None)]
    rows += [rows[0], rows[50], (0, rows[1][1], 2), (2250, [3.0] + [0.0] * 11, 0)]
    assert found(spark, rows) == brute(rows) and found(spark, rows, groups=3) == brute(rows)


def test_the_anchors_may_be_named_and_labels_moved(spark):
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 3) for i in range(60)], "vec_id long, embedding array<float>, label int")
    named = spark.createDataFrame([(3,), (3,), (99,)], "vec_id long")
    assert {r.anchor_id for r in hard_negatives(frame, named).collect()} == {3}
    labels = {r.vec_id: r.label for r in relabelled(frame).collect()}
    assert labels[7] == 2 and labels[14] == 3 and labels[0] == 1 and labels[8] == 2


def test_empty_and_alone(spark):
    assert found(spark, []) == found(spark, [(50, [1.0], 1)]) == found(spark, [(50, [1.0], 1), (51, [1.0], 2)]) == []


def test_scores_beyond_doubles_and_longs_are_exact_or_cut():
    vectors = np.array([[2.0**40, 1.0], [2.0**40, 0.0], [2.0**60, 2.0**60], [-(2.0**60), 5.0]])
    lists = Lists(np.arange(4), np.zeros(4, np.int64), vectors)
    limits = np.array([[-LONG]]), np.array([[LONG]])
    *_, at, score = lists.search(np.array([[2.0**20, 1.0]]), np.ones((1, 4), bool), *limits, 4)
    assert at.tolist() == [2, 0, 1, 3] and score.tolist() == [LONG, 2**60 + 1, 2**60, -LONG]


def test_the_search_stops_early_and_bounds_are_whole():
    rng = np.random.default_rng(4)
    vectors = np.floor(256 * rng.normal(size=(5000, 3)))
    lists, read = Lists(np.arange(5000), np.zeros(5000, np.int64), vectors), []
    products = lists.products
    lists.products = lambda anchors, rows: read.append(len(rows)) or products(anchors, rows)
    limits = np.array([[-LONG]]), np.array([[LONG]])
    *_, at, score = lists.search(np.array([[200.0, -300.0, 100.0]]), np.ones((1, 5000), bool), *limits, 5)
    want = vectors @ [200.0, -300.0, 100.0]
    assert at.tolist() == np.argsort(-want)[:5].tolist() and score.tolist() == want[at].tolist() and sum(read) < 2500
    low, high = bounds(np.array([0, 1, 2, 3, 41, -2, LONG]))
    assert low.tolist() == [0, 1, 1, 2, 21, -1, -(-LONG // 2)] and high.tolist() == [0, 0, 1, 2, 38, -2, 95 * LONG // 100]
