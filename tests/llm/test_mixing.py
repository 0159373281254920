"""The mix against targets filled one source at a time, and the terms it has to keep."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

import pytest

from sparkbars.llm.mixing import emit, mix, taken, targets

SCHEMA = "doc_id long, text string, source string, size string, copies string, weight int, part int"


def brute_targets(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    got, free, rest = {}, set(order), share * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        for s in over or free:
            got[s] = Fraction(most * sizes[s]) if over else weight[s] * level
        free -= over or free
        rest -= sum(got[s] for s in over)
    return got


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(["word s"] * (1 + i % 7)), "hot") for i in range(9000)]
    out += [(9000 + i, "a b\tc\nd\x0be " * (i % 5), f"s{i % 23}") for i in range(4000)]
    return out + [(None, "a b", None), (20000, None, None), (20001, "", ""), (20002, " \n", "blank"), (7, "word s", "hot"), (20003, "x " * 60000, "\U0001F600"),
                  (20004, "x", "￮")]


def test_targets_rates_and_coins(spark, rows):
    frame = spark.createDataFrame([(*r, "1", "2", 3, 4) for r in rows], SCHEMA)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, source), n in zip(rows, size, strict=True):
        sizes[source] += n
    want = brute_targets(sizes)
    mixed = mix(frame)
    got = taken(mixed).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), n) for r, n in zip(rows, size, strict=True))
    source = {r[0]: r[2] for r in rows}
    total = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(float(want[s]), rel=1e-12)
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken in {r.size * int(rate), r.size * (int(rate) + (rate > int(rate)))} and r.taken <= 2 * r.size
        total[s] += r.taken
    assert float(sum(want.values())) == pytest.approx(1.5 * sum(size))
    for s in ("hot", "s1", "s8"):
        assert total[s] == pytest.approx(float(want[s]), rel=0.06)
    again = taken(mix(spark.createDataFrame([(*r, "1", "2", 3, 4) for r in rows[::-1]], SCHEMA).repartition(13))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert set(mixed.columns) >= {"text", "weight", "part", "copies"} and mixed.columns.count("size") == 1
    copies = Counter(r.doc_id for r in emit(mixed).collect())
    assert sum(copies[d] for d in set(copies)) == sum(r.copies for r in mixed.collect())


def test_reshared_excess_and_other_terms(spark):
    given = {"a": 10, "b": 1000, "c": 1, "d": 0, "e": 500, None: 3}
    frame = spark.createDataFrame([(s, n) for s, n in given.items()], "source string, size long")
    for terms in ({}, {"weights": (1,)}, {"weights": (1, 9)}, {"share": (1, 2)}, {"share": (2, 1)}, {"most": 5, "share": (4, 1)}):
        want = brute_targets(given, terms.get("weights", (3, 1, 2)), Fraction(*terms.get("share", (3, 2))), terms.get("most", 2))
        got = {r.source: r.target for r in targets(frame, **terms).collect()}
        assert got == pytest.approx({s: float(x) for s, x in want.items()}, rel=1e-12), terms


def test_empty_tables_and_tables_without_words(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = taken(mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string"))).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_the_plan_is_native_and_shuffles_no_text(spark):
    plan = taken(mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
