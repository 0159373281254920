"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

from __future__ import annotations

import pytest

import corpus_pipeline
from sparkbars.llm.chunks import shared_passages
from sparkbars.llm.decontam import contamination
from sparkbars.llm.lang_id import identify
from sparkbars.llm.licences import licences
from sparkbars.llm.near_dup import near_duplicates
from sparkbars.llm.neighbours import nearest_of_every
from sparkbars.llm.packing import pack
from sparkbars.llm.pii import digest, find_spans, redact
from sparkbars.llm.quality import quality
from sparkbars.llm.suffixes import repeated_strings

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, component_id long, spans string, band long, key long, length long, "
          "text_id string, n long, score string, held_out string, window long, slots string, digest string, rank int, part int, kept string")
LONG = "river stone and cloud " * 60_000
ROWS = [(1, None, None), (2, "", "en"), (3, "  \n\t ", "en"), (4, "word", "en"), (5, LONG, "en"), (6, "one two three four five six", "en"),
        (7, "one two three four five six", "en"), (7, "one two three four five six", "en"), (None, "one two three four five six", None),
        (8, "12345 !!! \u0000 é \U0001F600", "xx"), (9, "aaaa" * 300, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "s", None, *[None] * 15) for i, t, lang in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, None), (4, 1, 0), (4, 0, 1), (6, None, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (None, "x y"), (3, "")],
                                 "item_id long, text string")


def by_id(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_licences(docs, empty):
    assert licences(docs).count() == 0 and licences(empty).count() == 0


def test_repeated_strings(docs, empty):
    found = by_id(repeated_strings(docs))
    assert sum(map(len, found.values())) == len(ROWS) and found[1][0].n_bytes == 0 and found[4][0].n_removed == 0
    assert found[5][0].n_removed == found[5][0].n_bytes and found[5][0].n_spans == 1 and found[9][0].n_removed == 1200
    assert repeated_strings(empty).count() == 0


def test_shared_passages(docs, empty):
    assert set(by_id(shared_passages(docs))) <= {5, 9} and shared_passages(empty).count() == 0


def test_quality(docs, empty, labels):
    found = by_id(quality(docs, labels))
    assert sum(map(len, found.values())) == len(ROWS) and all(0 <= r.score <= 1 for x in found.values() for r in x)
    assert quality(empty, labels).count() == 0
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}


def test_language(docs, empty):
    found = by_id(identify(docs))
    assert all(found[k][0].lang_pred == "und" and found[k][0].score == 0 for k in (1, 2, 3)) and found[None][0].held_out
    assert found[6][0].lang_pred in ("en", "xx") and identify(empty).count() == 0
    assert {r.lang_pred for r in identify(docs.withColumn("lang", docs.lang.substr(5, 1))).collect()} - {""} == {"und"}


def test_personal_data(docs, empty):
    found = by_id(digest(find_spans(docs)))
    assert sum(map(len, found.values())) == len(ROWS) and found[1][0].spans == "" and digest(find_spans(empty)).count() == 0
    assert redact(docs).columns == docs.columns and redact(docs).count() == len(ROWS)


def test_packing(docs, empty):
    found = by_id(pack(docs))
    assert found[1][0].length == found[2][0].length == 1 and len(found[7]) == 2 and len(found[None]) == 1
    assert [r.length for r in sorted(found[5], key=lambda r: r.piece)][1:] == [1024] * (len(found[5]) - 1)
    assert pack(empty).count() == 0


def test_near_duplicates(docs, empty):
    found = by_id(near_duplicates(docs))
    assert found[7][0].component_id == 6 and not found[7][1].kept and found[6][0].kept
    assert all(found[k][0].n_shingles == 0 and found[k][0].kept for k in (1, 2, 3))
    assert found[None][0].component_id is None and found[None][0].kept and found[5][0].n_shingles == 4
    assert near_duplicates(empty).count() == 0


def test_neighbours(spark):
    assert nearest_of_every(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_contamination(docs, empty, items):
    found = contamination(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.share) for r in found) == [(6, 1, 1.0), (7, 1, 1.0)]
    assert contamination(empty, items).count() == contamination(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, docs, empty, stage):
    for frame in (docs, empty):
        out = stage[1](spark, frame, "/root/testdata/sf0.001")
        rows = out.collect()
        if stage is not corpus_pipeline.STAGES[-1]:
            assert out.columns == docs.columns and len(rows) <= frame.count()
        if frame is docs and stage[0] == "language_id":
            assert {r.doc_id for r in rows} == {4, 5, 6, 7, None, 8, 9}
        if frame is docs and stage[0] == "near_dedup":
            assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, None, 8, 9}


def test_language_is_decided_row_by_row(spark):
    rows = [(1, "the river is long and the stone is old", "en"), (1, None, "en"), (None, None, None), (None, "der Fluss ist lang", "de"), (2, "12 34", "en"), (2, "der Stein", "de")]
    frame = spark.createDataFrame([(i, t, lang, "s", n, "x", n) for n, (i, t, lang) in enumerate(rows)],
                                  "doc_id long, text string, lang string, source string, n_chars long, held_out string, kept long")
    out = corpus_pipeline.language(spark, frame, "")
    assert out.columns == frame.columns and sorted(r.n_chars for r in out.collect()) == [0, 3, 5]


@pytest.mark.parametrize("k", range(1, 4))
def test_repeated_and_null_ids_in_the_filters(spark, k):
    text = "one two three four five six seven eight nine ten"
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None), (4, item), (4, "other words"), (None, item), (5, "call +49 30 1234567 now")]
    frame = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.withColumn("row", frame.n_chars)
    name, stage = corpus_pipeline.STAGES[k]
    kept = {r.row: r for r in stage(spark, frame, "/root/testdata/sf0.001").collect()}
    want = {"near_dedup": {0, 1, 3, 4, 5, 6, 7, 8, 9}, "decontamination": {0, 1, 2, 3, 4, 5, 8, 9}, "personal_data": set(range(10))}[name]
    assert set(kept) == want
    if name == "personal_data":
        assert kept[9].text == "call [PHONE] now" and kept[9].n_chars == len(kept[9].text) and kept[5].n_chars is None


def test_pipeline_is_its_stages(spark):
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = set(texts) - {r.doc_id for r in identify(docs).collect() if r.lang_pred == "und"}
    one = docs.where(docs.doc_id.isin(sorted(kept)))
    kept -= {r.doc_id for r in near_duplicates(one).collect() if not r.kept}
    two = docs.where(docs.doc_id.isin(sorted(kept)))
    kept -= {r.doc_id for r in contamination(two, spark.read.parquet(f"{root}/benchmark.parquet")).collect()}
    found = corpus_pipeline.run(spark, root).collect()
    assert {r.doc_id for r in found} == kept and len(kept) > 100
