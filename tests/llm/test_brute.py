"""Operators that SQL cannot express, against plain Python on the smallest tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkbars.llm import chunks, lang_id
from sparkbars.llm.queries import queries

ROOT = "/root/testdata/sf0.001"


def plain_chunks(data, gear):
    """Byte by byte: a cut after each byte whose hash over itself and the 15 before it is small, and after 1024 bytes."""
    out, start, h = [], 0, 0
    for k, byte in enumerate(data):
        h = (h << 1) + gear[byte] - (gear[data[k - chunks.REACH]] << chunks.REACH if k >= chunks.REACH else 0)
        if h % 2**32 < 2**32 // chunks.MEAN or k + 1 - start == chunks.LONGEST:
            out.append((start, k + 1))
            start = k + 1
    return out + [(start, len(data))] * (start < len(data))


def plain_passages(docs):
    gear = chunks.GEAR.tolist()
    texts = {d: (t or "").encode() for d, t in docs.items()}
    cut = {d: plain_chunks(raw, gear) for d, raw in texts.items()}
    places = {}
    for d in sorted(cut):
        for n, (a, b) in enumerate(cut[d]):
            places.setdefault(texts[d][a:b], []).append((d, n))

    def runs(flags, bounds):
        out, open_ = [], None
        for flag, (a, b) in zip([*flags, False], [*bounds, (0, 0)], strict=True):
            if flag:
                open_ = (open_[0] if open_ else a, b)
            elif open_:
                out += [open_] * (open_[1] - open_[0] >= chunks.SHORTEST)
                open_ = None
        return out

    found = {}
    for d, bounds in cut.items():
        at = [places[texts[d][a:b]] for a, b in bounds]
        shared = [len(p) > 1 for p in at]
        if runs(shared, bounds):
            gone = runs([len(p) > 1 and p[0] != (d, n) for n, p in enumerate(at)], bounds)
            kept = bytes(x for k, x in enumerate(texts[d]) if not any(a <= k < b for a, b in gone))
            found[d] = (len(texts[d]), len(bounds), sum(shared), len(texts[d]) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
    return found


def passages(frame):
    return {r.doc_id: (r.n_bytes, r.n_chunks, r.n_shared, r.n_removed, r.n_spans, r.kept_sha256) for r in chunks.shared_passages(frame).collect()}


def test_shared_passages_equal_a_walk_over_bytes(spark):
    frame = spark.read.parquet(f"{ROOT}/documents.parquet")
    assert passages(frame) == plain_passages({r.doc_id: r.text for r in frame.collect()})


def test_passages_repeated_within_a_text_and_long_chunks_equal_a_walk(spark):
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    one, two = prose(60), prose(40)
    docs = {5: f"{one} {prose(9)} {one} {two}", 3: f"{prose(20)} {two} {one}", 9: "a" * 5000, 7: f"{'a' * 3000} {two} {two}", 1: "", 2: None, 4: prose(70)}
    want = plain_passages(docs)
    assert passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")) == want and {3, 5, 7, 9} <= set(want)


def plain_ngrams(text):
    """Letters, pairs and triples as numbers, pairs and triples with a word's edge (0) as a sign."""
    def letter(ch):
        low = ch.lower() if len(ch.lower()) == 1 else ch
        return (ord(low) & 1023 or 1) if ch.isalpha() else 0

    signs = [0, *map(letter, text or ""), 0]
    out = Counter(s for s in signs if s)
    out.update((a << 10 | b) | 1 << 30 for a, b in zip(signs, signs[1:], strict=False) if a or b)
    out.update((a << 20 | b << 10 | c) | 1 << 31 for a, b, c in zip(signs, signs[1:], signs[2:], strict=False) if b)
    return out


def plain_languages(docs):
    counts = {}
    for doc_id, text, lang in docs:
        if lang is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1:
            counts.setdefault(lang, Counter()).update(plain_ngrams(text))
    ranked = {lang: sorted(c, key=lambda g: (-c[g], g))[:lang_id.PROFILE] for lang, c in counts.items()}
    place = {lang: {g: k for k, g in enumerate(grams)} for lang, grams in sorted(ranked.items())}
    found = {}
    for doc_id, text, _ in docs:
        grams = plain_ngrams(text)
        top = sorted(grams, key=lambda g: (-grams[g], g))[:lang_id.PROFILE]
        own = {g: sum(grams[x] > grams[g] for x in top) for g in top}
        apart = [(sum(abs(p[g] - own[g]) if g in p else lang_id.PROFILE for g in top), lang) for lang, p in place.items()]
        (best, lang), (second, _) = sorted(apart)[:2]
        found[doc_id] = (lang, (second - best) / second if second else 0.0) if top else ("und", 0.0)
    return found


def test_languages_equal_plain_profiles(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    want = plain_languages(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries()["op5_language_id"](spark, ROOT).collect()}
    assert {d: v[0] for d, v in got.items()} == {d: v[0] for d, v in want.items()}
    assert all(v[1] == pytest.approx(want[d][1], abs=1e-12) for d, v in got.items())
