"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, small_batches, utf8

PROFILE = 400          # n-grams of a profile
HELD_OUT = (3, 1)      # rows whose crc32(doc_id) has this remainder are never learned from
FLUSH = 1 << 20        # counted n-grams that a task keeps before it hands them on
LETTER_BITS = 10
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point the ten-bit class of its lower-case letter; 0 for what is no letter."""
    classes = np.zeros(0x110000, np.uint32)
    for start, end in ((0, 0xD800), (0xE000, 0x110000)):
        for code in range(start, end):
            letter = chr(code)
            if letter.isalpha():
                low = letter.lower()
                low = ord(low) if len(low) == 1 else code
                classes[code] = (low & (1 << LETTER_BITS) - 1) or 1
    return classes


def letter_classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all texts of a column, one per code point, and the offsets of the texts."""
    data, _ = utf8(column)
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    ends = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False))
    return _letters()[codes], np.concatenate([[0], ends]).astype(np.int64)


def ngrams(classes: np.ndarray) -> np.ndarray:
    """Codes of the letters, pairs and triples of one text; a word's edge counts as a sign, but no n-gram crosses it."""
    padded = np.zeros(len(classes) + 2, np.uint32)
    padded[1:-1] = classes
    one, two, three = padded[1:-1], padded[:-1], padded[:-2]
    pairs = (two << np.uint32(LETTER_BITS)) | padded[1:]
    triples = (three << np.uint32(2 * LETTER_BITS)) | (padded[1:-1] << np.uint32(LETTER_BITS)) | padded[2:]
    pairs = pairs[pairs > 0] | np.uint32(1 << 30)
    triples = triples[one > 0] | np.uint32(1 << 31)
    return np.concatenate([one[one > 0], pairs, triples])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged() -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang, parts in kept.items():
            codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            yield lang, codes, np.bincount(place, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)

    def handed_on() -> Iterator[pa.RecordBatch]:
        for lang, codes, counts in merged():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)],
                                             ["lang", "ngram", "n"])
        kept.clear()

    size = 0
    for block in blocks(batches):
        classes, offsets = letter_classes(block.column("text"))
        by_lang: dict[str, list[np.ndarray]] = {}
        for row, lang in enumerate(block.column("lang").to_pylist()):
            by_lang.setdefault(lang, []).append(ngrams(classes[offsets[row]:offsets[row + 1]]))
        for lang, parts in by_lang.items():
            found = np.unique(np.concatenate(parts), return_counts=True)
            kept.setdefault(lang, []).append(found)
            size += len(found[0])
        if size > FLUSH:
            for lang, codes, counts in list(merged()):
                kept[lang] = [(codes, counts)]
            size = sum(len(p[0][0]) for p in kept.values())
            if size > FLUSH // 2:
                yield from handed_on()
                size = 0
    yield from handed_on()


def profiles(docs: DataFrame) -> DataFrame:
    """docs(text, lang) -> (lang, ngram, place): the most frequent n-grams of each language over all given texts."""
    counts = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_counts, "lang string, ngram long, n long")
    counts = counts.groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "ngram"))
    return counts.withColumn("place", place).where(F.col("place") <= PROFILE).select("lang", "ngram", "place")


def _predictor(langs: list[str], known: np.ndarray, places: np.ndarray, only_kept: bool = False) -> Callable:
    """places: for each language the place of each known n-gram, with a last column for all others.

    With `only_kept`, the rows themselves come back, without those of no identifiable language."""
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            classes, offsets = letter_classes(block.column("text"))
            names, scores = [], []
            for row in range(len(block)):
                grams = ngrams(classes[offsets[row]:offsets[row + 1]])
                if not len(grams) or not langs:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                codes, counts = np.unique(grams, return_counts=True)
                order = np.argsort(-counts, kind="stable")[:PROFILE]
                counts = -counts[order]
                own = np.searchsorted(counts, counts)  # tied n-grams share a place
                at = np.minimum(np.searchsorted(known, codes[order]), len(known) - 1)
                at = np.where(known[at] == codes[order], at, len(known))
                theirs = places[:, at]
                apart = np.where(theirs < PROFILE, np.abs(theirs - own), PROFILE).sum(axis=1)
                best = int(np.argmin(apart))
                others = np.delete(apart, best)
                most = others.min() if len(others) else PROFILE * len(order)
                names.append(langs[best])
                scores.append(float((most - apart[best]) / most) if most else 0.0)
            if only_kept:
                yield block.filter(pa.array([name != UNKNOWN for name in names], pa.bool_()))
                continue
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])
    return predict


def held_out() -> Column:
    divisor, remainder = HELD_OUT
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> (doc_id, held_out, lang_pred, score).

    A text's most frequent n-grams are ranked and compared with the ranks of each language's profile; the language with the
    least out-of-place distance is predicted, ties going to the first in alphabetical order. The score is how far the second
    language is behind, as a part of its distance. Null texts, texts without a letter and texts compared with no profile at
    all are `und` with score 0. Rows without a doc_id count as held out. Repeated rows are predicted one by one; other columns
    are ignored. Only the profiles (400 n-grams for each language) come to the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), held_out().alias("held_out"))
    return docs.drop("lang").mapInArrow(_predictor(*_learned(docs)), "doc_id long, held_out boolean, lang_pred string, score double")


def _learned(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    small_batches(docs.sparkSession)
    rows = profiles(docs.where("not held_out")).collect()
    langs = sorted({r.lang for r in rows})
    known = np.unique(np.array([r.ngram for r in rows], np.uint32))
    places = np.full((len(langs), len(known) + 1), PROFILE, np.int64)
    for r in rows:
        places[langs.index(r.lang), np.searchsorted(known, np.uint32(r.ngram))] = r.place - 1
    return langs, known, places


def identifiable(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text `identify` gives a language, all columns as they are.

    Every row is judged by its own text, whatever its doc_id; rows meet their prediction in the pass that makes it, so nothing
    is joined. Null texts and texts without a letter go, and all rows if no language can be learned.
    """
    names = docs.columns
    kept = F.struct(*(F.col(f"`{c}`") for c in names if c != "text")).alias("kept")
    schema = docs.select(kept).schema["kept"].dataType.simpleString()
    learned = _learned(docs.select(F.col("text").cast("string"), F.col("lang").cast("string"), held_out().alias("held_out")))
    out = docs.select(kept, F.col("text").cast("string").alias("text")).mapInArrow(_predictor(*learned, True), f"kept {schema}, text string")
    return out.select(*(F.col("text").alias(c) if c == "text" else F.col("kept")[c].alias(c) for c in names))
