"""Quality scores learned from trusted positives and unlabelled text: non-negative positive-unlabelled risk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, utf8
from .words import SEPARATOR, prefix_hash, word_bounds, BYTE_VALUES, LOWER, mix

SAMPLE = 20_000      # positives and unlabelled texts, each, that the classifier is fitted on, about; taken by hash of doc_id
HELD_OUT = (4, 2)    # labels of rows whose crc32(doc_id) has this remainder are never read
THRESHOLD = 0.7
STEPS = 400

CLASSES = np.zeros((6, 256), bool)  # letters, capitals, digits, sentence marks, exclamation marks, other signs
CLASSES[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True
CLASSES[1, 65:91] = True
CLASSES[2, 48:58] = True
CLASSES[3, [ord(c) for c in ".,;:?'\"-()"]] = True
CLASSES[4, ord("!")] = True
CLASSES[5, 33:127] = True
CLASSES[5] &= ~CLASSES[:5].any(axis=0)
PARTS = 12
NAMES = [f"f{k}" for k in range(2 * PARTS + 1)]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text: shares of signs and words, their square roots, and the length; all 0 for a text without a word."""
    sums = [np.concatenate([[0], np.cumsum(c[data])]) for c in CLASSES]
    word = ~SEPARATOR[data]
    starts, ends, owner = word_bounds(data, offsets, word)
    hashed, down = prefix_hash(BYTE_VALUES[LOWER[data]])
    words = mix((hashed[ends] - hashed[starts]) * down[starts])
    rows = len(offsets) - 1
    first = np.searchsorted(owner, np.arange(rows + 1))
    count = np.maximum(1, np.diff(first))
    signs = np.maximum(1, np.diff(np.concatenate([[0], np.cumsum(word)])[offsets]))
    size = ends - starts

    def share(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[first]) / count

    letters, capitals = (s[ends] - s[starts] for s in sums[:2])
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
    lines = np.diff(np.concatenate([[0], np.cumsum(data == 10)])[offsets])
    columns = [np.diff(s[offsets]) / signs for s in sums]
    columns += [share(again), share(letters == 0), share((capitals == letters) & (letters > 1)), np.log1p(distinct) / np.log1p(count),
                np.minimum(1, lines / count), np.minimum(1, share(size) / 40)]
    table = np.stack([*columns, *(np.sqrt(c) for c in columns), np.log1p(np.diff(offsets)) / 20], axis=1)
    table[np.diff(first) == 0] = 0
    return table


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        table = features(*utf8(block.column("text")))
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], ["doc_id", *NAMES])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _fit(gradient, width: int) -> np.ndarray:
    weights, mean, square = (np.zeros(width) for _ in range(3))
    for step in range(1, STEPS + 1):
        g = gradient(weights)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        weights = weights - 0.05 * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of the tails of a positive-or-unlabelled score.

    Above any threshold lies at least prior times the positives' share of the unlabelled; where the tail is nearly pure, that
    is all. The confidence term keeps small tails from being taken at their word.
    """
    def gradient(w: np.ndarray) -> np.ndarray:
        p, u = _sigmoid(positive @ w), _sigmoid(unlabelled @ w)
        return positive.T @ (p - 1) / len(positive) + unlabelled.T @ u / len(unlabelled) + 1e-3 * w

    weights = _fit(gradient, positive.shape[1])
    p, u = np.sort(positive @ weights), np.sort(unlabelled @ weights)
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.95, 96)))
    tails = [1 - np.searchsorted(x, cuts) / len(x) for x in (p, u)]
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((tails[1] + slack) / np.maximum(tails[0], 1e-9))
    return float(np.clip(tails[1][best] / max(tails[0][best], 1e-9), 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights of least non-negative risk with logistic loss.

    risk = prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]); where the second part is negative, the step goes
    against it.
    """
    def gradient(w: np.ndarray) -> np.ndarray:
        p, u = positive @ w, unlabelled @ w
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        from_negative = unlabelled.T @ _sigmoid(u) / len(u) - prior * positive.T @ _sigmoid(p) / len(p)
        if negative < 0:
            return -from_negative
        return prior * positive.T @ (_sigmoid(p) - 1) / len(p) + from_negative + 1e-4 * w

    return _fit(gradient, positive.shape[1])


def held_out() -> Column:
    divisor, remainder = HELD_OUT
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == remainder, F.lit(False))


def _sampled(frame: DataFrame) -> np.ndarray:
    """About SAMPLE rows, or all if there are fewer: those whose hash of doc_id lies below the share that gives so many."""
    frame = frame.where("doc_id is not null")
    below = min(1.0, SAMPLE / max(1, frame.count())) * 2**32
    rows = frame.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 32) < F.lit(below)).select(*NAMES).toArrow()
    return np.stack([rows[n].to_numpy() for n in NAMES], axis=1)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality, ...) -> (doc_id, held_out, score, predicted).

    Positives are the labelled texts of quality 1 that are not held out, unlabelled texts all of docs without their labels;
    about SAMPLE of each are fitted on. Features are scaled by their mean and deviation over all texts. Null and empty texts have
    all features 0 and get a score like any other. Without a positive every score is 0.5. Rows without doc_id count as not held
    out; repeated rows are scored one by one; repeated or contradicting labels count as positive once. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = scratch.save(docs.mapInArrow(_features, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES)))
    trusted = labels.select(F.col("doc_id").cast("long"), "quality").where((F.col("quality") == 1) & ~held_out()).select("doc_id").distinct()
    positive, unlabelled = _sampled(table.join(trusted, "doc_id", "left_semi")), _sampled(table)
    scales = table.agg(*(f(n).alias(f"{k}{n}") for n in NAMES for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if len(positive):
        mean = np.array([scales[f"m{n}"] for n in NAMES])
        deviation = np.array([scales[f"s{n}"] or 1.0 for n in NAMES])
        positive, unlabelled = (np.hstack([(x - mean) / deviation, np.ones((len(x), 1))]) for x in (positive, unlabelled))
        weights = fit(positive, unlabelled, class_prior(positive, unlabelled))
        inner = weights[:-1] / deviation
        margin = F.lit(float(weights[-1] - inner @ mean))
        for name, weight in zip(NAMES, inner.tolist(), strict=True):
            margin = margin + F.lit(weight) * F.col(name)
        score = 1 / (1 + F.exp(-margin))
    else:
        score = F.lit(0.5)
    out = table.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
