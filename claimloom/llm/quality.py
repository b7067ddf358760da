"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is 0 if it is rated toxic, 1 if it is only rated poor, 2 otherwise.  One weight vector over hashed
text features gives a score s; ordered thresholds t1 < t2 turn it into P(grade <= k - 1) = sigmoid(t_k - s).  Selection
uses the expected grade or a tail probability P(grade >= k).

Features are hashed: the distinct words of the text, the shapes of its words (letters, digits and marks collapsed), and
binned shares of repeated words, capitals and marks.  The model is fitted on at most `sample` rated documents, those with
the least hashes of their ids; everything else covers all rows and whole texts.

Defined results: a null or empty text has the features of an empty text; ratings with null entries are left out, the
worst of several for a document counts; without any rating every document has the prior's grade; rows that repeat are
scored alike; other columns are passed on only if named in `keep`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import fields, hidden, modest_batches, shown, with_columns

#: Hashed features; rated documents used for fitting; shapes and bins count so many times a word.
WIDTH, SAMPLE, LOUD = 1 << 17, 8000, 3.0
GRADES = 3
_EDGE = b".,;:!?\"'()[]{}"
_SHAPE = bytes(0x61 if chr(b).islower() or b >= 0x80 else 0x41 if chr(b).isupper() else 0x30 if chr(b).isdigit() else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


def _slot(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature) % WIDTH


class Features:
    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, int]] = {}

    def of_word(self, w: bytes) -> tuple[int, int]:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 1 << 17:
                self.known.clear()
            shape = _RUNS.sub(rb"\1", w.translate(_SHAPE))
            got = self.known[w] = _slot(b"w" + w.strip(_EDGE).lower()), _slot(b"s" + shape)
        return got

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Feature slots and values."""
        words = (text or b"").split()
        distinct = set(words)
        pairs = [*map(self.of_word, distinct)]
        n, size = max(1, len(words)), max(1, len(text or b""))
        letters = (text or b"").translate(None, b" \n\t")
        capitals = sum(map(letters.count, map(bytes, zip(range(65, 91))))) if letters else 0  # noqa: B905
        marks = len(letters.translate(None, bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())))
        bins = (b"repeat", 1 - len(distinct) / n), (b"capital", capitals / size), (b"mark", marks / size)
        loud = {b for _, b in pairs} | {_slot(b"b:%s:%d" % (name, int(share * 10))) for name, share in bins} | {_slot(b"length:%d" % n.bit_length())}
        soft = {a for a, _ in pairs} - loud
        slots = np.fromiter([*sorted(loud), *sorted(soft)], np.int64)
        return slots, np.concatenate((np.full(len(loud), LOUD / np.sqrt(len(loud))), np.ones(len(soft))))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: float) -> list[float]:
        """P(grade >= k) for k = 1, 2."""
        return [float(1 / (1 + np.exp(t - score))) for t in self.thresholds]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rounds: int = 300, rate: float = 0.05, ridge: float = 2e-4, lasso: float = 0.1) -> Model:
    """Penalised maximum likelihood by full-batch Adam, weights shrunk after each step; rare features keep weight 0."""
    if not rows:
        return Model(np.zeros(WIDTH, np.float32), np.array([-2.0, -1.0]))
    sizes = np.array([len(s) for s, _ in rows])
    slots, values = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    common = np.bincount(slots, minlength=WIDTH)[slots] >= max(3, len(rows) // 800)
    slots, values, owner = slots[common], values[common], owner[common]
    base = np.array([np.log((np.mean(grades < k) + 1e-3) / (np.mean(grades >= k) + 1e-3)) for k in range(1, GRADES)])
    state = np.concatenate((np.zeros(WIDTH), [base[0], np.log(np.exp(max(base[1] - base[0], 0.1)) - 1)]))
    first, second, n = np.zeros_like(state), np.zeros_like(state), len(rows)
    for step in range(1, rounds + 1):
        w, low, gap = state[:WIDTH], state[WIDTH], np.logaddexp(0, state[WIDTH + 1])
        score = np.bincount(owner, values * w[slots], minlength=n)
        ends = np.stack((np.full(n, -np.inf), low - score, low + gap - score, np.full(n, np.inf)))
        upto = 1 / (1 + np.exp(-np.clip(ends, -40, 40)))
        upto[0], upto[3] = 0, 1
        slope = upto * (1 - upto)
        pick = np.arange(n)
        above, below = grades + 1, grades
        p = np.maximum(upto[above, pick] - upto[below, pick], 1e-12)
        by_score = (slope[above, pick] - slope[below, pick]) / p / n  # d(-log p) / d score
        by_low = np.sum(np.where(grades == 0, -slope[1] / p, 0) + np.where(grades == 1, slope[1] / p, 0)) / n
        by_high = np.sum(np.where(grades == 1, -slope[2] / p, 0) + np.where(grades == 2, slope[2] / p, 0)) / n
        grad = np.concatenate((np.bincount(slots, values * by_score[owner], minlength=WIDTH) + ridge * w, [by_low + by_high, by_high / (1 + np.exp(-state[WIDTH + 1]))]))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        state -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        state[:WIDTH] = np.sign(state[:WIDTH]) * np.maximum(np.abs(state[:WIDTH]) - rate * lasso, 0)
    low = state[WIDTH]
    return Model(state[:WIDTH].astype(np.float32), np.array([low, low + np.logaddexp(0, state[WIDTH + 1])]))


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        got = [features.of(t) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("grade"), pa.array([s.astype(np.int32).tobytes() for s, _ in got], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())], ["_id", "grade", "slots", "vals"])


def rated(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text") -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and grades of at most `sample` rated documents."""
    modest_batches(docs.sparkSession)
    whole = ratings.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    graded = whole.groupBy(F.col(id_col).alias("_id")).agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("binary").alias("_text")).join(F.broadcast(chosen), "_id")
    got = rows.select("_id", "grade", "_text").mapInArrow(_featured, "_id long, grade int, slots binary, vals binary").collect()
    got.sort(key=lambda r: (r["_id"], bytes(r["slots"])))
    return [(np.frombuffer(r["slots"], np.int32).astype(np.int64), np.frombuffer(r["vals"], np.float32).astype(np.float64)) for r in got], np.array([r["grade"] for r in got], np.int64)


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    return fit(*rated(docs, ratings, sample))


def _scored(batches: Iterator[pa.RecordBatch], weights: bytes, thresholds: list[float], keep: list[str]) -> Iterator[pa.RecordBatch]:
    model, features = Model(np.frombuffer(weights, np.float32), np.array(thresholds)), Features()
    for batch in batches:
        texts, score = batch.column("_text"), np.zeros(batch.num_rows)
        for k in range(batch.num_rows):
            slots, values = features.of(texts[k].as_py())
            score[k] = values @ model.weights[slots]
        tails = [1 / (1 + np.exp(np.clip(t - score, -40, 40))) for t in model.thresholds]
        yield with_columns(batch, keep, {"expected_grade": pa.array(sum(tails)), **{f"p_at_least_{k}": pa.array(t) for k, t in enumerate(tails, 1)}})


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, expected_grade, p_at_least_1 and p_at_least_2."""
    modest_batches(docs.sparkSession)
    keep, weights, thresholds = list(keep), model.weights.tobytes(), model.thresholds.tolist()
    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(lambda batches: _scored(batches, weights, thresholds, keep), fields(docs, keep, "expected_grade double, p_at_least_1 double, p_at_least_2 double"))


#: Documents stay if the best grade is at least this likely.
LEAST = 0.5


def select(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The documents, with their columns, whose best grade has a tail probability of `least` or more."""
    rows, names = hidden(docs)
    return shown(score(rows, model, tuple(names.values()), names["text"]).where(F.col("p_at_least_2") >= least), names)
