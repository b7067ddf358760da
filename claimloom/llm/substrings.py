"""Substring deduplication by difference-cover anchors.

The word positions of a document that fall on a difference cover modulo PERIOD are its anchors; the hash of the
`window - PERIOD + 1` words from an anchor names it.  Whatever the shift between two copies of a `window`-word passage,
some anchor of the first PERIOD positions is aligned in both, so a passage that two documents share always shares an
anchor.  Anchors that stand in two documents are then extended: the windows around them are hashed with 128 bits and
each is compared with the least document that has it.

No pairs are made: a passage that very many documents share is one key, and its least document comes from partial
minima.  Texts move once, and only those of documents that hold a shared anchor.

Defined results: a null or empty text has no words; documents shorter than a window lose none; rows that repeat an id
are treated as one document whose windows are those of all its rows, and give one result row each; rows with a null id
keep all words; an empty table gives an empty result; ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import discard, meet, modest_batches, release, small, written

#: The differences of these six residues modulo 31 are all residues.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Shared anchors and their documents are broadcast up to this many bytes in memory, as beyond it all texts are shuffled.
WIDE = 64 << 20
#: Odd multipliers of two polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


class Hasher:
    """Polynomial hashes of runs of words, from prefix sums of h(word i) * base**i; a run's is divided by base**start."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.power = [self._powers(b, 1024) for b in BASES]
        self.back = [self._powers(pow(b, -1, 1 << 64), 1024) for b in BASES]

    @staticmethod
    def _powers(base: int, many: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(many, base, np.uint64))), dtype=np.uint64)

    def word(self, w: bytes) -> int:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 1 << 18:
                self.known.clear()
            got = self.known[w] = xxhash.xxh64_intdigest(w)
        return got

    def prefixes(self, words: list[bytes], many: int) -> list[np.ndarray]:
        one, out = np.array([self.word(w) for w in words], np.uint64), []
        if len(one) >= len(self.power[0]):
            self.power = [self._powers(b, 2 * len(one)) for b in BASES]
            self.back = [self._powers(pow(b, -1, 1 << 64), 2 * len(one)) for b in BASES]
        with np.errstate(over="ignore"):
            for k in range(many):
                mixed = one if not k else (one ^ (one >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * self.power[k][: len(one)], dtype=np.uint64))))
        return out

    def runs(self, prefixes: list[np.ndarray], start: np.ndarray, size: int) -> list[np.ndarray]:
        """For each base the hashes of the runs of `size` words from the given starts, as signed numbers."""
        with np.errstate(over="ignore"):
            hashes = [(p[start + size] - p[start]) * back[start] for p, back in zip(prefixes, self.back, strict=False)]
            return [((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64) for h in hashes]


def cover_positions(words: int, size: int) -> np.ndarray:
    at = np.arange(max(0, words - size + 1))
    return at[np.isin(at % PERIOD, COVER)]


def _anchors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        texts, keys, ats, rows = batch.column("_text"), [], [], []
        for k in range(batch.num_rows):
            words = words_of(texts[k].as_py())
            at = cover_positions(len(words), size)
            if len(at):
                keys.append(hasher.runs(hasher.prefixes(words, 1), at, size)[0])
                ats.append(at)
                rows.append(np.full(len(at), k))
        if keys:
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column("_id").take(row), batch.column("_h").take(row), pa.array(np.concatenate(ats).astype(np.int32))], ["key", "_id", "_h", "at"])


def _extended(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows that hold a shared anchor within their first PERIOD positions."""
    hasher = Hasher()
    for batch in batches:
        texts, anchors = batch.column("_text"), batch.column("anchors")
        one, two, starts, rows = [], [], [], []
        for k in range(batch.num_rows):
            words = words_of(texts[k].as_py())
            depth = np.zeros(len(words) + 1, np.int64)
            at = np.asarray(anchors[k].as_py(), np.int64)
            np.add.at(depth, np.maximum(at - PERIOD + 1, 0), 1)
            np.add.at(depth, at + 1, -1)
            start = np.flatnonzero(np.cumsum(depth)[: max(0, len(words) - window + 1)])
            if len(start):
                a, b = hasher.runs(hasher.prefixes(words, 2), start, window)
                one.append(a)
                two.append(b)
                starts.append(start)
                rows.append(np.full(len(start), k))
            if sum(map(len, one[-1:])) and sum(map(len, one)) > 1 << 20 or k == batch.num_rows - 1 and one:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one)), pa.array(np.concatenate(two)), batch.column("_id").take(row), batch.column("_h").take(row), pa.array(np.concatenate(starts).astype(np.int32))], ["one", "two", "_id", "_h", "at"])
                one, two, starts, rows = [], [], [], []


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, begins, ends, copy = batch.column("_text"), *(batch.column(c).to_pylist() for c in ("begins", "ends", "copy"))
        out: list[tuple[int, int, bytes]] = []
        for k in range(batch.num_rows):
            words = words_of(texts[k].as_py())
            gone = np.zeros(len(words) + 1, np.int64)
            if copy[k] and len(words) >= window:
                gone[0] = 1
            elif begins[k]:
                np.add.at(gone, np.asarray(begins[k], np.int64), 1)
                np.add.at(gone, np.asarray(ends[k], np.int64) + window, -1)
            keep = (np.cumsum(gone[: len(words)]) == 0).tolist()
            left = [w for w, kept in zip(words, keep, strict=True) if kept]
            out.append((len(words), len(words) - len(left), b" ".join(left)))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary())))], ["_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: the id, n_words, n_removed and `kept`, the words that stay, joined by spaces (binary)."""
    modest_batches(docs.sparkSession)
    spark, size = docs.sparkSession, window - PERIOD + 1
    if size < 1:
        raise ValueError(f"a window has at least {PERIOD} words")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text")).withColumn("_h", F.xxhash64("_text"))
    same = rows.select("_id", "_h", F.md5("_text").alias("_md5")).where(F.col("_id").isNotNull())
    least = written(same.groupBy("_md5").agg(F.min("_id").alias("least"), F.max("_id").alias("most")).where("least < most"), "least")
    copies = written(same.join(small(least), "_md5").where(F.col("_id") > F.col("least")).select("_id", "_h").distinct(), "copies")
    marked = small(copies).withColumn("copy", F.lit(True))
    rows = rows.join(marked, ["_id", "_h"], "left")
    kind = "key long, _id long, _h long, at int"
    anchors = rows.where(F.col("copy").isNull() & F.col("_id").isNotNull()).select("_id", "_h", "_text").mapInArrow(lambda batches: _anchors(batches, size), kind)
    shared = written(anchors.groupBy("key").agg(F.min("_id").alias("a"), F.max("_id").alias("b"), F.count("*").alias("many")).where("a < b").select("key", "many"), "shared")
    release(spark)
    hits = meet(anchors, shared, ["key"], "many", bound=WIDE).groupBy("_id", "_h").agg(F.collect_set("at").alias("anchors"))
    hits = written(hits, "hits")
    release(spark)
    windows = rows.join(small(hits, WIDE), ["_id", "_h"]).select("_id", "_h", "_text", "anchors").mapInArrow(lambda batches: _extended(batches, window), "one long, two long, _id long, _h long, at int")
    windows = written(windows, "windows")
    release(spark)
    first = written(windows.groupBy("one", "two").agg(F.min("_id").alias("a"), F.max("_id").alias("b"), F.count("*").alias("many")).where("a < b").select("one", "two", "a", "many"), "first")
    later = meet(windows, first, ["one", "two"], "many").where(F.col("_id") > F.col("a"))
    starts = later.groupBy("_id", "_h").agg(F.array_sort(F.collect_set("at")).alias("s"))
    # Windows to remove mostly follow each other: only where such runs begin and end is kept.
    begins = F.filter("s", lambda x, i: (i == 0) | (x != F.get("s", i - 1) + 1))
    ends = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (x != F.get("s", i + 1) - 1))
    starts = written(starts.select("_id", "_h", begins.alias("begins"), ends.alias("ends")), "starts")
    discard(windows, first, hits, shared)
    release(spark)
    full = rows.join(small(starts, WIDE), ["_id", "_h"], "left").select("_id", "_text", "begins", "ends", F.coalesce("copy", F.lit(False)).alias("copy"))
    kept = full.mapInArrow(lambda batches: _kept(batches, window), "_id long, n_words long, n_removed long, kept binary")
    return kept.withColumnRenamed("_id", id_col)
