"""Benchmark decontamination: an FM-index for each shard of the training documents.

Every SHARD documents of a partition are a shard.  Its words are mapped to the benchmark's vocabulary; only maximal runs of
vocabulary words that are long enough to hold a test phrase go into the index, which loses no occurrence, as every
word of an occurrence is a vocabulary word.  The runs' suffix array gives a Burrows-Wheeler transform, kept as a
wavelet matrix; all phrases are searched backward at once through its ranks, and occurrences are located by stepping
back to sampled suffix positions.

Defined results: a null or empty text has no words, no spans and no items; items whose text is null or has no words
hold no phrase, items with null ids are left out; repeated rows give repeated rows; other columns are passed on only
if named in `keep`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import discard, fields, hidden, modest_batches, shown, with_columns, written

#: Lower-cases A-Z; ASCII bytes other than letters and digits become spaces; bytes from 0x80 on belong to words.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Every so many positions of the indexed text, and each start of a run, keep their suffix position.
SAMPLE = 8
#: Documents of a shard, and the words of WORD_BYTES before lower-casing.
SHARD, WORD = 2000, re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling.  Zeros end runs: each is smaller than a later one and than all else."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    ends = np.flatnonzero(rank == 0)
    rank += len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (int(rank.max(initial=0)) + 2 + n) + follow if step == 1 else rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        step *= 2


class FmIndex:
    """Counts and locates phrases in a text of integer symbols whose runs end with 0."""

    def __init__(self, symbols: np.ndarray) -> None:
        order = suffix_array(symbols)
        last = symbols[order - 1]
        self.last = last
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=int(symbols.max()) + 1))))
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = last
        for bit in reversed(range(max(1, int(symbols.max()).bit_length()))):
            ones = (row >> bit & 1).astype(bool)
            counts = np.concatenate(([0], np.cumsum(ones, dtype=np.int32)))
            self.levels.append((bit, counts, len(row) - int(counts[-1])))
            row = np.concatenate((row[~ones], row[ones]))
        self.sampled = np.flatnonzero((order % SAMPLE == 0) | (last == 0)).astype(np.int32)
        self.places = order[self.sampled].astype(np.int32)

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row of the transform."""
        base = np.zeros_like(row)
        for bit, counts, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            row = np.where(one, zeros + counts[row], row - counts[row])
            base = np.where(one, zeros + counts[base], base - counts[base])
        return row - base

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of left-padded phrases, one backward step for all phrases at a time."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((low < high) & (length >= back))
            if not len(live):
                break
            symbol = phrases[live, -back]
            known = symbol < len(self.before) - 1
            low[live[~known]] = high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            start = self.before[symbol]
            low[live], high[live] = start + self.rank(symbol, low[live]), start + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of the rows' suffixes: each steps back to a sampled one."""
        at, steps, k = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while True:
            k[open_] = np.searchsorted(self.sampled, at[open_])
            open_ = open_[self.sampled[np.minimum(k[open_], len(self.sampled) - 1)] != at[open_]]
            if not len(open_):
                return self.places[k] + steps
            symbol = self.last[at[open_]]
            at[open_] = self.before[symbol] + self.rank(symbol, at[open_])
            steps[open_] += 1


class Phrases:
    """The distinct windows of the items as rows of vocabulary numbers, filled up with 0 on the left, and the items of each.

    A window takes 4 bytes a word and about 12 more.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                padded = np.concatenate((np.zeros(max(0, window - len(ids)), np.int32), ids))
                rows.append(np.unique(np.lib.stride_tricks.sliding_window_view(padded, window), axis=0))
                owners.append(np.full(len(rows[-1]), number[name], np.int32))
        self.rows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.length = (self.rows > 0).sum(1)
        self.shortest = int(self.length.min(initial=window))
        self.owner = np.concatenate(owners)[np.argsort(which.ravel(), kind="stable")]
        self.owner_at = np.concatenate(([0], np.cumsum(np.bincount(which.ravel(), minlength=len(self.rows)), dtype=np.int64)))


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range [start, start+count): its index, repeated, and its members."""
    which = np.repeat(np.arange(len(start)), count)
    within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, start[which] + within


def occurrences(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase numbers and their places in a shard's vocabulary numbers, where 0 is any other word or a document's end."""
    none = np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= phrases.shortest
    start, size = start[long], (end - start)[long] + 1  # with the 0 that follows
    if not len(start) or not len(phrases.rows):
        return none, none
    _, origin = _spread(start, size)
    index = FmIndex(np.append(ids, 0)[origin])
    low, high = index.search(phrases.rows, phrases.length)
    which, row = _spread(low, np.maximum(high - low, 0))
    return which, origin[index.locate(row)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SHARD rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, SHARD):
            yield batch.slice(start, SHARD)


def _without(text: bytes | None, spans: list[dict]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if text is None:
        return None
    rest, done = [], 0
    at = [m.span() for m in WORD.finditer(text)] if spans else []
    for s in spans:
        rest.append(text[done : at[s["start"]][0]])
        done = at[s["end"] - 1][1]
    return (b"".join(rest) + text[done:]).decode()


def _mark(batches: Iterator[pa.RecordBatch], phrases: Phrases, keep: list[str], cut: bool) -> Iterator[pa.RecordBatch]:
    get = phrases.vocabulary.get
    for batch in _shards(batches):
        texts = batch.column("_text")
        parts, sizes = [], np.zeros(batch.num_rows, np.int64)
        for k in range(batch.num_rows):
            words = words_of(texts[k].as_py())
            sizes[k] = len(words)
            parts.append(np.array([*map(get, words, repeat(0)), 0], np.int32))
        ids = np.concatenate(parts)
        first = np.cumsum(sizes + 1) - sizes - 1
        which, at = occurrences(ids, phrases)
        doc = np.searchsorted(first, at, "right") - 1
        depth = np.zeros(len(ids) + 1, np.int64)
        np.add.at(depth, at, 1)
        np.add.at(depth, at + phrases.length[which], -1)
        had = batch.column("_spans").to_pylist()
        for k, spans in enumerate(had):
            for s in spans or ():
                depth[first[k] + s["start"]] += 1
                depth[first[k] + s["end"]] -= 1
        hit = np.cumsum(depth[:-1]) > 0
        edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        home = np.searchsorted(first, start, "right") - 1
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for k, s, e in zip(home.tolist(), (start - first[home]).tolist(), (end - first[home]).tolist(), strict=True):
            spans[k].append({"start": s, "end": e})
        items: list[list[str]] = [list(x or ()) for x in batch.column("_items").to_pylist()]
        one, owner = _spread(phrases.owner_at[which], phrases.owner_at[which + 1] - phrases.owner_at[which])
        for k, item in np.unique(np.stack((doc[one], phrases.owner[owner])), axis=1).T.tolist() if len(one) else ():
            items[k].append(phrases.names[item])
        left = pa.array([_without(texts[k].as_py(), x) for k, x in enumerate(spans)], pa.string()) if cut else pa.nulls(batch.num_rows, pa.string())
        yield with_columns(batch, [*keep, "_text"], {
            "_left": left,
            "_n": pa.array(sizes, pa.int64()),
            "_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "_items": pa.array(items, pa.list_(pa.string())),
        })


def benchmark_spans(docs: DataFrame, items: DataFrame, window: int = 13, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20, cut: bool = False) -> DataFrame:
    """The kept columns, n_words, n_hit, spans array<struct<start,end>> (merged word spans, end exclusive), items array<string>.

    With `cut` also `left`, the text without its spans.  The driver and each task hold the phrases of one block of items, of
    about block_bytes, at a time; each block is one pass over the documents, without a shuffle, and all passes but the
    last are written to the shared folder, so that their phrases can go.
    """
    modest_batches(docs.sparkSession)
    keep = list(keep)
    items = written(items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("name"), F.col(item_text).cast("binary").alias("text")), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    out = docs.select(*keep, F.col(text).cast("binary").alias("_text"), F.lit(None).cast("string").alias("_left"), F.lit(0).cast("long").alias("_n"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("_spans"), F.expr("cast(array() as array<string>)").alias("_items"))
    kind = fields(docs, keep, "_text binary, _left string, _n bigint, _spans array<struct<start:bigint,end:bigint>>, _items array<string>")
    past = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block).collect()
        phrases, last = Phrases([(r["name"], bytes(r["text"])) for r in rows], window), block == blocks - 1
        out = out.mapInArrow(lambda batches, phrases=phrases, last=last: _mark(batches, phrases, keep, cut and last), kind)
        if not last:
            done, out = past, written(out, "marked")
            past = out
            if done is not None:
                discard(done)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    left = [F.col("_left").alias("left")] if cut else []
    return out.select(*keep, F.col("_n").alias("n_words"), hit.alias("n_hit"), F.col("_spans").alias("spans"), F.array_sort(F.array_distinct("_items")).alias("items"), *left)


def contaminated(n_hit, n_words):
    """Any hit, and at least a twentieth of the words hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """Documents that aren't contaminated, with their columns; the spans that they share with items are cut out.

    Null and empty texts stay as they are; without items all documents stay; rows that repeat are treated alike.
    """
    rows, names = hidden(docs)
    keep = tuple(h for c, h in names.items() if c != "text")
    found = benchmark_spans(rows, items, window, keep, text=names["text"], cut=True)
    return shown(found.where(~contaminated(F.col("n_hit"), F.col("n_words"))), names, text=F.col("left"))
