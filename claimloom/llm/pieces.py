"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut into units that no piece crosses; the distinct units that aren't known yet are concatenated.
The concatenation's suffixes are sorted as deep as the longest piece is long; every piece is then found by binary search
as a range of suffixes, and each suffix of the range is an edge from its position over the piece's length.  Sorted by
position, the edges make a table that the units are relaxed over.

The model's type decides the relaxation.  A unigram model would take the path of the best total score.  The model here
is a byte-pair one, for which that path is not the encoder's result: its units start as single characters, and the best
scored edge that spans two neighbours, leftmost first, joins them until no such edge is left.  Characters without a piece
fall back to the pieces of their UTF-8 bytes.

The units of a batch that aren't known from earlier ones are indexed together, about TOGETHER characters at a time.  A unit of
more than INDEXED (a text without spaces) is cut where no piece crosses; a part that is still longer is joined by a heap over its
edges.  Units are cut twice, once to find the unknown ones and once to look them up, so that only one text's stand in memory,
besides those of texts of INDEXED characters or more.

Defined results: a null text has null ids, an empty one none; U+2581 in a text counts as a space; rows that repeat are
encoded alike; other columns are passed on only if named in `keep`.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import fields, modest_batches, with_columns

SPACE = "▁"
#: Characters that one suffix array holds at most, and of units that share one; units whose encoding a worker remembers.
INDEXED, TOGETHER, KNOWN = 1 << 18, 1 << 16, 1 << 18
#: Characters of the texts whose units are learnt before any of them is encoded; a longer text is alone.
AHEAD = 1 << 22
#: Units with more characters are joined by a heap, one at a time.
LONG = 64


def model_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) in order of id; types: 1 normal, 2 unknown, 3 control, 6 byte."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    model = format_.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in model.pieces]


class Pieces:
    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.text = [p for p, _, _ in pieces]
        scores = np.array([s for _, s, _ in pieces])
        self.order = np.unique(-scores, return_inverse=True)[1].astype(np.int64)  # least is best; equal scores tie
        normal = [(k, p) for k, (p, _, kind) in enumerate(pieces) if kind == 1]
        self.single = {p: k for k, p in normal if len(p) == 1}
        self.byte = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.unknown = next((k for k, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        self.long = [(k, p) for k, p in normal if len(p) > 1]
        self.depth = max((len(p) for _, p in self.long), default=1)
        self.ids, self.sizes = np.array([k for k, _ in self.long], np.int32), np.array([len(p) for _, p in self.long], np.int64)
        codes = np.zeros((len(self.long), self.depth), np.uint32)
        for row, (_, p) in zip(codes, self.long, strict=True):
            row[: len(p)] = [ord(c) for c in p]
        #: The characters of the long pieces, from 0 for none, and which of them each piece has at each place.
        self.letters, which = np.unique(np.append(codes, np.uint32(0)), return_inverse=True)
        self.spelled = which[:-1].reshape(codes.shape).astype(np.int32)
        joining = {c for _, p in self.long for c in p}
        inner = any(SPACE in p.lstrip(SPACE) for _, p in self.long)
        alone = "".join(c for c in "\n\r\t" if c not in joining)
        cut = re.escape(alone)
        #: Units: spaces and what follows them up to the next space; characters that no longer piece holds are alone.
        self.units = re.compile(f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + (f"|[{cut}]" if cut else ""), re.S) if not inner else re.compile(".+", re.S)
        self.known: dict[str, bytes] = {}
        #: What each piece decodes to: bytes, with spaces for the mark.
        self.decoded = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(SPACE, " ").encode() for p, _, kind in pieces]

    # --- matching ---------------------------------------------------------------------------------------------------

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, length and number of all pieces that stand in a text, from its suffix array."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        alphabet, dense = np.unique(codes, return_inverse=True)
        dense = np.append(dense + 1, np.zeros(self.depth, np.int64)).astype(np.uint64)
        bits = int(len(alphabet) + 1).bit_length()
        per = min(self.depth, 64 // bits)
        keys, n = [], len(codes)
        for start in range(0, self.depth, per):
            key = np.zeros(n, np.uint64)
            for k in range(start, start + per):
                step = dense[k : k + n] if k < self.depth else np.zeros(n, np.uint64)
                key = (key << np.uint64(bits)) | step
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        number = np.searchsorted(alphabet, self.letters)
        number = np.where((self.letters > 0) & (alphabet[np.minimum(number, len(alphabet) - 1)] == self.letters), number + 1, 0).astype(np.int32)
        spelled = number[self.spelled]
        some = np.flatnonzero((spelled > 0).sum(1) == self.sizes)
        spelled, sizes, ids = spelled[some].astype(np.uint64), self.sizes[some], self.ids[some]
        low, high = np.zeros(len(some), np.int64), np.full(len(some), n, np.int64)
        for level, start in enumerate(range(0, self.depth, per)):
            reach = np.flatnonzero((sizes > start) & (low < high))
            part = np.zeros((len(reach), per), np.uint64)
            given = spelled[reach, start : start + per]
            part[:, : given.shape[1]] = given
            first = np.zeros(len(reach), np.uint64)
            for k in range(per):
                first = (first << np.uint64(bits)) | part[:, k]
            open_ = np.maximum(0, per - np.minimum(sizes[reach] - start, per)).astype(np.uint64) * np.uint64(bits)
            last = first | ((np.uint64(1) << open_) - np.uint64(1))
            if not level:
                low[reach], high[reach] = np.searchsorted(keys[0], first), np.searchsorted(keys[0], last, "right")
                continue
            for k, x, y in zip(reach.tolist(), first, last, strict=True):
                inner = keys[level][low[k] : high[k]]
                low[k], high[k] = low[k] + np.searchsorted(inner, x), low[k] + np.searchsorted(inner, y, "right")
        many = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(some)), many)
        at = suffixes[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
        return at, sizes[which], ids[which]

    def edges(self, text: str) -> np.ndarray:
        """edge[position, length]: the piece that stands there, or -1; the table puts the edges in order of position."""
        at, size, piece = self.matches(text)
        edge = np.full((len(text), self.depth + 1), -1, np.int32)
        edge[at, size] = piece
        return edge

    def sliced(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """position * (depth + 1) + length, in order, and number of the pieces in a long text, INDEXED characters at a time."""
        keys, pieces = [], []
        for start in range(0, len(text), INDEXED):
            at, size, piece = self.matches(text[start : start + INDEXED + self.depth])
            own = at < INDEXED
            key = (at[own] + start) * (self.depth + 1) + size[own]
            order = np.argsort(key)
            keys.append(key[order])
            pieces.append(piece[own][order])
        return np.concatenate(keys), np.concatenate(pieces)

    def parts(self, unit: str) -> list[str]:
        """A long unit cut where no piece crosses; its parts are encoded each by itself."""
        keys, _ = self.sliced(unit)
        at, size = np.divmod(keys, self.depth + 1)
        over = np.zeros(len(unit) + 2, np.int32)
        np.add.at(over, at + 1, 1)
        np.add.at(over, at + size, -1)
        cuts = np.flatnonzero(np.cumsum(over[1 : len(unit)]) == 0) + 1
        ends = [0, *cuts.tolist(), len(unit)]
        return [unit[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def joined(self, text: str) -> bytes:
        """The ids of one long unit that can't be cut: a heap over its edges, about 100 bytes a character."""
        keys, pieces = self.sliced(text)
        n, step = len(text), self.depth + 1
        length, before = np.ones(n, np.int32), np.arange(-1, n - 1, dtype=np.int32)

        def edge(p: int, joined: int) -> int:
            k = int(np.searchsorted(keys, p * step + joined))
            return int(pieces[k]) if k < len(keys) and keys[k] == p * step + joined else -1

        # Each entry is a piece's order, its place and its length in one number.
        two = np.flatnonzero(keys % step == 2)
        heap = ((self.order[pieces[two]] * n + keys[two] // step) * step + 2).tolist()
        heapq.heapify(heap)

        def offer(p: int) -> None:
            q = p + int(length[p])
            if q < n and (joined := q + int(length[q]) - p) <= self.depth and (piece := edge(p, joined)) >= 0:
                heapq.heappush(heap, (int(self.order[piece]) * n + p) * step + joined)

        while heap:
            place, joined = divmod(heapq.heappop(heap), step)
            p = place % n
            q = p + int(length[p])
            if not length[p] or q >= n or q + int(length[q]) - p != joined:
                continue
            length[p], length[q] = joined, 0
            if p + joined < n:
                before[p + joined] = p
                offer(p)
            if p:
                offer(int(before[p]))
        out: list[int] = []
        for p in np.flatnonzero(length).tolist():
            out += self._alone(text[p]) if length[p] == 1 else [edge(p, int(length[p]))]
        return np.array(out, np.int32).tobytes()

    # --- relaxation -------------------------------------------------------------------------------------------------

    def relax(self, edge: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the symbols of all units, in order; one best join for each unit and round."""
        n = len(edge)
        length = np.ones(n, np.int64)  # of the symbol that starts here; 0 within one
        unit = np.repeat(np.arange(len(starts)), sizes)
        at = np.flatnonzero(np.repeat((sizes <= LONG) & (sizes > 1), sizes))
        worst = len(self.order) + 1
        while len(at):
            follows = np.append(unit[at[1:]] == unit[at[:-1]], False)
            joined = np.where(follows, length[at] + np.append(length[at[1:]], 0), 0)
            fits = follows & (joined <= self.depth)
            piece = np.where(fits, edge[at, np.where(fits, joined, 0)], -1)
            cost = np.where(piece >= 0, self.order[piece], worst)
            first = np.flatnonzero(np.append(True, unit[at[1:]] != unit[at[:-1]]))
            best = np.minimum.reduceat(cost, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
            open_ = best < worst
            hits = np.flatnonzero((cost == best[group]) & open_[group])
            left = hits[np.append(True, group[hits[1:]] != group[hits[:-1]])] if len(hits) else hits
            length[at[left]] = joined[left]
            length[at[left + 1]] = 0
            stay = open_[group]
            stay[left + 1] = False
            at = at[stay]
        for k in np.flatnonzero(sizes > LONG):
            self._heap(edge, int(starts[k]), int(sizes[k]), length)
        at = np.flatnonzero(length)
        return at, length[at]

    def _heap(self, edge: np.ndarray, start: int, size: int, length: np.ndarray) -> None:
        end = start + size
        before = {p: p - 1 for p in range(start + 1, end)}
        heap: list[tuple[int, int, int]] = []

        def offer(p: int) -> None:
            q = p + int(length[p])
            if q < end and (joined := q + int(length[q]) - p) <= self.depth and (piece := edge[p, joined]) >= 0:
                heapq.heappush(heap, (int(self.order[piece]), p, joined))

        for p in range(start, end - 1):
            offer(p)
        while heap:
            _, p, joined = heapq.heappop(heap)
            q = p + int(length[p])
            if not length[p] or q >= end or q + int(length[q]) - p != joined:
                continue
            length[p], length[q] = joined, 0
            if p + joined < end:
                before[p + joined] = p
                offer(p)
            if p > start:
                offer(before[p])

    # --- texts ------------------------------------------------------------------------------------------------------

    def learn(self, units: list[str]) -> None:
        """Encodes units that aren't known yet, as many as one suffix array holds at a time."""
        if max(map(len, units), default=0) > INDEXED:
            self.known.update((u, self.joined(u)) for u in units if len(u) > INDEXED)
            units = [u for u in units if len(u) <= INDEXED]
        start = 0
        while start < len(units):
            chars, stop = 0, start
            while stop < len(units) and (stop == start or chars + len(units[stop]) < TOGETHER):
                chars += len(units[stop])
                stop += 1
            some = units[start:stop]
            text, sizes = "".join(some), np.array([len(u) for u in some])
            starts = np.cumsum(sizes) - sizes
            edge = self.edges(text)
            at, length = self.relax(edge, starts, sizes)
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)[at]
            chars, char = np.unique(codes, return_inverse=True)
            alone = [self._alone(chr(c)) for c in chars.tolist()]
            many = np.array([len(x) for x in alone])
            flat, first = np.array([i for x in alone for i in x], np.int32), np.cumsum(many) - many
            count = np.where(length > 1, 1, many[char])
            which = np.repeat(np.arange(len(at)), count)
            within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            ids = np.where(length[which] > 1, edge[at, length][which], flat[first[char[which]] + within]).astype(np.int32).tobytes()
            owner = np.searchsorted(starts, at, "right") - 1
            ends = (4 * np.cumsum(np.bincount(owner, count, len(some)).astype(np.int64))).tolist()
            self.known.update((u, ids[x:y]) for u, x, y in zip(some, [0, *ends[:-1]], ends, strict=True))
            start = stop

    def _alone(self, char: str) -> list[int]:
        """The ids of a character that no longer piece covers."""
        one = self.single.get(char)
        return [self.byte.get(b, self.unknown) for b in char.encode()] if one is None else [one]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """32-bit ids of each text."""
        out: list[bytes | None] = []
        while len(out) < len(texts):
            if len(self.known) > KNOWN:
                self.known.clear()
            fresh: set[str] = set()
            chars, stop, long = 0, len(out), {}
            while stop < len(texts) and (stop == len(out) or chars + len(texts[stop] or "") <= AHEAD):
                if texts[stop]:
                    chars += len(texts[stop])
                    units = self.cut(texts[stop])
                    if len(texts[stop]) >= INDEXED:
                        long[stop] = units
                    fresh.update(filterfalse(self.known.__contains__, units))
                stop += 1
            self.learn(list(fresh))
            out += [None if texts[k] is None else b"".join(map(self.known.__getitem__, long.get(k) or self.cut(texts[k]))) for k in range(len(out), stop)]
        return out

    def cut(self, text: str) -> list[str]:
        """The units of a text, those of more than INDEXED characters in their parts."""
        units = self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []
        if len(text) < INDEXED or max(map(len, units)) <= INDEXED:
            return units
        return [p for one in units for p in (self.parts(one) if len(one) > INDEXED else [one])]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _encode(batches: Iterator[pa.RecordBatch], pieces: list, keep: list[str], check: bool, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    import hashlib

    model = Pieces(pieces)
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            batch = whole.slice(start, rows)
            texts = batch.column("_text").to_pylist()
            encoded = model.encode(texts)
            sizes = [len(x or b"") // 4 for x in encoded]
            flat = pa.array(np.frombuffer(b"".join(x or b"" for x in encoded), np.int32))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.append(np.array([x is None for x in encoded], bool), False))
            ids = pa.ListArray.from_arrays(offsets, flat)
            if not check:
                yield with_columns(batch, keep, {"ids": ids})
                continue
            good = [None if x is None else model.decode(np.frombuffer(x, np.int32).tolist()) == t.replace(SPACE, " ") for x, t in zip(encoded, texts, strict=True)]
            yield with_columns(batch, keep, {"n_ids": pa.array(sizes, pa.int64()), "ids_sha256": pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in encoded], pa.string()), "restored": pa.array(good, pa.bool_())})


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and `ids`, array<int>."""
    modest_batches(docs.sparkSession)
    pieces, keep = model_pieces(model), list(keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(lambda batches: _encode(batches, pieces, keep, False), fields(docs, keep, "ids array<int>"))


def encode_digest(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, n_ids, the SHA-256 of the ids as little-endian 32-bit numbers, and whether decoding restores the text."""
    modest_batches(docs.sparkSession)
    pieces, keep = model_pieces(model), list(keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(lambda batches: _encode(batches, pieces, keep, True), fields(docs, keep, "n_ids long, ids_sha256 string, restored boolean"))


def _decode(batches: Iterator[pa.RecordBatch], pieces: list, keep: list[str]) -> Iterator[pa.RecordBatch]:
    model = Pieces(pieces)
    for batch in batches:
        yield with_columns(batch, keep, {"text": pa.array([None if x is None else model.decode(x) for x in batch.column("_ids").to_pylist()], pa.string())})


def decode(encoded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The kept columns and `text`."""
    pieces, keep = model_pieces(model), list(keep)
    return encoded.select(*keep, F.col(ids).alias("_ids")).mapInArrow(lambda batches: _decode(batches, pieces, keep), fields(encoded, keep, "text string"))
