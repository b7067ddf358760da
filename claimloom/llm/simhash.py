"""SimHash near-duplicates by a binary trie joined with itself.

Fingerprints, most significant bit first, form a binary trie.  The join walks pairs of nodes: a pair's children are the
four pairs of sub-nodes, a pair whose bits differ carries one more error, and a pair with more errors than the budget is
pruned.  The walk's top, down to subtries of at most `leaf` fingerprints, is planned from counts; each pair of subtries
that is left goes to one of the two as home.  A home walks its pairs level by level as arrays, compares the few
fingerprints in small nodes directly, and returns a spanning forest of its links, so groups of near copies never turn
into all their pairs.

Defined results: a null text counts as empty; an empty text has fingerprint zero and links like any other; documents
with equal fingerprints are linked; rows that repeat an id count as one document for each text and give one result row
each; rows with null ids take no part in groups (their component is null); an empty table gives an empty result; ids are
whole numbers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import fields, hidden, meet, modest_batches, release, rows_of, shown, small, with_columns, written
from claimloom.llm.components import components

#: The seed of a shingle's XXH64.
SEED = 42
#: Node pairs with at most so many pairs of fingerprints are compared directly.
DIRECT = 64
#: Node pairs that the walk holds at a level; more are walked in halves, one after the other.
FRONT = 1 << 16
#: Fingerprints of a leaf of the planned top, leaves that it has at most (about twice as many), rows that a home holds.
LEAF, LEAVES, MOST_ROWS = 1 << 17, 2048, 1 << 22


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, repeats included; of the whole sequence if it is shorter."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, SEED)], np.uint64)
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])], np.uint64)  # noqa: B905


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each column of hashes(n, m): the bits that are set in over half the rows, as bytes, most significant first."""
    total = np.zeros(hashes.shape[1] * 64, np.int64)
    for start in range(0, len(hashes), 255):  # so that bytes hold the sums
        some = hashes[start : start + 255].astype(">u8")
        total += np.add.reduce(np.unpackbits(some.view(np.uint8).reshape(len(some), -1), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes))


def mixed(hashes: np.ndarray, many: int) -> np.ndarray:
    """Column 0 holds the hashes, further columns hold hashes derived from them."""
    out = np.empty((len(hashes), many), np.uint64)
    out[:, 0] = hashes
    with np.errstate(over="ignore"):
        for k in range(1, many):
            x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = x ^ (x >> np.uint64(31))
    return out


def _sign(batches: Iterator[pa.RecordBatch], keep: list[str], words: int, many: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = batch.column("_text"), []
        for k in range(batch.num_rows):
            hashes = shingle_hashes(texts[k].as_py(), words)
            out.append(majority(mixed(hashes, many)).tobytes() if len(hashes) else bytes(8 * many))
        yield with_columns(batch, keep, {"signature": pa.array(out, pa.binary())})


def signatures(docs: DataFrame, words: int = 3, many: int = 1, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and `signature`: many * 8 bytes, the first 8 of which are the fingerprint."""
    modest_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(lambda batches: _sign(batches, list(keep), words, many), fields(docs, list(keep), "signature binary"))


# --- the walk within one home ---------------------------------------------------------------------------------------


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _pairs(a_low, a_n, b_low, b_n):
    """All index pairs of small ranges."""
    many = a_n * b_n
    which = np.repeat(np.arange(len(many)), many)
    within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    return a_low[which] + within // b_n[which], b_low[which] + within % b_n[which]


def trie_links(prints: np.ndarray, roots: list[tuple[int, int, int, int]], bits: int, budget: int, exact: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted, distinct fingerprints below the given pairs of ranges that agree in the `exact` leading bits and differ in at most `budget` others."""
    table = np.uint64(min(63, bits - exact))
    front = np.array(roots, np.int64).reshape(-1, 4)
    counts: dict[int, np.ndarray] = {}

    def ones(level: int) -> np.ndarray:
        """How many fingerprints before each have this bit."""
        if level not in counts:
            counts[level] = np.concatenate(([0], np.cumsum((prints >> np.uint64(level)) & np.uint64(1), dtype=np.int32)))
        return counts[level]

    work = [(bits, front, np.zeros(len(front), np.int8), (front[:, 0] == front[:, 2]) & (front[:, 1] == front[:, 3]))]
    while work:
        level, front, errors, same = work.pop()
        if len(front) > FRONT:
            half = len(front) // 2
            work += [(level, front[half:], errors[half:], same[half:]), (level, front[:half], errors[:half], same[:half])]
            continue
        a0, a1, b0, b1 = front.T
        direct = ((a1 - a0) * (b1 - b0) <= DIRECT) | (level == 0)
        if direct.any():
            for some in np.array_split(np.flatnonzero(direct), 1 + int(direct.sum()) * DIRECT // (1 << 19)):
                x, y = _pairs(a0[some], (a1 - a0)[some], b0[some], (b1 - b0)[some])
                fine = (x < y) & (_differ(prints[x], prints[y]) <= budget)
                if exact:
                    fine &= prints[x] >> table == prints[y] >> table
                if fine.any():
                    yield x[fine], y[fine]
            front, errors, same = front[~direct], errors[~direct], same[~direct]
            a0, a1, b0, b1 = front.T
        if not len(front):
            continue
        level -= 1
        before = ones(level)
        a_mid, b_mid = a1 - (before[a1] - before[a0]), b1 - (before[b1] - before[b0])
        less, more = np.stack((a0, a_mid, b0, b_mid), 1), np.stack((a_mid, a1, b_mid, b1), 1)
        up, down = np.stack((a0, a_mid, b_mid, b1), 1), np.stack((a_mid, a1, b0, b_mid), 1)
        cost = 1 if level < bits - exact else budget + 1
        front = np.concatenate((less, more, up, down[~same]))
        errors = np.concatenate((errors, errors, errors + cost, errors[~same] + cost))
        same = np.concatenate((same, same, np.zeros(len(up) + int((~same).sum()), bool)))
        left = (errors <= budget) & (front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3])
        if left.any():
            work.append((level, front[left], errors[left], same[left]))


class Forest:
    """Union of array links; the smallest index of a tree is its root."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.root[x], self.root[y]
            open_ = a != b
            if not open_.any():
                return
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return child, self.root[child]


# --- the plan over the trie's top -----------------------------------------------------------------------------------


def leaves(prints: DataFrame, leaf: int, bits: int) -> list[tuple[int, int]]:
    """(first fingerprint, depth) of the subtries with at most `leaf` fingerprints, in order, for prints(_print long).

    Counts come by 4 more bits at a time, below crowded nodes only, so at most 16 * rows / leaf counts a step reach the driver.
    """
    crowded, out = {0: 0}, []
    sign = 1 << 63
    for depth in range(0, bits, 4):
        step = min(4, bits - depth)
        shift = bits - depth - step
        prefix = F.shiftrightunsigned("_print", shift)
        rows = prints
        if depth:
            above = [k - (1 << 64) if k >= sign else k for k in crowded]
            listed = prints.sparkSession.createDataFrame([(k,) for k in above], "_above long")
            rows = prints.join(F.broadcast(listed), F.shiftrightunsigned("_print", shift + step) == F.col("_above"), "left_semi")
        counts = {r[0] & ((1 << 64) - 1): r[1] for r in rows.groupBy(prefix.alias("p")).agg(F.count("*")).collect()}
        coming: dict[int, int] = {}
        for top in crowded:
            nodes = [(top, 0)]
            while nodes:
                node, down = nodes.pop()
                first = node << (step - down)
                held = sum(counts.get(k, 0) for k in range(first, first + (1 << (step - down))))
                if held <= leaf or depth + down == bits:
                    if held:
                        out.append((node << (bits - depth - down), depth + down))
                elif down == step:
                    coming[node] = 0
                else:
                    nodes += [(2 * node, down + 1), (2 * node + 1, down + 1)]
        crowded = coming
        if not crowded:
            break
    return sorted(out)


def leaf_pairs(tops: list[tuple[int, int]], bits: int, budget: int, exact: int = 0) -> list[tuple[int, int]]:
    """Pairs of leaves, by number, that the pruned walk from the root reaches; each leaf pairs with itself."""
    starts = [first for first, _ in tops]

    def holds(node: int, depth: int) -> tuple[bool, int | None]:
        """Whether a node lies within one leaf or holds none, and that leaf."""
        low, high = bisect_left(starts, node << (bits - depth)), bisect_left(starts, (node + 1) << (bits - depth))
        if low == high:
            return True, _holder(tops, node << (bits - depth), bits)
        return high - low == 1 and tops[low][1] <= depth, low

    out, stack = [], [(0, 0, 0, 0)]
    while stack:
        x, y, depth, errors = stack.pop()
        (one_x, a), (one_y, b) = holds(x, depth), holds(y, depth)
        if a is None or b is None:
            continue
        if one_x and one_y:
            out.append((min(a, b), max(a, b)))
            continue
        for i, j in ((0, 0), (1, 1), (0, 1), (1, 0)):
            if errors + (i != j) <= budget and not (x == y and i > j) and (i == j or depth >= exact):
                stack.append((2 * x + i, 2 * y + j, depth + 1, errors + (i != j)))
    return sorted(set(out))


def _holder(tops: list[tuple[int, int]], first: int, bits: int) -> int | None:
    """The leaf that a fingerprint falls into."""
    k = bisect_right(tops, (first, bits + 1)) - 1
    return k if k >= 0 and tops[k][0] >> (bits - tops[k][1]) == first >> (bits - tops[k][1]) else None


def _homes(pairs: np.ndarray) -> np.ndarray:
    """Which leaf of each pair walks it."""
    return np.where((pairs[:, 0] * 31 + pairs[:, 1] * 17) % 2 == 0, pairs[:, 0], pairs[:, 1])


def _deal(batches: Iterator[pa.RecordBatch], starts: np.ndarray, pairs: np.ndarray, parts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Each row to its own leaf as home and to the other homes of its leaf's pairs.

    A home of `parts` has that many parts: a row's `_salt` names one, and it goes to every pair of parts that holds it.
    """
    home = _homes(pairs)
    at = np.unique(np.concatenate((np.stack((pairs[:, 0], home), 1), np.stack((pairs[:, 1], home), 1))), axis=0)
    first = np.searchsorted(at[:, 0], np.arange(len(starts) + 1))
    many_parts = np.ones(len(starts), np.int64)
    for k, n in parts.items():
        many_parts[k] = n
    for batch in batches:
        prints = batch.column("_print").to_numpy(zero_copy_only=False).view(np.uint64)
        own = np.searchsorted(starts, prints, "right") - 1
        many = first[own + 1] - first[own]
        row = np.repeat(np.arange(len(own)), many)
        goes = at[np.repeat(first[own], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many), 1]
        split = many_parts[goes]
        salt = batch.column("_salt").to_numpy(zero_copy_only=False) if "_salt" in batch.schema.names else np.zeros(batch.num_rows, np.int64)
        part = salt[row] % split
        twice = np.repeat(np.arange(len(row)), split)
        other = np.arange(len(twice)) - np.repeat(np.cumsum(split) - split, split)
        low, high = np.minimum(part[twice], other), np.maximum(part[twice], other)
        row, goes = row[twice], goes[twice]
        piece = low * many_parts[goes] + high
        columns = [pa.array(goes, pa.int64()), pa.array(piece, pa.int64()), pa.array(own[row], pa.int64())] + [c.take(pa.array(row)) for c in batch.columns]
        yield pa.RecordBatch.from_arrays(columns, ["_home", "_piece", "_leaf", *batch.schema.names])


class Partners:
    """For each fingerprint the least, the last smaller and the nearest partner."""

    def __init__(self, prints: np.ndarray) -> None:
        n = len(prints)
        self.prints, self.least, self.last = prints, np.full(n, n), np.full(n, -1)
        self.nearest, self.bits = np.full(n, -1), np.full(n, 65)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        np.minimum.at(self.least, y, x)
        np.maximum.at(self.last, y, x)
        differ = _differ(self.prints[x], self.prints[y])
        for a, b in ((x, y), (y, x)):
            order = np.argsort(differ, kind="stable")
            one, where = np.unique(a[order], return_index=True)
            best = order[where]
            closer = differ[best] < self.bits[one]
            self.bits[one[closer]], self.nearest[one[closer]] = differ[best[closer]], b[best[closer]]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        n = np.arange(len(self.prints))
        both = np.concatenate([np.stack((n[fine], to[fine]), 1) for to, fine in ((self.least, self.least < len(n)), (self.last, self.last >= 0), (self.nearest, self.nearest >= 0))])
        both = np.unique(np.sort(both, axis=1), axis=0)
        return both[:, 1], both[:, 0]


def _order(group: pa.Table, *by: str) -> pa.Table:
    return group.take(pa.array(np.lexsort([group.column(c).to_numpy().view(np.uint64) for c in reversed(by)])))


def _met(group: pa.Table, pairs: np.ndarray, bits: int, budget: int, exact: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The distinct fingerprints of a home, of rows in their order, and the pairs of them that link."""
    home = group.column("_home")[0].as_py()
    prints, first = np.unique(group.column("_print").to_numpy().view(np.uint64), return_index=True)
    leaf = group.column("_leaf").to_numpy()[first]
    bounds = lambda k: (int(np.searchsorted(leaf, k)), int(np.searchsorted(leaf, k, "right")))
    roots = [(*bounds(a), *bounds(b)) for a, b in pairs[_homes(pairs) == home]]
    roots = [r for r in roots if r[0] < r[1] and r[2] < r[3]]
    return prints, trie_links(prints, roots, bits, budget, exact)


def _linked(group: pa.Table, met, forest: bool) -> pa.Table:
    group = _order(group, "_print")
    prints, links = met(group)
    found = Forest(len(prints)) if forest else Partners(prints)
    for x, y in links:
        found.add(x, y)
    child, parent = found.links()
    rep = group.column("_rep").to_numpy()
    return pa.table({"a": pa.array(rep[child], pa.int64()), "b": pa.array(rep[parent], pa.int64())})


def print_links(prints: DataFrame, bits: int = 64, budget: int = 2, exact: int = 0, forest: bool = True, leaf: int = LEAF, most_rows: int = MOST_ROWS) -> DataFrame:
    """Links (a, b) between the `_rep`s of prints(_print long, _rep long), from written(), one row for each fingerprint.

    With `forest` they span all links; without, each fingerprint is linked to its least, last smaller and nearest partner.
    The plan on the driver has at most about 2 * LEAVES leaves: beyond leaf * LEAVES fingerprints leaves grow, and a home
    of more than `most_rows` rows falls into parts by `_salt`, each pair of which is a home of its own.
    """
    tops = leaves(prints, max(leaf, rows_of(prints) // LEAVES), bits)
    if not tops:
        return prints.sparkSession.createDataFrame([], "a long, b long")
    pairs = np.array(leaf_pairs(tops, bits, budget, exact), np.int64).reshape(-1, 2)
    starts = np.array([first for first, _ in tops], np.uint64)
    rows = prints.select("_print", "_rep", F.expr("xxhash64(_print) & 9223372036854775807").alias("_salt"))
    kind = "_home long, _piece long, _leaf long, _print long, _rep long, _salt long"
    deal = lambda parts: rows.mapInArrow(lambda batches: _deal(batches, starts, pairs, parts), kind)
    crowded = deal({}).groupBy("_home").count().where(F.col("count") > most_rows).collect()
    parts = {r[0]: -(-2 * r[1] // most_rows) for r in crowded}
    met = lambda group: _met(group, pairs, bits, budget, exact)
    return deal(parts).groupBy("_home", "_piece").applyInArrow(lambda group: _linked(group, met, forest), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2, leaf: int = LEAF) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (smallest doc_id reachable)."""
    spark = docs.sparkSession
    signed = signatures(docs.select("doc_id", "text"), words)
    number = F.conv(F.hex("signature"), 16, -10).cast("long")
    signed = written(signed.select("doc_id", number.alias("_print")), "signed")
    prints = written(signed.where(F.col("doc_id").isNotNull()).groupBy("_print").agg(F.min("doc_id").alias("_rep"), F.count("*").alias("many")), "prints")
    release(spark)
    roots = components(print_links(prints, 64, budget, leaf=leaf))
    grouped = written(prints.join(small(roots), prints["_rep"] == roots["node"], "left").select("_print", F.coalesce("root", "_rep").alias("component_id"), "many"), "grouped")
    full = meet(signed.where(F.col("doc_id").isNotNull()), grouped, ["_print"], "many").select("doc_id", "_print", "component_id").unionByName(signed.where(F.col("doc_id").isNull()).withColumn("component_id", F.lit(None).cast("long")))
    return full.select("doc_id", F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, with their columns, without all but the smallest id of each group of near copies (`jaccard`).

    Of rows that repeat an id the first by text, then by the other columns as JSON, is the document; rows with a null id
    stay.  A null text counts as empty, and of all empty texts one stays; an empty table gives an empty result.
    """
    from claimloom.llm import jaccard

    rows, names = hidden(docs)
    key, text = names["doc_id"], names["text"]
    if not rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty():
        order = Window.partitionBy(key).orderBy(F.col(text).asc_nulls_first(), F.to_json(F.struct(*names.values())))
        rows = written(rows.withColumn("_n", F.row_number().over(order)).where(F.col(key).isNull() | (F.col("_n") == 1)).drop("_n"), "first")
    gone = written(jaccard.near_copies(rows.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), words, similarity).select("doc_id"), "gone")
    return shown(rows.join(small(gone), rows[key] == gone["doc_id"], "left_anti"), names)
