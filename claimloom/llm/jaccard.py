"""Near copies: SimHash tries propose, a prefix-filtered set join completes, whole shingle sets decide.

Documents are their sets of distinct word shingles; two are linked if the Jaccard similarity of the sets is at least the
wanted one.  Each set has a SimHash signature of 64 * MANY bits, cut into fingerprints of KEY bits.  The binary trie join
of `simhash`, with the fingerprint's number as leading bits that must agree, finds the fingerprints that differ in at most
BITS bits; their sets are candidates if the whole signatures differ in no more bits than `most_bits` allows.

What estimates miss is found by set: every set is put in one global order, rarer shingles first; two sets of at least the
wanted similarity share one of the first n - ceil(similarity * n) + 1 shingles of either, so only sets that share such a
shingle, have sizes that allow it, have enough shingles left from there on and aren't in one group yet are candidates, if the counts
of their shingles in 256 buckets allow it as well.  The order takes the counts of all shingles of all documents, summed in buckets of their
hashes; any order that is the same for all sets gives the same links, a good one has few candidates.  Each candidate of either kind is held
against both whole sets.

Large groups don't turn into all their pairs: the trie links each fingerprint to three others, the next rounds hold the
members of a shingle against one of them, and the last one only pairs members that are still in different groups.

Defined results: a null text counts as empty; empty texts are near copies of each other and of nothing else; a text of
`words` words or fewer is one shingle; rows that repeat an id count as one document for each text; rows with null ids take
no part; an empty table gives an empty result; ids are whole numbers.  Shingles are compared by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import discard, meet, modest_batches, release, small, written
from claimloom.llm.components import components
from claimloom.llm.simhash import majority, mixed, print_links, shingle_hashes

#: Signatures of MANY * 64 bits, cut into fingerprints of KEY bits; those of the trie's candidates differ in BITS bits at most.
MANY, KEY, BITS = 8, 32, 2
#: Leading bits of a shingle that name the bucket in which it is counted, and the buckets of one row of counts.
COUNTED, RUN = 20, 1 << 10
#: Buckets of a sketch, which counts a set's shingles by their leading bits, and the most shingles of a set that has one.
BUCKETS, SKETCHED = 256, 20_000
#: Rounds that hold the members of a shingle against one of them.
STARS = 1


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def most_bits(similarity: float, bits: int) -> int:
    """Bits that signatures of sets of equal size and this similarity differ in on average, and three deviations more."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + 3 * np.sqrt(bits * p * (1 - p)))


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNTED)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """run, counts: a partition's counts of shingles by bucket, RUN buckets a row, without rows of zeros."""
    total = np.zeros(1 << COUNTED, np.int64)
    for batch in batches:
        for text in batch.column("_text"):
            np.add.at(total, _bucket(shingle_set(text.as_py(), words)), 1)
    rows = total.reshape(-1, RUN)
    runs = np.flatnonzero(rows.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array([rows[k].tobytes() for k in runs], pa.binary())], ["run", "counts"])


def _summed(group: pa.Table) -> pa.Table:
    total = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.int64).reshape(-1, RUN).sum(0)
    return pa.table({"run": group.column("run").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each bucket, as bytes; nothing for sets whose counts may not fit."""
    counts = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.uint8).tobytes() if len(shingles) <= SKETCHED and counts.max(initial=0) < 256 else b""


def _possible(batches: Iterator[pa.RecordBatch], share: Fraction) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow the similarity: sets share at most the lesser count of each bucket."""
    for batch in batches:
        fine = np.ones(batch.num_rows, bool)
        x, y = (batch.column(c).to_pylist() for c in ("_x", "_y"))
        both = np.flatnonzero([bool(a) and bool(b) for a, b in zip(x, y, strict=True)])
        if len(both):
            a, b = (np.frombuffer(b"".join(side[k] for k in both), np.uint8).reshape(len(both), BUCKETS).astype(np.int64) for side in (x, y))
            most, total = np.minimum(a, b).sum(1), a.sum(1) + b.sum(1)
            fine[both] = most * (share.numerator + share.denominator) >= total * share.numerator
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fine))


def _signed(batches: Iterator[pa.RecordBatch], words: int, share: Fraction, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id; digest, size and signature of its set; the first shingles in the global order."""
    for batch in batches:
        sets = [shingle_set(text.as_py(), words) for text in batch.column("_text")]
        heads = []
        for one in sets:
            least = -(-share.numerator * len(one) // share.denominator)
            heads.append(one[np.argsort(counts[_bucket(one)], kind="stable")[: len(one) - least + 1]].view(np.int64))
        signatures = [majority(mixed(one, MANY)).tobytes() if len(one) else bytes(8 * MANY) for one in sets]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(one.tobytes()) for one in sets], pa.binary()), pa.array([len(one) for one in sets], pa.int64()),
            pa.array(signatures, pa.binary()), pa.array(heads, pa.list_(pa.int64())), pa.array([_sketch(one) for one in sets], pa.binary())], ["doc_id", "_key", "n", "_signature", "_head", "_sketch"])


def _wanted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The sets of the documents whose digest is the wanted one."""
    for batch in batches:
        sets = [shingle_set(t.as_py(), words) for t in batch.column("_text")]
        fine = [k for k, one in enumerate(sets) if xxhash.xxh3_128_digest(one.tobytes()) == batch.column("_key")[k].as_py()]
        rows = pa.array(fine, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("node").take(rows), batch.column("many").take(rows), pa.array([sets[k].tobytes() for k in fine], pa.binary())], ["node", "many", "_set"])


def _similar(batches: Iterator[pa.RecordBatch], share: Fraction) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fine = []
        for x, y in zip(batch.column("_x"), batch.column("_y"), strict=True):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            fine.append(both * share.denominator >= (len(x) + len(y) - both) * share.numerator)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fine, pa.bool_()))


def _near(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("_x", "_y"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most))


def shingle_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many shingles of the sets of all documents fall into each bucket: never less than the documents that have one of its shingles."""
    rows = docs.select("_text").mapInArrow(lambda batches: _counted(batches, words), "run long, counts binary")
    sums = rows.groupBy("run").applyInArrow(_summed, "run long, counts binary").toArrow()
    total = np.zeros(((1 << COUNTED) // RUN, RUN), np.int64)
    for run, counts in zip(sums.column("run").to_pylist(), sums.column("counts").to_pylist(), strict=True):
        total[run] = np.frombuffer(counts, np.int64)
    return total.reshape(-1)


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of documents that aren't the smallest of their group.

    Two documents are linked if the Jaccard similarity of their distinct shingles is `similarity` or more; groups are
    the connected components of all such links.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    share = Fraction(str(similarity))
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    counts = shingle_counts(texts, words)
    kind = "doc_id long, _key binary, n long, _signature binary, _head array<long>, _sketch binary"
    signed = written(texts.mapInArrow(lambda batches: _signed(batches, words, share, counts), kind).withColumn("uid", F.monotonically_increasing_id()), "signed")
    # One row stands for all that have the same set.
    nodes = written(signed.groupBy("_key").agg(F.min("uid").alias("node"), F.min("doc_id").alias("_rep"), F.count("*").alias("copies")), "nodes")
    ones = signed.join(small(nodes).select("node"), signed["uid"] == nodes["node"])

    def kept(column: str):
        return lambda many, end, name: signed.select(F.col("uid").alias(end), F.col(column).alias(name)).join(small(many), end)

    def sets_of(many: DataFrame, end: str, name: str) -> DataFrame:
        """Made again from the texts, as few documents are candidates and all sets are larger than all texts."""
        wanted = written(nodes.join(small(many), nodes["node"] == many[end]).select("node", "_rep", "_key", "many"), "wanted")
        rows = texts.join(small(wanted), texts["doc_id"] == wanted["_rep"]).select("node", "many", "_key", "_text")
        held = rows.mapInArrow(lambda batches: _wanted(batches, words), "node long, many long, _set binary")
        return held.groupBy(F.col("node").alias(end)).agg(F.first("many").alias("many"), F.first("_set").alias(name))

    def tested(pairs: DataFrame, of, test) -> DataFrame:
        """The distinct pairs(a, b) of nodes whose signatures, sketches or sets pass the test."""
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        ends = [written(pairs.groupBy(end).agg(F.count("*").alias("many")), "ends") for end in ("a", "b")]
        x, y = (written(of(many, end, name), "sides") for many, end, name in zip(ends, ("a", "b"), ("_x", "_y"), strict=True))
        both = meet(meet(pairs, x, ["a"], "many").drop("many"), y, ["b"], "many").select("a", "b", "_x", "_y")
        out = written(both.mapInArrow(test, "a long, b long"), "links")
        discard(pairs, *ends, x, y)
        release(spark)
        return out

    alike = lambda pairs: tested(pairs, sets_of, lambda batches: _similar(batches, share))
    tables, most = MANY * 64 // KEY, most_bits(similarity, MANY * 64)
    lead = (tables - 1).bit_length()
    part = lambda t: F.conv(F.hex(F.substring("_signature", t * KEY // 8 + 1, KEY // 8)), 16, 10).cast("long") + F.lit(t << KEY)
    keys = ones.select("node", F.explode(F.array(*[part(t) for t in range(tables)])).alias("_print"))
    prints = written(keys.groupBy("_print").agg(F.min("node").alias("_rep"), F.count("*").alias("many")), "prints")
    equal = meet(keys, written(prints.where("many > 1"), "equal"), ["_print"], "many").select(F.col("node").alias("a"), F.col("_rep").alias("b")).where("a <> b")
    tried = print_links(prints, KEY + lead, BITS, lead, forest=False)
    found = alike(tested(equal.unionByName(tried), kept("_signature"), lambda batches: _near(batches, most)))
    release(spark)
    heads = ones.select("node", F.col("n").cast("int").alias("n"), F.posexplode("_head").alias("i", "token"))
    shared = written(heads.groupBy("token").agg(F.count("*").alias("many")).where("many > 1"), "tokens")
    met = written(meet(heads, shared, ["token"], "many").drop("many"), "met")
    release(spark)
    p, q = share.numerator, share.denominator
    left = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    able = (F.least("n", "m") * q >= F.greatest("n", "m") * p) & (left * (p + q) >= (F.col("n") + F.col("m")) * p)
    for turn in range(STARS + 1):
        roots = components(found)
        now = written(met.join(small(roots), met["node"] == roots["node"], "left").select(met["token"], met["node"], "n", "i", F.coalesce("root", met["node"]).alias("root")), "now")
        several = written(now.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many")).where("low <> high").select("token", "many"), "several")
        open_ = written(meet(now, several, ["token"], "many"), "open")
        discard(now)
        if turn < STARS:
            pick = F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "i", "root")
            hubs = open_.groupBy("token").agg(F.min(pick).alias("hub"), F.count("*").alias("many"))
            hubs = written(hubs.select("token", F.col("hub.node").alias("b"), F.col("hub.n").alias("m"), F.col("hub.i").alias("j"), F.col("hub.root").alias("root_b"), "many"), "hubs")
            pairs = meet(open_.drop("many").withColumnRenamed("node", "a"), hubs, ["token"], "many").where("a <> b")
        else:
            others = open_.select("token", F.col("node").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("root_b"))
            pairs = open_.withColumnRenamed("node", "a").join(others, "token").where("a < b")
        possible = tested(pairs.where(F.col("root") != F.col("root_b")).where(able), kept("_sketch"), lambda batches: _possible(batches, share))
        found = written(found.unionByName(alike(possible)), "found")
        discard(open_, several)
        release(spark)
    # Documents are linked by the least ids of their sets.
    rep = lambda node, name: small(nodes).select(F.col("node").alias(node), F.col("_rep").alias(name))
    roots = components(found.join(rep("a", "x"), "a").join(rep("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    grouped = written(nodes.join(small(roots), nodes["_rep"] == roots["node"], "left").select("_key", F.coalesce("root", "_rep").alias("component_id"), "copies"), "grouped")
    return meet(signed.select("doc_id", "_key"), grouped, ["_key"], "copies").select("doc_id", "component_id").where("doc_id <> component_id").distinct()
