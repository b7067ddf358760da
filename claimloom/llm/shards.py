"""Sharding as one exact uniform shuffle, in DataFrame operations only.

Rows fall into partitions by a hash.  A communication matrix of partition-to-shard counts is drawn row by row from the
multivariate hypergeometric law, so its row sums are the partitions' sizes and its column sums the shards' exact sizes.
Each partition permutes its rows and deals them out by its matrix row; after the exchange each shard permutes again.

Only ids, sizes and checksums are shuffled, never texts.  Partitions and the buckets of a shard grow in number with
the rows, so no window holds more than about `rows_per_group` rows.

Defined results: a null text counts as empty; a null id is a value like any other; rows that repeat get slots of their
own; an empty table gives an empty result; columns other than the id and the text play no part.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import small, written

#: Fewest partitions of the first permutation, and buckets of each shard in the second.
PARTITIONS, BUCKETS = 64, 8


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Good ones among `drawn` of good + bad: inversion outward from the mode."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p_up = p_down = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    left = rng.random() - p_up
    up = down = mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """A random matrix of counts with these row and column sums, as a uniform shuffle would give."""
    rng, free, out = random.Random(seed), list(columns), []
    for row in rows:
        line, rest = [], sum(free)
        for k, own in enumerate(free):
            rest -= own
            n = hypergeometric(rng, own, rest, row)
            line.append(n)
            free[k] -= n
            row -= n
        out.append(line)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 1, id_col: str = "doc_id", text: str = "text", rows_per_group: int = 1_000_000) -> DataFrame:
    """One row for each document: its id, size (bytes of the text plus 16), text_crc32, shard and slot in the shard."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("_id"), (F.octet_length(body) + F.lit(16)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    narrow = written(narrow, "shards")
    rows = narrow.count()
    parts = max(PARTITIONS, -(-rows // rows_per_group))
    buckets = max(BUCKETS, -(-rows // (shards * rows_per_group)))
    drawn = lambda salt: F.xxhash64(F.lit(f"{seed}:{salt}"), "_id", "text_crc32", "size")
    keyed = narrow.withColumn("_part", F.pmod(drawn("part"), F.lit(parts)))
    counts = {r["_part"]: r["count"] for r in keyed.groupBy("_part").count().collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shard_sizes(rows, shards), seed)
    bounds = []
    for p, line in enumerate(matrix):
        total, upto = 0, []
        for n in line:
            upto.append(total := total + n)
        bounds.append((p, upto))
    dealt = written(spark.createDataFrame(bounds, "_part long, _upto array<long>"), "matrix")
    local = Window.partitionBy("_part").orderBy(drawn("first"), "_id", "text_crc32", "size")
    placed = (
        keyed.withColumn("_at", F.row_number().over(local) - 1)
        .join(small(dealt), "_part")
        .withColumn("shard", F.size(F.filter("_upto", lambda n: n <= F.col("_at"))))
        .select("_id", "size", "text_crc32", "shard", F.pmod(drawn("bucket"), F.lit(buckets)).alias("_bucket"))
    )
    placed = written(placed, "placed")
    before = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = written(before.select("shard", "_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before")), "before")
    again = Window.partitionBy("shard", "_bucket").orderBy(drawn("second"), "_id", "text_crc32", "size")
    return (
        placed.withColumn("_at", F.row_number().over(again) - 1)
        .join(small(before), ["shard", "_bucket"])
        .select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_before") + F.col("_at")).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 1) -> None:
    """The documents themselves as Parquet, a folder for each shard, rows in slot order within each file."""
    placed = shuffle_into_shards(docs, shards, seed).select("doc_id", F.col("text_crc32").alias("_crc"), "shard", "slot")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    keys = ["doc_id", "_crc"]
    pick = Window.partitionBy(*keys).orderBy("slot")
    twin = Window.partitionBy(*keys).orderBy("doc_id")
    numbered = docs.withColumn("_crc", crc).withColumn("_twin", F.row_number().over(twin))
    placed = placed.withColumn("_twin", F.row_number().over(pick))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*keys, "_twin"]]
    rows = numbered.alias("d").join(placed.alias("p"), same[0] & same[1] & same[2]).select(*[F.col(f"d.{c}") for c in docs.columns], "p.shard", "p.slot")
    rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
