"""Exact top-k search by vector-approximation files.

The vectors are written once, BLOCK to a row: their ids, the approximation (for each component the number of its cell, of
CELLS equal cells between the block's least and greatest value of that dimension, as a byte) and the exact vectors, each a
column of its own.  A component is at most half a cell from its cell's middle, so the inner product with the middles, plus
and minus the query's sizes times half a cell, bounds the exact one.

The queries, a stated set, are taken a batch of `block` at a time, the only ones that the driver holds.  The first scan
reads the approximations alone and gives each query's kth greatest lower bound over all vectors; the second reads exact
vectors only of those whose upper bound reaches it, in the order of these bounds, until the kth exact score is certain.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows whose id
is null; vectors are compared only with vectors of the same length; no row is a candidate for a query with the same id;
rows that repeat an id and vector are one query, those that repeat only the id are queries with rankings of their own, and
as candidates all count; fewer candidates than k give fewer rows; an empty table gives an empty result; other columns play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import rows_of, written

#: Cells of a dimension, vectors of a block.
CELLS, BLOCK = 256, 4096
#: Components are integers floor(SCALE * x).
SCALE = 1024
#: Inner products below this are exact in doubles.
EXACT = 2.0**53
FILE = "size int, ids binary, cells binary, low binary, width binary, exact binary"


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of a vector with all rows of b, exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * len(a)
    if most < EXACT:
        return (b.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    return (b.astype(object) @ a.astype(object)).astype(np.int64)


def approximated(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of integer vectors, the least value of each dimension and the width of its cells."""
    low, high = vectors.min(0).astype(np.float64), vectors.max(0).astype(np.float64)
    width = np.maximum((high - low) / CELLS, 1e-9)
    return np.clip(np.floor((vectors - low) / width), 0, CELLS - 1).astype(np.uint8), low, width


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FILE from vec_id and v."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def row(size: int) -> pa.RecordBatch:
        ids, vectors = (np.concatenate(x) for x in zip(*held.pop(size), strict=True))
        cells, low, width = approximated(vectors)
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, cells, low, width, vectors))], [f.split()[0] for f in FILE.split(", ")])

    for batch in batches:
        ids, v = batch.column("vec_id").to_numpy(), batch.column("v")
        at, flat = v.offsets.to_numpy(), v.values.to_numpy()
        sizes = np.diff(at)
        for size in np.unique(sizes).tolist():
            pick = np.flatnonzero(sizes == size)
            for some in np.array_split(pick, -(-len(pick) // BLOCK)):
                held.setdefault(size, []).append((ids[some], flat[at[some][:, None] + np.arange(size)]))
                if sum(len(x) for x, _ in held[size]) >= BLOCK:
                    yield row(size)
    for size in list(held):
        yield row(size)


def _read(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = r["size"]
    return np.frombuffer(r["ids"], np.int64), np.frombuffer(r["cells"], np.uint8).reshape(-1, size), np.frombuffer(r["low"]), np.frombuffer(r["width"])


def bounds(query: np.ndarray, query_id: np.ndarray, r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middle products of all queries with a block's vectors, -inf for those with the query's id; the half width for each query; the ids."""
    ids, cells, low, width = _read(r)
    q = query.astype(np.float64)
    middle = (q * width) @ cells.T.astype(np.float64) + (q @ (low + width / 2))[:, None]
    half = np.abs(q) @ (width / 2) + 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(low + CELLS * width))) + 1e-6
    middle[query_id[:, None] == ids[None, :]] = -np.inf
    return middle, half, ids


Queries = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _lowest(batches: Iterator[pa.RecordBatch], queries: Queries, k: int) -> Iterator[pa.RecordBatch]:
    """q, bound: for each query the k greatest lower bounds of the vectors read."""
    best = {size: np.full((len(q), k), -np.inf) for size, (q, _, _) in queries.items()}
    for batch in batches:
        for r in batch.to_pylist():
            if r["size"] in queries:
                _, query_id, query = queries[r["size"]]
                middle, half, _ = bounds(query, query_id, r)
                both = np.concatenate((best[r["size"]], middle - half[:, None]), axis=1)
                best[r["size"]] = np.partition(both, -k, axis=1)[:, -k:]
    for size, found in best.items():
        fine = np.isfinite(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries[size][0], fine.sum(1)), pa.int64()), pa.array(found[fine], pa.float64())], ["q", "bound"])


def _exact(batches: Iterator[pa.RecordBatch], queries: Queries, least: dict[int, float], k: int) -> Iterator[pa.RecordBatch]:
    """q, query_id, vec_id, score of the k best of the vectors read, ties to smaller ids."""
    none = np.zeros(0, np.int64)
    best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["size"] not in queries:
                continue
            numbers, query_id, query = queries[r["size"]]
            middle, half, ids = bounds(query, query_id, r)
            floor = np.array([least.get(q, -np.inf) for q in numbers.tolist()])
            exact = np.frombuffer(r["exact"], np.int64).reshape(len(ids), -1)
            for row in np.flatnonzero((middle + half[:, None] >= floor[:, None]).any(1)):
                upper = middle[row] + half[row]
                left = np.flatnonzero((upper >= floor[row]) & (upper > -np.inf))
                left = left[np.argsort(-upper[left], kind="stable")]
                got, score = best.get((r["size"], row), (none, none))
                for start in range(0, len(left), 4 * k):
                    if len(score) == k and score[-1] > upper[left[start]]:
                        break
                    some = left[start : start + 4 * k]
                    got, score = np.concatenate((got, ids[some])), np.concatenate((score, _product(query[row], exact[some])))
                    order = np.lexsort((got, -score))[:k]
                    got, score = got[order], score[order]
                best[r["size"], row] = got, score
    for (size, row), (got, score) in best.items():
        numbers, query_id, _ = queries[size]
        same = lambda x: pa.array(np.full(len(got), x[row]), pa.int64())  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([same(numbers), same(query_id), pa.array(got), pa.array(score)], ["q", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    fine = F.col(id_col).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ready = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    file = written(ready.mapInArrow(_blocks, FILE), "approximation")
    queries = written(ready.where(F.pmod("vec_id", F.lit(every)) == 0).distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    blocks = -(-rows_of(queries) // block)
    paths = []
    for number in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == number).collect()
        own: Queries = {}
        for size in {len(r["v"]) for r in rows}:
            some = [r for r in rows if len(r["v"]) == size]
            own[size] = np.array([r["q"] for r in some], np.int64), np.array([r["vec_id"] for r in some], np.int64), np.array([r["v"] for r in some], np.int64)
        order = Window.partitionBy("q").orderBy(F.desc("bound"))
        lower = file.drop("exact").mapInArrow(lambda batches, own=own: _lowest(batches, own, k), "q long, bound double")
        kth = lower.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).groupBy("q").agg(F.min("bound").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        least = {r["q"]: r["least"] for r in kth.collect()}
        found = file.mapInArrow(lambda batches, own=own, least=least: _exact(batches, own, least, k), "q long, query_id long, vec_id long, score long")
        rank = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        ranked = written(found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k), "ranked")
        paths.append(ranked._written[0])
    if not paths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(ranked.schema).parquet(*paths).select("query_id", "rank", "vec_id", "score")
