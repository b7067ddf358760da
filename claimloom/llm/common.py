"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A small side is broadcast up to this many bytes in memory, by its rows and their width; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows of one key that a join sends to one task; keys with more are joined apart, without a shuffle.
HOT_ROWS = 100_000
#: The scratch folder of each application.
_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    app = f"local {spark.sparkContext.applicationId}"
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="claimloom-")
        atexit.register(shutil.rmtree, _scratch[app], ignore_errors=True)
    return _scratch[app]


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark)}/claimloom/{app}"
        path, store = _path(spark, _scratch[app])
        store.mkdirs(path)
        store.deleteOnExit(path)
    return _scratch[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark, seen = df.sparkSession, Observation()
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    long = {"string": F.octet_length, "binary": F.octet_length}
    wide = lambda k: lambda c: {"array<int>": 4, "array<bigint>": 8}.get(k, 16) * F.size(c)
    sizes = [F.coalesce((long.get(k) or wide(k))(F.col(f"`{c}`")), F.lit(0)) for c, k in df.dtypes if k in long or k.startswith("array")]
    more = F.sum(sum(sizes[1:], sizes[0]).cast("long")) if sizes else F.max(F.lit(0))
    df.observe(seen, F.count(F.lit(1)).alias("rows"), more.alias("more")).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path, int(seen.get["rows"]), int(seen.get["more"] or 0)
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes frames from written() that no plan still to run reads."""
    for df in frames:
        path, store = _path(df.sparkSession, df._written[0])
        store.delete(path, True)


def rows_of(df: DataFrame) -> int:
    return df._written[1] if hasattr(df, "_written") else df.count()


def bytes_of(df: DataFrame) -> int:
    """Bytes that the rows of a frame from written() take in memory, about: 8 a column, 48 a row, and their texts and lists."""
    if not hasattr(df, "_written"):
        raise TypeError("not a table from written()")
    return df._written[1] * (48 + 8 * len(df.columns)) + df._written[2]


def small(df: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows take at most `bound` bytes; df is from written()."""
    return F.broadcast(df) if bytes_of(df) <= bound else df


def meet(rows: DataFrame, names: DataFrame, on: list[str], many: str, hot: int | None = None, bound: int | None = None) -> DataFrame:
    """The inner join of rows with names from written(), one row for each key, that say in column `many` how many rows have it.

    Names of at most `bound` bytes are broadcast.  Else the keys of more than `hot` rows, of which there are fewer than rows / hot, are
    broadcast, and only the other keys' rows are shuffled, so that no task gets more than `hot` rows of a key.
    """
    hot = hot or HOT_ROWS
    if bytes_of(names) <= (BROADCAST_BYTES if bound is None else min(bound, 2 * BROADCAST_BYTES)):
        return rows.join(F.broadcast(names), on)
    crowded = written(names.where(F.col(many) > hot), "hot")
    if not rows_of(crowded):
        return rows.join(names, on)
    cold = rows.join(F.broadcast(crowded.select(*on)), on, "left_anti").join(names.where(F.col(many) <= hot), on)
    return rows.join(small(crowded), on).unionByName(cold)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished phases, so disk use stays that of one phase."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows from now on, as the texts of a batch stand in memory several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under column names that clash with no operator's own, and the hidden name of each column."""
    names = {c: f"_col{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def shown(df: DataFrame, names: dict[str, str], **changed) -> DataFrame:
    """The columns of hidden() under their own names; changed: other Columns for some."""
    return df.select(*[changed.get(c, F.col(h)).alias(c) for c, h in names.items()])


def fields(df: DataFrame, keep: list[str], extra: str) -> str:
    """DDL of kept columns followed by `extra`."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in keep for f in df.schema.fields if f.name == c)
    return f"{own}, {extra}" if own else extra


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns of a batch and the new ones, in this order."""
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + list(new.values()), [*keep, *new])
