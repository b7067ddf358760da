"""Bundles of documents: tables of JSON lines with a manifest, and document files with their hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import logs, schemas
from claimloom.operators import ingest
from claimloom.options import Export, Parse
from claimloom.sources.sinks import FolderSink, Sink


def documents(spark: SparkSession, path: str, doc_id: Column | None = None) -> DataFrame:
    """doc_id, path, sha256, content of the files below a path; the id falls back to the hash's start."""
    files = spark.read.format("binaryFile").load(path)
    digest = F.sha2("content", 256)
    return files.select(F.coalesce(doc_id if doc_id is not None else F.lit(None).cast("string"), F.left(digest, F.lit(16))).alias("doc_id"), "path", digest.alias("sha256"), "content")


def words(files: DataFrame, decode: Callable[[bytes], list[dict]]) -> DataFrame:
    """Words of documents by a given decoder, which PDF libraries are plugged in as."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [{"doc_id": d, **w} for d, c in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True) for w in decode(c)]
            names = [f.strip().split()[0] for f in schemas.WORDS.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind) for n, kind in zip(names, (pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.int32(), pa.int32()), strict=True)], names)

    return files.select("doc_id", "content").mapInArrow(run, schemas.WORDS)


def manifest(tables: dict[str, DataFrame], hashes: DataFrame | None = None) -> DataFrame:
    """One row for each document of any table: version, hash, counts and the artifacts that it has."""
    each = None
    for name, table in tables.items():
        rows = table.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(name).alias("name"), "n")
        each = rows if each is None else each.unionByName(rows)
    count = lambda name: F.coalesce(F.max(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(f"n_{name}")
    out = each.groupBy("doc_id").agg(count("claims"), count("figures"), F.array_sort(F.collect_set("name")).alias("artifacts"))
    out = out.join(hashes.select("doc_id", "sha256"), "doc_id", "left") if hashes is not None else out.withColumn("sha256", F.lit(None).cast("string"))
    return out.select("doc_id", F.lit(schemas.VERSION).alias("schema_version"), "sha256", "n_claims", "n_figures", "artifacts")


def parse(spark: SparkSession, decode: Callable[[bytes], list[dict]], path: str | None = None, files: DataFrame | None = None, options: Parse = Parse()) -> dict[str, DataFrame]:
    """The tables of ingest() for the documents below a path or in files(doc_id, sha256, content), one of which is given.

    A document without an id of its own is known by its publication, if one is found, else by its hash's start.
    """
    if (path is None) == (files is None):
        raise ValueError("give either a path or files")
    rows = files if files is not None else documents(spark, path)
    out = ingest.ingest(words(rows, decode), options)
    if files is None:
        names = out["front"].select("doc_id", F.coalesce("publication_id", "doc_id").alias("_name"))
        out = {k: t.join(names, "doc_id").withColumn("doc_id", F.col("_name")).drop("_name") for k, t in out.items()}
    return out


def export(tables: dict[str, DataFrame], sink: Sink, options: Export = Export(), hashes: DataFrame | None = None) -> DataFrame:
    """Puts the tables that the options name into the sink, and always the manifest, which is returned."""
    wanted = {"front": options.front, "sections": options.body_text, "claims": options.body_text, "figures": options.body_text, "drawings": options.drawings}
    kept = {name: t for name, t in tables.items() if wanted.get(name)}
    log = logs.get("claimloom.export")
    for name, t in kept.items():
        log.info("table written", extra={"fields": {"table": name, "to": sink.put_json(name, t)}})
    out = manifest(kept, hashes)
    sink.put_json("manifest", out)
    return out


def write(tables: dict[str, DataFrame], path: str, hashes: DataFrame | None = None) -> None:
    """A folder of JSON lines for each table, and one for the manifest."""
    sink = FolderSink(path)
    for name, table in tables.items():
        sink.put_json(name, table)
    sink.put_json("manifest", manifest(tables, hashes))


#: What stands for null: texts are empty, lists have no members, claims are independent.
DEFAULTS = {"text": "''", "description": "''", "abstract": "''", "title": "''", "assignee": "''", "depends_on": "array()", "inventors": "array()", "cited": "array()", "is_independent": "true"}


def _rows(spark: SparkSession, path: str, name: str, ddl: str) -> DataFrame:
    return spark.read.text(f"{path}/{name}").select("value", F.from_json("value", ddl).alias("r"))


def read(spark: SparkSession, path: str, defaults: bool = False) -> dict[str, DataFrame]:
    """The tables of a bundle by their fixed schemas; lines that aren't JSON, or that name no document, are in read_bad()."""
    out = {}
    for name, ddl in {**schemas.BUNDLE, "manifest": schemas.MANIFEST}.items():
        rows = _rows(spark, path, name, ddl).select("r.*").where("doc_id is not null")
        if defaults:
            kinds = dict(rows.dtypes)
            rows = rows.withColumns({c: F.coalesce(c, F.expr(v).cast(kinds[c])) for c, v in DEFAULTS.items() if c in kinds})
        out[name] = rows
    return out


def read_bad(spark: SparkSession, path: str) -> DataFrame:
    """table, value: the lines of a bundle that read() leaves out."""
    out = None
    for name, ddl in {**schemas.BUNDLE, "manifest": schemas.MANIFEST}.items():
        bad = _rows(spark, path, name, ddl).where("r.doc_id is null").select(F.lit(name).alias("table"), "value")
        out = bad if out is None else out.unionByName(bad)
    return out


def bucket(name: Column, has_regions: Column | None = None) -> Column:
    """The manifest's list that a file belongs to; images outside the sheets' folder are figures where there are regions."""
    sheet, figure = name.contains("sheets/"), name.endswith(".png") & (has_regions if has_regions is not None else F.lit(True))
    return F.when(sheet & name.endswith(".pdf"), "sheet_pdfs").when(sheet & name.endswith(".png"), "sheet_pngs").when(figure, "figure_pngs").otherwise("other")


def file_lists(files: DataFrame) -> DataFrame:
    """doc_id, bucket, paths of files(doc_id, path, has_regions)."""
    rows = files.withColumn("bucket", bucket(F.col("path"), F.col("has_regions")))
    return rows.groupBy("doc_id", "bucket").agg(F.array_sort(F.collect_list("path")).alias("paths"))
