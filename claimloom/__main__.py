"""python -m claimloom WORDS --export-dir FOLDER: parses the words of documents (Parquet or JSON lines) and writes a bundle."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from claimloom import logs, schemas
from claimloom.operators import ingest
from claimloom.options import Export, Pages, Parse
from claimloom.sources import bundle
from claimloom.sources.sinks import FolderSink


def main(argv: list[str] | None = None) -> int:
    given = argparse.ArgumentParser(prog="claimloom", description="Words of patent documents to a bundle of tables.")
    given.add_argument("words", help="a folder of words, Parquet or JSON lines")
    given.add_argument("--export-dir", help="where the bundle goes")
    given.add_argument("--export-artifacts", action="store_true", help="write sections, claims and figures too")
    given.add_argument("--print-json", action="store_true", help="print the status of each document as JSON")
    given.add_argument("--strict", action="store_true", help="fail documents with errors; the exit code tells")
    given.add_argument("--width", type=float, default=Pages.width)
    given.add_argument("--height", type=float, default=Pages.height)
    args = given.parse_args(argv)
    spark, log = SparkSession.builder.appName("claimloom").getOrCreate(), logs.get("claimloom")
    try:
        json = args.words.rstrip("/").endswith((".json", ".jsonl"))
        words = spark.read.schema(schemas.WORDS).json(args.words) if json else spark.read.schema(schemas.WORDS).parquet(args.words)
        words.limit(1).count()
    except AnalysisException as e:
        log.error("no words", extra={"fields": {"path": args.words, "error": str(e).split("\n")[0]}})
        return 2
    tables = ingest.ingest(words, Parse(pages=Pages(args.width, args.height), fail_on_error=args.strict))
    if args.export_dir:
        bundle.export(tables, FolderSink(args.export_dir), Export(body_text=args.export_artifacts))
    if args.print_json:
        for line in tables["status"].orderBy("doc_id").toJSON().toLocalIterator():
            print(line)
    failed = tables["status"].where("status = 'failed'").count()
    log.info("done", extra={"fields": {"failed": failed}})
    return 1 if failed and args.strict else 0


if __name__ == "__main__":
    sys.exit(main())
