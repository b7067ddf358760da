"""Where exported tables go: a folder, or views of the session."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sink(Protocol):
    """Takes tables by a key and returns where they are."""

    def put_json(self, key: str, rows: DataFrame) -> str: ...

    def put_text(self, key: str, rows: DataFrame) -> str: ...

    def put_bytes(self, key: str, rows: DataFrame) -> str: ...


class FolderSink:
    """A folder for each key: JSON lines with sorted names, one text a line, or rows with binary columns; equal keys are replaced."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def put_json(self, key: str, rows: DataFrame) -> str:
        rows.select(*sorted(rows.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{self.path}/{key}")
        return f"{self.path}/{key}"

    def put_text(self, key: str, rows: DataFrame) -> str:
        rows.select(F.col(rows.columns[0]).cast("string")).write.mode("overwrite").text(f"{self.path}/{key}")
        return f"{self.path}/{key}"

    def put_bytes(self, key: str, rows: DataFrame) -> str:
        rows.write.mode("overwrite").parquet(f"{self.path}/{key}")
        return f"{self.path}/{key}"


class ViewSink:
    """Views of the session, for tests and chained jobs; the key is the view's name."""

    def __init__(self, prefix: str = "bundle") -> None:
        self.prefix = prefix

    def _put(self, key: str, rows: DataFrame) -> str:
        name = f"{self.prefix}_{key.replace('/', '_')}"
        rows.createOrReplaceTempView(name)
        return name

    put_json = put_text = put_bytes = _put
