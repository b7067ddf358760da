"""Operators start in a session that names no shared folder, and leave nothing behind."""

import os
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[2]
CODE = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from claimloom.llm import common, lines, simhash
from claimloom.operators import claims
docs = spark.createDataFrame([(1, "x" * 50 + "\\na"), (2, "x" * 50 + "\\nb"), (3, "x" * 50 + "\\na")], "doc_id long, text string")
print([r["text"] for r in lines.line_dedup(docs).orderBy("doc_id").collect()])
print([r["component_id"] for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()])
print(claims.tree(spark.createDataFrame([(1, 1, [], True), (1, 2, [1], False)], "doc_id long, number int, depends_on array<int>, is_independent boolean")).count())
print(common.shared_dir(spark))
"""


def test_without_a_shared_folder(tmp_path):
    (tmp_path / "conf").mkdir()
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(ROOT), "SPARK_CONF_DIR": str(tmp_path / "conf")}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]
    kept, groups, n, folder = out.stdout.splitlines()[-4:]
    assert kept == str(["x" * 50 + "\na", "b", ""]) and groups == "[1, 2, 1]" and n == "2"
    assert not os.path.exists(folder)


def test_tables_go_with_the_application(tmp_path):
    """The shared folder holds nothing of an application that has ended."""
    (tmp_path / "conf").mkdir()
    (tmp_path / "shared").mkdir()
    (tmp_path / "conf" / "spark-defaults.conf").write_text(f"spark.checkpoint.dir {tmp_path}/shared\n")
    code = CODE.format(root=str(ROOT)).replace("is None", f"== '{tmp_path}/shared'")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(ROOT), "SPARK_CONF_DIR": str(tmp_path / "conf")}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]
    left = [f for _, _, files in os.walk(tmp_path / "shared") for f in files]
    assert left == []
