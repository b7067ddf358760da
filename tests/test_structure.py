"""The library stands without the language-model operators; sources and streams work."""

import random
import ast
import pathlib
import subprocess
import sys

from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.sources import bundle
from claimloom.streaming import landing

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_imports_the_llm_subpackage():
    for f in (ROOT / "claimloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), f


def test_entry_without_llm(tmp_path):
    (tmp_path / "claimloom").mkdir()
    for f in (ROOT / "claimloom").iterdir():
        if f.name not in ("llm", "__pycache__"):
            (tmp_path / "claimloom" / f.name).symlink_to(f)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = f"import sys; sys.path[:] = [p for p in sys.path if p not in ('', {str(ROOT)!r})]; sys.path.insert(0, {str(tmp_path)!r}); import importlib.util as u; s = u.spec_from_file_location('e', {str(tmp_path / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m); print(len(m.queries()), len(m.oracle_sql()), any(n.startswith('op') for n in m.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 50 and out.stdout.split()[2] == "False"


def test_bundle_round_trip(spark, tmp_path):
    claims = spark.createDataFrame([("a", 1, 1, "A part.", [], True), ("a", 2, 2, "Of claim 1.", [1], False), ("b", 1, 1, "Ünï", [], True)], schemas.CLAIMS)
    tables = {"claims": claims, "figures": spark.createDataFrame([("a", 1, "A", "a view", "FIG. 1A")], schemas.FIGURES), "sections": spark.createDataFrame([("b", "summary", "")], schemas.SECTIONS), "front": spark.createDataFrame([("a", "T", None, None, ["X"], "US1", None, [])], schemas.FRONT)}
    bundle.write(tables, str(tmp_path / "x"))
    back = bundle.read(spark, str(tmp_path / "x"))
    for name, table in tables.items():
        assert sorted(map(str, back[name].collect())) == sorted(map(str, table.collect()))
    assert {r["doc_id"]: (r["n_claims"], r["artifacts"]) for r in back["manifest"].collect()} == {"a": (2, ["claims", "figures", "front"]), "b": (1, ["claims", "sections"])}


def test_bad_lines_are_left_out(spark, tmp_path):
    for name in (*schemas.BUNDLE, "manifest"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text('{"doc_id": "a"}\n{not json\n')
    assert bundle.read(spark, str(tmp_path))["claims"].count() == 1


def test_documents_by_hash(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    row = bundle.documents(spark, str(tmp_path)).first()
    assert row["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and row["doc_id"] == row["sha256"][:16]
    words = bundle.words(bundle.documents(spark, str(tmp_path)), lambda c: [{"page": 0, "word_no": 0, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "text": c.decode(), "block_no": 0, "line_no": 0}])
    assert words.first()["text"] == "abc"


def test_arrivals_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"doc_id": "%s", "sha256": "%s", "arrived": "2024-01-01T00:00:0%d"}\n'
    (tmp_path / "in" / "a.json").write_text(line % ("a", "h1", 1) + line % ("b", "h1", 2) + line % ("c", "h2", 3))
    rows = landing.arrivals(spark, str(tmp_path / "in"), "doc_id string, sha256 string, arrived timestamp")
    landing.append(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("sha256").distinct().count() == spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_issue_counts_by_window(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ts": "2024-01-01T00:10:00", "severity": "error"}\n{"ts": "2024-01-01T00:20:00", "severity": "error"}\n')
    rows = spark.readStream.schema("ts timestamp, severity string").json(str(tmp_path / "in"))
    q = landing.issue_counts(rows).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").select(F.sum("n")).first()[0] == 2


def test_chains_stay_in_place(spark):
    from claimloom.operators import citations

    r = random.Random(5)
    edges = spark.createDataFrame(sorted({(f"i{r.randint(0, 30)}", f"i{r.randint(0, 40)}") for _ in range(70)}), "src string, dst string")
    starts = edges.select(F.col("src").alias("id")).distinct()
    here, moved = citations.chains(edges, starts), citations.chains(edges, starts, bound=0)
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, here.collect())) == sorted(map(tuple, moved.collect()))
    assert plan.count("hashpartitioning(start") <= 1 and plan.count("BroadcastHashJoin") >= 4


def test_chains_grow_from_numbers(spark, monkeypatch):
    """Beyond the bound of rows no chain is moved or stored; the chains are those of plain loops, however many grow at once."""
    import pyarrow as pa

    from claimloom.operators import citations

    r = random.Random(6)
    pairs = [(f"i{r.randint(0, 30)}", f"i{r.randint(0, 40)}") for _ in range(90)] + [("hub", f"i{k}") for k in range(41)] + [("i1", "hub"), ("i2", "i2"), ("lone", None), ("far", "nowhere"), (None, "i3")]
    edges = spark.createDataFrame(pairs + pairs[:9], "src string, dst string")
    cites = {s: {d for s_, d in pairs if s_ == s and d is not None} for s, _ in pairs if s is not None}
    want = []
    for s in cites:
        level, seen = {s: (s,)}, set()
        for _ in range(4):
            want += [(s, i, len(p), list(p)) for i, p in level.items()]
            seen |= level.keys()
            step = [(d, (*p, d)) for i, p in level.items() for d in cites[i] if d in cites and d not in seen]
            level = {d: min(p for d_, p in step if d_ == d) for d, _ in step}
    numbered, moved = citations.chains(edges, None, 4, bound=0), citations.chains(edges, None, 4, bound=0, numbered=0)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan and plan.count("Scan parquet") == 1
    assert sorted(map(tuple, numbered.collect())) == sorted(want) == sorted(map(tuple, moved.collect()))
    assert sorted(map(tuple, citations.chains(edges, edges.where("src = 'hub'").select(F.col("src").alias("id")), 4, bound=0).collect())) == sorted(x for x in want if x[0] == "hub")

    rows = pa.table({"id": list(cites), "_next": pa.array([list(x) for x in cites.values()], pa.list_(pa.string()))})
    cited = set().union(*cites.values())
    graph = citations._numbered(rows.filter(pa.array([x in cited for x in cites])))
    for name, size in (("CHAINS", 8), ("STARTS", 5), ("SENT", 3)):
        monkeypatch.setattr(citations, name, size)
    got = [x for b in citations._searched(iter(rows.to_batches(max_chunksize=2)), type("", (), {"value": graph}), 4) for x in b.to_pylist()]
    assert sorted(tuple(x.values()) for x in got) == sorted(want)
