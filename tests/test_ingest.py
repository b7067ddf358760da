"""Whole documents from words, and what stands around them: sinks, defaults, the command line."""

import json
import os
import subprocess
import sys

import pytest

from claimloom import schemas
from claimloom.__main__ import main
from claimloom.operators import ingest
from claimloom.options import Export, Pages, Parse
from claimloom.sources import bundle
from claimloom.sources.sinks import ViewSink

KIND = "doc_id string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string, block_no int, line_no int"


def page(doc, number, lines):
    """Words of lines (x, y, text), six units a character."""
    out = []
    for x, y, text in lines:
        for w in text.split(" "):
            out.append((doc, number, len(out), float(x), float(y), float(x + 6 * len(w)), float(y + 8), w, 0, 0))
            x += 6 * len(w) + 4
    return out


CLAIMS = ["1. A method of making a part, comprising a first step.", "2. The method of claim 1, wherein the part is small.", "3. The method of claim 2, as shown in FIG. 2."]
FRONT = [(60, 60, "(12) United States Patent"), (60, 80, "(54) WIDGET"), (60, 100, "(73) Assignee: Acme Inc."), (60, 120, "(57) ABSTRACT"), (60, 132, "A widget. 3 Claims, 1 Drawing Sheets"), (330, 60, "(10) Patent No.: US 7,629,993 B2"), (330, 80, "(45) Date of Patent: Dec. 8, 2009")]
SHEET = [(60, 30, "U.S. Patent"), (200, 30, "Dec. 8, 2009"), (330, 30, "Sheet 1 of 1"), (430, 30, "US 7,629,993 B2"), (150, 400, "FIG. 1")]
BODY = [(60, 60, "BACKGROUND"), (60, 90, "Widgets are known in the art for a long time."), (60, 120, "BRIEF DESCRIPTION OF THE DRAWINGS"), (60, 150, "FIG. 1 is a view. FIG. 2 is another."), (60, 180, "CLAIMS"), *[(60, 210 + 30 * k, c[:42]) for k, c in enumerate(CLAIMS)], *[(60, 220 + 30 * k, c[42:].strip()) for k, c in enumerate(CLAIMS) if c[42:].strip()]]


@pytest.fixture(scope="module")
def words(spark):
    rows = page("a", 0, FRONT) + page("a", 1, SHEET) + page("a", 2, sorted(BODY, key=lambda r: r[1])) + page("b", 0, [(60, 60, "Nothing of use here.")])
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def tables(words):
    return ingest.ingest(words)


def test_pages_and_front(tables):
    kinds = {(r["doc_id"], r["page"]): r["kind"] for r in tables["pages"].collect()}
    assert kinds == {("a", 0): "inid", ("a", 1): "drawing", ("a", 2): "body", ("b", 0): "unknown"}
    a = {r["doc_id"]: r for r in tables["front"].collect()}["a"]
    assert (a["title"], a["publication_id"], a["assignee"], a["claims_count"], a["drawing_sheets_count"], str(a["grant_date"])) == ("WIDGET", "US7629993B2", "Acme Inc.", 3, 1, "2009-12-08")
    assert a["abstract"] == "A widget."


def test_body_and_issues(tables):
    assert [(r["number"], r["depends_on"]) for r in tables["claims"].where("doc_id = 'a'").orderBy("pos").collect()] == [(1, []), (2, [1]), (3, [2])]
    assert {r["section"] for r in tables["sections"].collect()} == {"background", "brief_description_of_drawings", "claims"}
    facts = tables["facts"].where("doc_id = 'a'").first()
    assert (facts["method"], facts["n_parsed"], facts["figure_ids"], facts["figure_method"]) == ("section", 3, ["1", "2"], "section")
    issues = {(r["doc_id"], r["code"]) for r in tables["issues"].collect()}
    assert not {c for d, c in issues if d == "a" and ("claims" in c or "front" in c or "sheets" in c)}
    assert ("b", "front_matter.missing_required_inid") in issues and ("b", "body.claims.missing") in issues
    assert {r["doc_id"]: r["status"] for r in tables["status"].collect()}["b"] == "partial"
    assert [r["path"] for r in tables["drawings"].collect()] == ["sheet_p0001_dpi200.png"]


def test_failing_documents(words):
    out = ingest.ingest(words, Parse(fail_on_missing_fields=True))
    assert {r["doc_id"]: r["status"] for r in out["status"].collect()}["b"] == "failed"


def test_report(tables):
    facts, warnings = ingest.report(tables["issues"], tables["front"])
    assert facts.first()["n_docs"] == 2 and warnings.count() <= 10


def test_export_to_views(spark, tables):
    out = bundle.export(tables, ViewSink("t"), Export(body_text=False))
    assert {r["doc_id"]: r["artifacts"] for r in out.collect()} == {"a": ["drawings", "front"], "b": ["front"]}
    assert spark.table("t_manifest").count() == 2


def test_defaults_and_bad_lines(spark, tmp_path):
    for name in (*schemas.BUNDLE, "manifest"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text('{"doc_id": "a"}\n{not json\n{"title": "no id"}\n')
    back = bundle.read(spark, str(tmp_path), defaults=True)
    claim = back["claims"].first()
    assert (claim["text"], claim["depends_on"], claim["is_independent"]) == ("", [], True)
    assert back["sections"].first()["text"] == "" and bundle.read(spark, str(tmp_path))["claims"].first()["text"] is None
    bad = bundle.read_bad(spark, str(tmp_path)).collect()
    assert len(bad) == 10 and {r["table"] for r in bad} == {*schemas.BUNDLE, "manifest"}


def test_parse_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    rows = [dict(zip(("page", "word_no", "x0", "y0", "x1", "y1", "text"), r[1:8], strict=True)) for r in page("a", 0, FRONT)]
    out = bundle.parse(spark, lambda content: rows, path=str(tmp_path))
    assert out["front"].first()["doc_id"] == "US7629993B2"
    with pytest.raises(ValueError):
        bundle.parse(spark, lambda content: rows)


def test_command_line(spark, words, tmp_path, capsys, monkeypatch):
    words.write.parquet(str(tmp_path / "words"))
    assert main([str(tmp_path / "words"), "--export-dir", str(tmp_path / "out"), "--export-artifacts", "--print-json", "--height", str(Pages.height)]) == 0
    assert [json.loads(x)["doc_id"] for x in capsys.readouterr().out.splitlines()] == ["a", "b"]
    assert sorted(os.listdir(tmp_path / "out")) == ["claims", "drawings", "figures", "front", "manifest", "sections"]
    assert main([str(tmp_path / "words"), "--strict"]) == 1
    assert main([str(tmp_path / "nothing")]) == 2


def test_log_lines():
    code = "from claimloom import logs; logs.get('x').info('done', extra={'fields': {'n': 1}}); logs.get('x').debug('no')"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    lines = [json.loads(x) for x in out.stderr.splitlines() if x.startswith("{")]
    assert len(lines) == 1 and (lines[0]["event"], lines[0]["n"], lines[0]["level"]) == ("done", 1, "info")
