"""Every query against its SQL on the smallest tables; those without SQL against their properties."""

import os

import duckdb
import pytest

from claimloom.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(v):
    return None if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, base, name):
    got = queries.QUERIES[name](spark, SF)
    want = base.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = want.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    assert sorted(repr([*map(plain, r)]) for r in got.select(*cols).collect()) == sorted(repr([*map(plain, r)]) for r in rows)


def test_diff_uses_each_claim_once(spark):
    rows = queries.claim_diff(spark, SF).collect()
    for side in ("a", "b"):
        used = [(r["pair"], r[side]) for r in rows if r[side] is not None]
        assert len(used) == len(set(used))
    assert {r["status"] for r in rows} <= {"unchanged", "renumbered", "modified", "removed", "added"}
    assert all((r["b"] is None) == (r["status"] == "removed") and (r["a"] is None) == (r["status"] == "added") for r in rows)


def test_paragraphs_are_ordered_and_keep_the_words(spark):
    rows = queries.body_paragraphs(spark, SF).collect()
    have = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["block"])):
        have.setdefault(r["doc_id"], []).extend(r["text"].split())
        assert r["y0"] <= r["y1"]
    want = {r["doc_id"]: " ".join(r["t"]).split() for r in queries.lines(spark, SF).groupBy("doc_id").agg({"pos": "count"}).select("doc_id").join(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "split(text, '\\n') t"), "doc_id").collect()}
    assert have == {d: w for d, w in want.items() if w}


def test_grouped_words_stay(spark):
    assert queries.word_grouping(spark, SF).agg({"n": "sum"}).first()[0] == queries.words(spark, SF).count()


def test_merged_boxes_are_apart(spark):
    by_page = {}
    for r in queries.drawing_merged(spark, SF).collect():
        by_page.setdefault(r["page"], []).append((r["x0"], r["y0"], r["x1"], r["y1"]))
    for boxes in by_page.values():
        for i, a in enumerate(boxes):
            for b in boxes[i + 1 :]:
                assert a[0] - 10 > b[2] or b[0] - 10 > a[2] or a[1] - 10 > b[3] or b[1] - 10 > a[3]


def test_word_diff_names_the_changes(spark):
    assert queries.claim_word_diff(spark, SF).where("changes <> ''").count() > 0


def test_native_plans_hold_no_python(spark):
    for name in ("claim_statistics", "claim_context", "front_matter", "body_sections", "drawing_assignment", "issue_summary"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
