"""The pipeline's stages against plain versions, and the whole over the smallest tables."""

import brute
import corpus_pipeline
import numpy as np
import pytest

from claimloom.llm import pieces, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Each stage's input and output rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF).cache()
        out.append((docs.collect(), made.collect(), docs.columns, made.columns))
        docs = made
    return out


def test_columns_stay(steps):
    assert all(a == b for *_, a, b in steps[:-1])


def test_quality_stage_keeps_good_documents(spark, steps):
    rows, kept, *_ = steps[0]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    left = {r["doc_id"] for r in kept}
    assert len(good & left) >= 0.97 * len(good) and len(left) < len(rows)


def test_line_stage(steps):
    from test_operators import plain_lines

    rows, kept, *_ = steps[1]
    want = plain_lines({r["doc_id"]: r["text"] for r in rows})
    same = {r["doc_id"]: r["text"] for r in rows}
    assert {r["doc_id"]: r["text"] for r in kept} == {d: t for d, t in want.items() if t == same[d] or t.strip(" ")}


def test_near_copy_stage(steps):
    rows, kept, *_ = steps[2]
    left = {r["doc_id"] for r in kept}
    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    assert left <= set(first.values()) and len(left) >= 0.9 * len(first)


def test_benchmark_stage(spark, steps):
    rows, kept, *_ = steps[3]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r["doc_id"] for r in rows if not brute.benchmark_hits(r["text"], items)[4]}
    assert {r["doc_id"] for r in kept} == clean


def test_encode_stage(steps):
    rows, kept, *_ = steps[4]
    model = pieces.Pieces(pieces.model_pieces(queries.model_path()))
    ids = {r["doc_id"]: r["ids"] for r in kept}
    assert {r["doc_id"] for r in rows} == set(ids)
    assert all(model.decode(np.array(ids[r["doc_id"]]).tolist()) == r["text"] for r in rows)


def test_run_equals_its_stages(spark, steps):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in steps[-1][1])


ODD = "doc_id long, text string, lang string, source string, n_chars long, _id string, _text string, node string, signature string, name string"


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with the operators' own names."""
    line = "A line of more than forty characters that many documents share."
    texts = [None, "", " ", line, f"{line}\nand more of it", "w " * 30000, "x" * 50000, "a b c d e f g", "a b c d e f g"]
    rows = [(i, t, "en", None, 1, "i", "t", "n", "s", "m") for i, t in enumerate(texts)] + [(None, line, None, "web", None, *["z"] * 5), (None, None, None, None, None, *["z"] * 5), (3, line, "en", None, 1, "i", "t", "n", "s", "m"), (7, "other words here", "en", None, 1, "i", "t", "n", "s", "m")]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns and made.schema == docs.schema
        assert {r["doc_id"] for r in made.collect()} <= {r["doc_id"] for r in docs.collect()}
        docs = made
    assert set(docs.columns) == {"doc_id", "lang", "source", "ids"} and docs.where("doc_id is null").count() >= 1
    # The near-copy stage by itself: one row for each id and group.
    left = corpus_pipeline.near_copy_stage(spark, spark.createDataFrame(rows, ODD), SF).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == [0, 3, 4, 5, 6, 7] and sum(r["doc_id"] is None for r in left) == 2


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
