"""The queries' contracts on the smallest tables: against plain versions, and against their SQL."""

import brute
import duckdb
import pytest

from claimloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op2(spark, texts):
    prints = [(d, brute.fingerprint(t)) for d, t in texts.items()]
    group = brute.groups(prints)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, SF).collect()}
    assert got == {(d, f"{p:016x}", group[d, p]) for d, p in prints}


def test_op3(spark, texts):
    kinds = ("email", "ip", "card", "phone")
    for r in queries.op3_pii(spark, SF).collect():
        spans = sorted(brute.base_spans(texts[r["doc_id"]]))
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert r["base_sha256"] == brute.sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans))
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term:")] == [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]


def test_op9(spark, texts):
    rows = queries.op9_shards(spark, SF).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(d, len((t or "").encode()) + 16, brute.crc(t)) for d, t in texts.items()}
    assert {r["law"] for r in rows} == {"rows"} and {r["shard"] for r in rows} == set(range(40))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    base = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        base.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = base.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want.project(",".join(cols)).fetchall()))
