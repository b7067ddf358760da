"""Claim trees have no greatest depth."""

from claimloom.operators import claims


def test_tree_of_a_long_chain(spark):
    rows = [(1, n, [n - 1] if n > 1 else [], n == 1) for n in range(1, 68)]
    frame = spark.createDataFrame(rows, "doc_id long, number int, depends_on array<int>, is_independent boolean").coalesce(1)
    found = claims.tree(frame).select("number", "depth").collect()
    assert sorted(map(tuple, found)) == [(n, n - 1) for n in range(1, 68)]
