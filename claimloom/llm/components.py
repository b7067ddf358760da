"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import discard, release, rows_of, small, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b): root is the smallest node that can be reached.

    Each round hooks a node to its least smaller neighbour, follows the pointers to their ends, and contracts the edges.
    A hot node's edges meet only in partial minima and in joins that Spark may split.  Every round's tables are written
    to the shared folder.
    """
    spark = edges.sparkSession
    ends = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    live = written(edges.where(F.col("a") != F.col("b")).select(*ends).distinct(), "edges")
    parents = None
    while rows_of(live):
        hooks = written(live.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hooks")
        while True:
            stepped = written(hooks.join(small(hooks).select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "hooks")
            discard(hooks)
            hooks = stepped
            if stepped.where("moved").isEmpty():
                break
        move = lambda frame, col: frame.join(small(hooks).select(F.col("node").alias(col), F.col("root").alias(f"_{col}")), col, "left").withColumn(col, F.coalesce(f"_{col}", col)).drop(f"_{col}")
        before, parents = parents, written(hooks.select("node", "root") if parents is None else move(parents, "root").unionByName(hooks.select("node", "root")), "parents")
        past, live = live, written(move(move(live, "a"), "b").where(F.col("a") != F.col("b")).select(*ends).distinct(), "edges")
        discard(past, hooks, *([before] if before is not None else []))
        release(spark)
    discard(live)
    return parents if parents is not None else written(spark.createDataFrame([], "node long, root long"), "parents")
