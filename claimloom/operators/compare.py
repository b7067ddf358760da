"""Two versions of claims: alignment by TF-IDF, differences, excerpts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.stored import stable


def words(c: Column) -> Column:
    """Words of two or more characters, in lower case, with single spaces between."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), " ")


def similarities(left: DataFrame, right: DataFrame, pair: str = "pair", threshold: float = 0.72) -> DataFrame:
    """pair, a, b, similarity of the claims (pair, id, text) of two sides, by cosine of smoothed, normalised TF-IDF per pair.

    The words of a pair's claims meet once, in one row, and only its results leave it: grams are many times larger than texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    side = lambda df, name: df.select(pair, "id", words(F.col("text")).alias("words"), F.lit(name).alias("side"))
    both = side(left, "a").unionByName(side(right, "b")).where(F.col(pair).isNotNull())
    wanted = both.select(pair, F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).cast("double").alias("similarity")).schema
    kind = to_arrow_schema(wanted)

    def cosines(sides: list[str], ids: list, texts: list[str | None]) -> Iterator[tuple]:
        """(a, b, cosine) of the claims of one pair that share a word or two neighbouring words."""
        grams = {}
        for side, id_, text in zip(sides, ids, texts, strict=True):
            w = text.split(" ") if text else []
            grams.setdefault((side, id_), Counter()).update(w + [f"{x} {y}" for x, y in pairwise(w)])
        df = Counter(chain.from_iterable(grams.values()))
        squares = {k: (math.log((1 + len(ids)) / (1 + k)) + 1) ** 2 for k in set(df.values())}
        square = {g: squares[k] for g, k in df.items()}
        norm = {d: math.sqrt(sum(n * n * square[g] for g, n in tf.items())) for d, tf in grams.items()}
        right = [(d, tf) for d, tf in grams.items() if d[0] == "b"]
        for d, tf in grams.items():
            if d[0] == "a":
                for e, of in right:
                    both = tf.keys() & of.keys()
                    if both:
                        yield d[1], e[1], sum(tf[g] * of[g] * square[g] for g in sorted(both)) / (norm[d] * norm[e])

    def score(batches):
        for batch in batches:
            rows = batch.column(1).flatten()
            sides, ids, texts = (rows.field(k).to_pylist() for k in range(3))
            at, out = 0, ([], [], [], [])
            for pair_, n in zip(batch.column(0).to_pylist(), batch.column(1).value_lengths().to_pylist(), strict=True):
                for a, b, cosine in cosines(sides[at : at + n], ids[at : at + n], texts[at : at + n]):
                    if cosine >= threshold:
                        for column, value in zip(out, (pair_, a, b, cosine), strict=True):
                            column.append(value)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind, strict=True)], schema=kind)

    return both.groupBy(pair).agg(F.collect_list(F.struct("side", "id", "words")).alias("rows")).mapInArrow(score, wanted)


def align(scored: DataFrame, pair: str = "pair") -> DataFrame:
    """Greedy one-to-one choice by falling similarity, ties to smaller a, then b, within each pair."""
    def choose(batches):
        for batch in batches:
            out = []
            for pair_, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                used_a, used_b = set(), set()
                for r in sorted(rows, key=lambda r: (-round(r["similarity"], 9), r["a"], r["b"])):
                    if r["a"] not in used_a and r["b"] not in used_b:
                        used_a.add(r["a"])
                        used_b.add(r["b"])
                        out.append({pair: pair_, **r})
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = scored.select(pair, "a", "b", "similarity").schema
    kind = to_arrow_schema(wanted)
    return scored.groupBy(pair).agg(F.collect_list(F.struct("a", "b", "similarity")).alias("rows")).mapInArrow(choose, wanted)


def diff(left: DataFrame, right: DataFrame, aligned: DataFrame, pair: str = "pair", same: float = 0.96) -> DataFrame:
    """pair, a, b, status: unchanged, renumbered, modified, removed or added."""
    rows = left.select(pair, F.col("id").alias("a")).join(aligned, [pair, "a"], "full").join(right.select(pair, F.col("id").alias("b")), [pair, "b"], "full")
    status = (
        F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added")
        .when(F.col("similarity") < same, "modified").when(F.col("a") != F.col("b"), "renumbered").otherwise("unchanged"))
    return rows.select(pair, "a", "b", "similarity", status.alias("status"))


def word_diff(a: Column, b: Column) -> Column:
    """Opcodes of the word differences, such as "replace 2:3 2:4", which SQL has no function for."""
    @F.pandas_udf("array<string>")
    def ops(x: pd.Series, y: pd.Series) -> pd.Series:
        import difflib

        one = lambda p, q: [f"{t} {i}:{j} {k}:{m}" for t, i, j, k, m in difflib.SequenceMatcher(None, (p or "").split(), (q or "").split()).get_opcodes() if t != "equal"]
        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return ops(a, b)


def line_diff(a: Column, b: Column) -> Column:
    """The unified differences of two texts by lines, which SQL has no function for."""
    @F.pandas_udf("string")
    def lines(x: pd.Series, y: pd.Series) -> pd.Series:
        import difflib

        one = lambda p, q: "\n".join(difflib.unified_diff((p or "").splitlines(), (q or "").splitlines(), fromfile="submitted", tofile="approved", lineterm=""))
        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return lines(a, b)


STATUSES = ("unchanged", "renumbered", "modified", "removed", "added")


def summary(changes: DataFrame, pair: str = "pair") -> DataFrame:
    """pair, a count for each status, and whether one side has no claims at all."""
    n = lambda s: F.count_if(F.col("status") == s)
    return changes.groupBy(pair).agg(*[n(s).alias(s) for s in STATUSES], (F.count("a") * F.count("b") == 0).alias("claims_empty"))


def in_order(changes: DataFrame) -> DataFrame:
    """The changes by number in the later version, those without one last, then by number in the earlier."""
    return changes.orderBy("pair", F.col("b").asc_nulls_last(), "b", "a")


def versions(submitted: DataFrame, approved: DataFrame, pair: str = "pair", near: float = 0.72, same: float = 0.96) -> dict[str, DataFrame]:
    """changes, summary and excerpts of two versions' claims(pair, id, text): aligned, held against each other, and their changed phrases found again."""
    left, right = stable(submitted.select(pair, "id", "text")), stable(approved.select(pair, "id", "text"))
    changes = stable(diff(left, right, align(similarities(left, right, pair, near), pair), pair, same))
    changed = changes.where("status in ('modified', 'added') and b is not null").select(pair, F.col("b").alias("id")).join(right, [pair, "id"])
    wanted = changed.select(pair, F.explode(anchors(F.col("text"))).alias("anchor")).distinct()
    whole = right.groupBy(pair).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda c: c["text"]), "\n").alias("text"))
    return {"changes": changes, "summary": summary(changes, pair), "excerpts": excerpts(whole, wanted, pair)}


def anchors(c: Column, most: int = 30) -> Column:
    """Distinct phrases between marks, of 12 to 80 characters, longest first."""
    parts = F.transform(F.split(c, r"[,;:.]"), lambda p: F.trim(p))
    cut = F.transform(parts, lambda p: F.when(F.length(p) > 80, F.regexp_replace(F.left(p, F.lit(80)), r"\s+\S*$", "")).otherwise(p))
    good = F.array_distinct(F.filter(cut, lambda p: F.length(p) >= 12))
    return F.slice(F.transform(F.array_sort(F.transform(good, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda x: x["p"]), 1, most)


def excerpts(texts: DataFrame, wanted: DataFrame, key: str = "doc_id", reach: int = 100, most: int = 5) -> DataFrame:
    """key, anchor, at, excerpt: up to `most` places, in order, where a text(key, text) holds an anchor of wanted(key, anchor)."""
    rows = texts.join(wanted, key).withColumn("pieces", F.split(F.lower("text"), F.concat(F.lit("\\Q"), F.lower("anchor"), F.lit("\\E")), -1))
    parts = rows.select(key, "anchor", "text", F.posexplode("pieces").alias("k", "piece"))
    by = Window.partitionBy(key, "anchor").orderBy("k")
    at = F.sum(F.length("piece")).over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("k") * F.length("anchor") + 1
    hits = parts.withColumn("at", at).withColumn("more", F.lead("k").over(by)).where("more is not null")
    order = Window.partitionBy(key).orderBy("at", "anchor")
    start = F.greatest(F.lit(1), F.col("at") - reach)
    cut = F.substring("text", start.cast("int"), (F.col("at") - start + F.length("anchor") + reach).cast("int"))
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(key, "anchor", "at", cut.alias("excerpt"))
