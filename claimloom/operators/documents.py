"""Questions about bundles: front(doc_id, ...), sections(doc_id, section, text), claims, figures, and files(doc_id, bucket, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import tokens
from claimloom.operators import claims as claim_rows
from claimloom.operators import drawings

TEXTS = ("background", "summary", "detailed_description")


def texts(front: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, abstract, background, summary, detailed_description; empty where there is none."""
    wide = sections.groupBy("doc_id").pivot("section", list(TEXTS)).agg(F.max("text"))
    return front.select("doc_id", "abstract").join(wide, "doc_id", "left").select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("abstract", *TEXTS)])


def figure_id() -> Column:
    return F.upper(F.concat(F.col("figure_number").cast("string"), F.coalesce("figure_suffix", F.lit(""))))


def figure_lookup(figures: DataFrame, wanted: Column | None = None) -> DataFrame:
    """The figures with `figure`, their id in upper case; the last description of an id; only `wanted` ids, in any case."""
    rows = figures.withColumn("figure", figure_id())
    rows = rows.where(F.col("figure") == F.upper(wanted)) if wanted is not None else rows
    order = "pos" if "pos" in figures.columns else "description"
    return rows.groupBy("doc_id", "figure").agg(F.max_by(F.struct("figure_number", "figure_suffix", "description"), order).alias("f")).select("doc_id", "figure", "f.*")


def figure_contexts(figures: DataFrame, claims: DataFrame, searched: DataFrame, files: DataFrame | None = None, reach: int = 100) -> DataFrame:
    """doc_id, figure, description, sheet_png, figure_png, claims, excerpts of every figure.

    claims are the numbers that refer to the figure; excerpts come from the first mention "FIG. id" in each text column of
    searched(doc_id, ...).  A figure's image is the file whose name holds its slug as a whole part.
    """
    rows = figure_lookup(figures)
    told = claim_rows.figure_mentions(claims).withColumnRenamed("claims", "_claims")
    columns = [c for c in searched.columns if c != "doc_id"]
    each = searched.select("doc_id", F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(c).alias("section"), F.col(c).alias("body")) for i, c in enumerate(columns)])))
    hits = each.join(rows.select("doc_id", "figure"), "doc_id").withColumn("_at", F.instr(F.lower("body"), F.lower(F.concat(F.lit("FIG. "), "figure")))).where("_at > 0")
    start = F.greatest(F.lit(1), F.col("_at") - reach)
    excerpt = F.concat("section", F.lit(": "), F.substr("body", start, F.col("_at") - start + F.length("figure") + 5 + reach))
    found = hits.groupBy("doc_id", "figure").agg(F.array_sort(F.collect_list(F.struct("_i", excerpt.alias("e")))).alias("_e"))
    out = rows.join(told, ["doc_id", "figure"], "left").join(found, ["doc_id", "figure"], "left")
    if files is not None:
        sheets = files.where("bucket = 'sheet_pngs'").groupBy("doc_id").agg(F.min("path").alias("sheet_png"))
        parts = files.where("bucket = 'figure_pngs'").select("doc_id", "path", F.explode(F.split(F.lower("path"), r"[^a-z0-9]+")).alias("_part")).groupBy("doc_id", "_part").agg(F.min("path").alias("figure_png"))
        out = out.join(sheets, "doc_id", "left").withColumn("_part", drawings.slug(F.col("figure"))).join(parts, ["doc_id", "_part"], "left")
    else:
        out = out.withColumn("sheet_png", F.lit(None).cast("string")).withColumn("figure_png", F.lit(None).cast("string"))
    return out.select(
        "doc_id", "figure", "figure_number", "figure_suffix", "description", "sheet_png", "figure_png", F.coalesce("_claims", F.expr("cast(array() as array<int>)")).alias("claims"),
        F.coalesce(F.transform("_e", lambda e: e["e"]), F.expr("cast(array() as array<string>)")).alias("excerpts"))


def for_grading(contexts: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The contexts of the wanted figures, in any case, or of all."""
    return contexts if wanted is None else contexts.where(F.col("figure").isin(*[w.upper() for w in wanted]))


def as_json(front: DataFrame, sections: DataFrame, claims: DataFrame, figures: DataFrame) -> DataFrame:
    """doc_id, json: a document with its claims, figures and sections as one JSON text."""
    c = claims.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "pos", "text", "is_independent", "depends_on"))).alias("_c"))
    f = figures.withColumn("id", figure_id()).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", F.col("figure_number").alias("number"), F.col("figure_suffix").alias("suffix"), "description"))).alias("_f"))
    rows = texts(front, sections).join(front.drop("abstract"), "doc_id").join(c, "doc_id", "left").join(f, "doc_id", "left")
    meta = F.struct(F.col("doc_id").alias("id"), *[F.col(x) for x in ("title", "assignee", "inventors", "application_id") if x in front.columns])
    whole = F.struct(meta.alias("meta"), F.transform("_c", lambda x: x.dropFields("pos")).alias("claims"), F.col("_f").alias("figures"), F.struct(*TEXTS).alias("sections"))
    return rows.select("doc_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def statistics(front: DataFrame, claims: DataFrame, figures: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id and counts of claims, figures and inventors, whether there are images, assignee."""
    n = claims.groupBy("doc_id").agg(F.count("*").alias("total_claims"), F.count_if("is_independent").alias("independent_claims"), F.count_if(~F.col("is_independent")).alias("dependent_claims"))
    f = figures.groupBy("doc_id").agg(F.count("*").alias("total_figures"))
    i = files.groupBy("doc_id").agg(F.max(F.col("bucket") == "sheet_pngs").alias("has_sheet_images"), F.max(F.col("bucket") == "figure_pngs").alias("has_figure_images"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = front.select("doc_id", F.greatest(F.size("inventors"), F.lit(0)).alias("inventors_count"), "assignee").join(n, "doc_id", "left").join(f, "doc_id", "left").join(i, "doc_id", "left")
    return rows.select("doc_id", *map(zero, ("total_claims", "independent_claims", "dependent_claims", "total_figures")), *map(no, ("has_sheet_images", "has_figure_images")), "inventors_count", "assignee")


def matching(documents: DataFrame, predicate: Column) -> DataFrame:
    """The documents for which the predicate holds."""
    return documents.where(predicate)


def claim_contexts(claims: DataFrame) -> DataFrame:
    """doc_id, number, text, parents, children as lists of number and text, and figures."""
    rows = claim_rows.lookup(claims)
    around = claim_rows.context(claims)
    ends = lambda c: around.select("doc_id", F.col("number").alias("_n"), F.explode(c).alias("number")).join(rows, ["doc_id", "number"]).groupBy("doc_id", F.col("_n").alias("number")).agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias(f"_{c}"))
    none = F.expr("cast(array() as array<struct<number:int,text:string>>)")
    out = rows.join(around.select("doc_id", "number", "figures"), ["doc_id", "number"]).join(ends("parents"), ["doc_id", "number"], "left").join(ends("children"), ["doc_id", "number"], "left")
    return out.select("doc_id", "number", "text", F.coalesce("_parents", none).alias("parents"), F.coalesce("_children", none).alias("children"), "figures")


def references(c: Column) -> Column:
    """Struct of the grants and publications that a text cites."""
    ids = tokens.patent_ids(c)
    digits = F.transform(ids, lambda x: F.regexp_extract(x, "[0-9]+", 0))
    year = lambda d: d.rlike("^(?:19|20)[0-9]{9}$")
    return F.struct(F.filter(digits, lambda d: ~year(d)).alias("patents"), F.filter(digits, year).alias("publications"))
