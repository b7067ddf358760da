"""From words to whole documents: pages, front matter, drawing pages, body, issues and a status for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators import body, columns, diagnostics, drawings, front, layout
from claimloom.options import Parse
from claimloom.stored import stable

PAGE = ["doc_id", "page"]


def analyse(words: DataFrame, options: Parse = Parse()) -> dict[str, DataFrame]:
    """pages(doc_id, page, kind), fields(doc_id, tag, text) and blocks(doc_id, page, col, pos, kind, text) of words.

    Pages before the cutoff give the fields, with numbers in the gutter kept and texts stitched across pages; body pages
    give paragraphs and headings, without such numbers.
    """
    size = (options.pages.width, options.pages.height)
    words = stable(words)
    lines = stable(columns.page_layout(words, PAGE, *size, numbers=True))
    kinds = layout.smooth_drawings(layout.page_signals(lines, PAGE).select(*PAGE, "kind"))
    kinds = stable(layout.front_matter_pages(kinds.join(layout.body_starts(lines, PAGE), PAGE, "left")))
    cut = layout.inid_cutoff(kinds)
    first = lines.join(cut, "doc_id").where(F.col("page") < F.col("cutoff")).drop("cutoff")
    # Header and body lines of a column in one order.
    order = Window.partitionBy(*PAGE, "col").orderBy("y0", "region", "pos")
    whole = layout.field_blocks(first.withColumn("pos", F.row_number().over(order)).select(*PAGE, "col", "pos", "y", "y0", "y1", "text"), [*PAGE, "col"])
    read = Window.partitionBy("doc_id").orderBy("page", "col", "y0", "first")
    placed = layout.stitched(stable(whole.withColumn("pos", F.row_number().over(read)).select("doc_id", "page", "pos", "col", "y0", "kind", "tag", "text")))
    fields = layout.tagged_texts(placed.where("tag is not null"))
    inside = words.join(kinds.where("kind = 'body'").select(*PAGE), PAGE, "left_semi")
    prose = columns.page_layout(inside, PAGE, *size).where("region = 'body'")
    parts = layout.paragraphs(prose, [*PAGE, "col"], left="x0", right="x1")
    reading = Window.partitionBy("doc_id").orderBy("page", "col", "y0", "block")
    blocks = layout.merged_headings(stable(parts.withColumn("pos", F.row_number().over(reading)).select("doc_id", "page", "col", "pos", "kind", "text", "y0", "y1")), ["doc_id"])
    return {"pages": kinds, "fields": stable(fields), "blocks": stable(blocks)}


def fields_above_noise(lines: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, tag, text of lines(doc_id, page, col, pos, y, y0, y1, text): fields of each page, without what stands below the largest gap of pages with `least` labels or more."""
    labels = F.count_if(F.trim("text").rlike(layout.LABEL)).over(Window.partitionBy(*PAGE))
    rows = stable(lines.withColumn("_n", labels))
    cut = columns.noise_cutoff(rows.where(F.col("_n") >= least), PAGE)
    kept = columns.above(rows, cut, PAGE)
    whole = layout.field_blocks(kept.select(*PAGE, "col", "pos", "y", "y0", "y1", "text"), [*PAGE, "col"])
    read = Window.partitionBy("doc_id").orderBy("page", "col", "y0", "first")
    return layout.tagged_texts(whole.withColumn("pos", F.row_number().over(read)).where("tag is not null"))


def ingest(words: DataFrame, options: Parse = Parse()) -> dict[str, DataFrame]:
    """front, sections, claims, figures, facts, drawings, issues and status of the documents of words(doc_id, page, word_no, x0, y0, x1, y1, text).

    The reported counts of claims and drawing sheets are held against what is found.  A document without the fields that
    the policy wants goes on with what it has, unless it is to fail.
    """
    read = analyse(words, options)
    docs = stable(words.select("doc_id").distinct())
    raw = read["fields"].select("doc_id", F.col("tag").cast("string").alias("code"), F.col("text").alias("raw"))
    parsed = stable(docs.join(front.semantic(raw), "doc_id", "left"))
    sheets = read["pages"].where("kind = 'drawing'").groupBy("doc_id").agg(F.count("*").cast("int").alias("n_sheets"), F.array_sort(F.collect_list("page")).alias("pages"))
    checked = parsed.select("doc_id", "drawing_sheets_count", "claims_count").join(sheets, "doc_id", "left").withColumn("n_sheets", F.coalesce("n_sheets", F.lit(0)))
    expected = checked.select("doc_id", F.col("claims_count").alias("n_claims"), F.col("drawing_sheets_count").alias("n_figures"))
    found = body.parse(read["blocks"], expected, options.body)
    issue = lambda frame, inid=None: frame.select("doc_id", "severity", "code", (F.col("inid") if inid is None else F.lit(None).cast("string")).alias("inid"))
    off = F.when(F.col("drawing_sheets_count").isNull(), "drawing_sheets.no_reported_count").when(F.col("drawing_sheets_count") != F.col("n_sheets"), "drawing_sheets.count_mismatch")
    counted = checked.select("doc_id", F.lit("warning").alias("severity"), off.alias("code")).where("code is not null")
    missing = front.policy_issues(docs.join(raw, "doc_id", "left").withColumn("raw", F.coalesce("raw", F.lit(""))), options.front)
    bodies = docs.join(found["facts"].select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("error").alias("severity"), F.lit("body.claims.missing").alias("code"))
    issues = issue(missing).unionByName(issue(front.semantic_issues(parsed, options.front))).unionByName(issue(counted, "none")).unionByName(issue(found["issues"], "none")).unionByName(issue(bodies, "none"))
    rank = Window.partitionBy("doc_id").orderBy("code", "inid")
    issues = issues.distinct().withColumn("seq", F.row_number().over(rank).cast("long")).withColumn("message", F.col("code"))
    issues = stable(issues.select("doc_id", "seq", "severity", "code", "message", "inid"))
    state = diagnostics.status(issues, fail_on_error=options.fail_on_error)
    lost = front.failed(missing, options.front).withColumn("_lost", F.lit(options.fail_on_missing_fields))
    status = docs.join(state, "doc_id", "left").join(lost, "doc_id", "left").select("doc_id", F.when(F.coalesce("_lost", F.lit(False)), "failed").otherwise(F.coalesce("status", F.lit("ok"))).alias("status"))
    names = sheets.select("doc_id", F.explode("pages").alias("page")).select("doc_id", "page", drawings.sheet_name(F.col("page")).alias("path"))
    return {"front": parsed, "sections": found["sections"], "claims": found["claims"], "figures": found["figures"], "facts": found["facts"], "drawings": names, "issues": issues, "status": status, "pages": read["pages"]}


def report(issues: DataFrame, parsed: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(n_docs, n_issues, mean_citations) of a corpus, and its most frequent warnings."""
    facts = parsed.agg(F.count("*").alias("n_docs"), F.avg(F.greatest(F.coalesce(F.size("cited"), F.lit(0)), F.lit(0))).alias("mean_citations"))
    return facts.crossJoin(F.broadcast(issues.agg(F.count("*").alias("n_issues")))), diagnostics.histogram(issues, most)
