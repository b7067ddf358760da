"""Lines, columns, headers, pages and blocks: words(page, ...), lines(page, pos, x, y, text)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.operators.sections import line_role, section_key

# Dates, sheet counts, publication numbers, field labels and kind codes; body headings, claims and their phrases.
DATE = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)\.?\s+\d{1,2},\s+\d{4}\b"
SHEET_OF = r"(?i)\b(?:sheet|page)\s+\d+\s+(?:of|/)\s+\d+\b"
PUBLISHED = (r"(?i)\bUS\s*\d{4}\s*/?\s*\d{6,8}\s*[A-Z0-9]{1,2}\b", r"(?i)\bUS\s*\d[\d,\s]*\s*[A-Z0-9]{1,2}\b", r"(?i)\bUS\d{7,11}[A-Z0-9]{1,2}\b")
LABEL = r"^\s*\(\s*(\d+)\s*\)"
KIND = r"(?i)\b(?:A1|A2|A9|B1|B2)\b"
BODY_HEADINGS = ("BACKGROUND", "BACKGROUND OF THE INVENTION", "SUMMARY", "SUMMARY OF THE INVENTION", "BRIEF DESCRIPTION OF THE DRAWINGS", "DETAILED DESCRIPTION",
                 "DETAILED DESCRIPTION OF THE EMBODIMENTS", "FIELD", "TECHNICAL FIELD", "DESCRIPTION", "CLAIMS")
BODY_START = r"(?i)^\s*(?:TECHNICAL FIELD|FIELD|BACKGROUND(?: ART| OF THE INVENTION)?|SUMMARY(?: OF THE INVENTION)?|DETAILED DESCRIPTION(?: OF THE EMBODIMENTS)?|BRIEF DESCRIPTION OF THE DRAWINGS|CLAIMS)\s*$"
CLAIMED = r"(?i)\bwhat\s+is\s+claimed\s+is\b"
CLAIM_LINE = r"^\s*\d{1,3}\.\s+\S"
ADMIN_PAGE = r"(?i)\bCERTIFICATE\s+OF\s+CORRECTION\b|\bUNITED\s+STATES\s+PATENT\s+AND\s+TRADEMARK\s+OFFICE\b"
SENTENCE_END = r"[.!?][\"')\]]?\s*$"


def likely_line_number(c: Column) -> Column:
    """Short words of digits, apart from "(n)" and "n."."""
    t = F.trim(c)
    return (F.length(t) <= 6) & ~t.rlike(r"^\(\d+\)$") & ~t.rlike(r"^\d{1,3}\.$") & (t.rlike(r"^\d+$") | ((F.length(t) <= 4) & t.rlike(r"\d")))


def header_metadata(c: Column) -> Column:
    """Whether a line is a running header: a publication number, a date, a sheet count, or a kind code beside digits."""
    t = F.trim(c)
    found = [t.rlike(p) for p in (*PUBLISHED, DATE, SHEET_OF, r"(?i)\bpatent application publication\b")]
    return F.greatest(*found, t.rlike(KIND) & t.rlike(r"\d"))


def running_header(c: Column) -> Column:
    """Whether a text reads like a running header: a publication number, a date, a sheet count or a kind code."""
    return F.greatest(*[c.rlike(p) for p in (*PUBLISHED[:2], DATE, SHEET_OF, KIND)])


def clusters(words: DataFrame, line: list[str], gap: float = 15.0) -> DataFrame:
    """The words with `cluster`: a new one after each gap of at least `gap` to the previous word."""
    by = Window.partitionBy(*line).orderBy("x0", "x1")
    far = F.when(F.col("x0") - F.lag("x1").over(by) >= gap, 1).otherwise(0)
    return words.withColumn("_far", far).withColumn("cluster", F.sum("_far").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")


def joined_words(words: DataFrame, by: list[str]) -> DataFrame:
    """One line of text for each group: no space before marks, after opening brackets and after a hyphen."""
    rows = words.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("w"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    spaced = F.array_join(F.transform("w", lambda w: w["text"]), " ")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(spaced, r" ([,.;:)\]}%])", "$1"), r"([(\[{]) ", "$1"), r"- ", "-")
    return rows.select(*by, "x0", "x1", text.alias("text"))


def footer_cutoff(lines: DataFrame, page: list[str], height: float, gap: float = 45.0, least: int = 6, share: float = 0.55) -> DataFrame:
    """page, cutoff: the middle of the largest gap in the lower part of pages with enough lines."""
    by = Window.partitionBy(*page).orderBy("y")
    gaps = lines.withColumn("next", F.lead("y").over(by)).withColumn("n", F.count("*").over(Window.partitionBy(*page)))
    wide = gaps.where((F.col("n") >= least) & (F.col("next") - F.col("y") >= gap) & (F.col("y") >= share * height))
    return wide.groupBy(*page).agg(F.max_by((F.col("y") + F.col("next")) / 2, F.struct(F.col("next") - F.col("y"), -F.col("y"))).alias("cutoff"))


def densest_band(lines: DataFrame, page: list[str], tall: int = 30) -> DataFrame:
    """page, low, high, n: the first densest band of lines at most `tall` high, of two lines or more."""
    by = Window.partitionBy(*page).orderBy("y").rangeBetween(-tall, 0)
    near = lines.withColumn("n", F.count("*").over(by)).withColumn("low", F.min("y").over(by))
    return near.groupBy(*page).agg(F.max_by(F.struct("low", F.col("y").alias("high"), "n"), F.struct("n", -F.col("y"))).alias("b")).where("b.n >= 2").select(*page, "b.*")


def split_header(lines: DataFrame, page: list[str], height: float) -> DataFrame:
    """The lines(page, pos, y, text) with `region`, header or body.

    The header ends 4 below the densest band of the page's upper 22 %.  If the band reads like a running header, it ends
    by 80 or a tenth of the page; else the first wide gap from there on, if any, ends it.  Without a band all is body.
    """
    band = densest_band(lines.where(F.col("y") <= 0.22 * height), page).drop("n")
    rows = lines.join(band, page, "left")
    within = F.when(F.col("y").between(F.col("low"), F.col("high")), F.struct("y", "pos", F.trim("text").alias("text")))
    title = F.array_join(F.transform(F.array_sort(F.collect_list(within)), lambda r: r["text"]), " ")
    by = Window.partitionBy(*page).orderBy("y", "pos")
    scan = rows.where((F.col("y") <= 0.45 * height) & (F.col("y") >= F.col("low") - 2)).withColumn("gap", F.lead("y").over(by) - F.col("y"))
    facts = scan.groupBy(*page).agg(title.alias("title"), F.count("*").alias("n"), F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(10.0)).alias("typical"))
    wide = scan.join(facts.where("n >= 6"), page).where((F.col("y") >= F.col("high") + 4) & (F.col("gap") >= F.greatest(F.lit(24.0), 2.5 * F.col("typical"))))
    ends = facts.join(band, page).join(wide.groupBy(*page).agg(F.min("y").alias("edge")), page, "left")
    end = F.when(running_header(F.col("title")), F.least(F.col("high") + 4, F.lit(min(80.0, 0.1 * height)))).otherwise(F.coalesce("edge", "high") + 4)
    split = lines.join(ends.select(*page, end.alias("_end")), page, "left")
    return split.withColumn("region", F.when(F.col("y") <= F.col("_end"), "header").otherwise("body")).drop("_end")


def rescue(lines: DataFrame, page: list[str], code: int = 54, most: int = 4, reach: float = 20.0) -> DataFrame:
    """lines(page, col, pos, y, text, region): up to `most` header lines of a column that stand close above the body's first "(code)" join the body.

    They are taken from the header's end upwards, as far as the first field label or line out of reach.
    """
    anchor = F.min(F.when((F.col("region") == "body") & F.trim("text").startswith(f"({code})"), F.col("y"))).over(Window.partitionBy(*page))
    up = Window.partitionBy(*page, "col", "region").orderBy(F.desc("y"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_above", anchor - F.col("y")).withColumn("_text", F.trim("text"))
    near = (F.col("_above") > 0) & (F.col("_above") <= reach) & ~F.col("_text").rlike(LABEL)
    rows = rows.withColumn("_near", F.coalesce(near, F.lit(False))).withColumn("_open", F.min("_near").over(up)).withColumn("_n", F.count_if(F.col("_text") != "").over(up))
    moved = (F.col("region") == "header") & F.col("_open") & (F.col("_text") != "") & (F.col("_n") <= most)
    return rows.withColumn("region", F.when(moved, "body").otherwise(F.col("region"))).drop("_above", "_text", "_near", "_open", "_n")


def field_blocks(lines: DataFrame, column: list[str], window: float = 90.0, span: float = 900.0, gap: float = 70.0) -> DataFrame:
    """column, first, kind, tag, text, y0, y1 of lines(column, pos, y, y0, y1, text): field blocks and runs without label.

    A label "(n)" takes the lines below it, up to min(window, 0.4 distance) before the next label or to a gap over `gap`,
    and lines within that distance above it that the label before didn't take.  The text is label, above, below.
    """
    by = Window.partitionBy(*column).orderBy("pos")
    before, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(1, Window.unboundedFollowing)
    label = F.col("text").rlike(LABEL)
    rows = lines.withColumn("_tag", F.when(label, F.regexp_extract("text", LABEL, 1).try_cast("int"))).withColumn("_gap", F.col("y") - F.lag("y").over(by))
    rows = rows.withColumn("_next", F.first(F.when(label, F.col("y")), ignorenulls=True).over(after))
    buffer = F.when(F.col("_next").isNull(), F.lit(window)).otherwise(F.least(F.lit(window), 0.4 * F.greatest(F.lit(0.0), F.col("_next") - F.col("y"))))
    stop = F.when(F.col("_next").isNull(), F.col("y") + span).otherwise(F.greatest(F.col("y") + 1e-3, F.col("_next") - buffer))
    rows = rows.withColumn("_own", F.when(label, F.struct(F.col("pos"), F.col("y"), buffer.alias("buffer"), stop.alias("stop"))))
    rows = rows.withColumn("_up", F.last("_own", ignorenulls=True).over(before)).withColumn("_down", F.first("_own", ignorenulls=True).over(after))
    mine = Window.partitionBy(*column, "_up.pos").orderBy("pos")
    far = ~label & ((F.col("y") >= F.col("_up.stop")) | (F.col("_gap") > gap))
    start = F.greatest(F.col("_up.stop"), F.col("_down.y") - F.col("_down.buffer"))
    low = F.col("y") < start
    rows = rows.withColumn("_below", F.col("_up").isNotNull() & ~F.coalesce(F.max(far).over(mine.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    rows = rows.withColumn("_above", F.col("_down").isNotNull() & ~label & ~F.coalesce(F.max(low).over(mine.rowsBetween(0, Window.unboundedFollowing)), F.lit(True)))
    place = F.when(label, 0).when(F.col("_above"), 1).when(F.col("_below"), 2)
    first = F.when(label | (F.col("_below") & ~F.col("_above")), F.col("_up.pos")).when(F.col("_above"), F.col("_down.pos"))
    rows = rows.withColumn("_place", place).withColumn("_label", first)
    bare = F.when(F.col("_label").isNull() & F.coalesce(F.lag("_label").over(by).isNotNull() | (F.lag("pos").over(by).isNull()), F.lit(True)), 1).otherwise(0)
    rows = rows.withColumn("_run", F.when(F.col("_label").isNull(), F.sum(bare).over(before)))
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("_place", "pos", "text"))))
    out = rows.groupBy(*column, "_label", "_run").agg(
        F.min("pos").alias("first"), F.max("_tag").alias("tag"), F.trim(F.array_join(F.transform(parts, lambda r: r["text"]), "\n")).alias("text"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    kind = F.when(F.col("_label").isNull(), "unlabelled").otherwise("inid")
    return out.where("_label is not null or text <> ''").select(*column, "first", kind.alias("kind"), "tag", "text", "y0", "y1")


def median_width(lines: DataFrame, page: list[str], width: str) -> DataFrame:
    """page, median (true), upper (the upper one of the two middles)."""
    return lines.groupBy(*page).agg(F.median(width).alias("median"), F.element_at(F.array_sort(F.collect_list(width)), (F.floor(F.count("*") / 2) + 1).cast("int")).alias("upper"))


def binned_mode(lines: DataFrame, page: list[str], value: str, bin_: float = 2.0) -> DataFrame:
    """page, mode: the bin that holds most values, the smallest of those."""
    binned = lines.groupBy(*page, (F.bround(F.col(value) / bin_) * bin_).alias("mode")).count()
    return binned.groupBy(*page).agg(F.max_by("mode", F.struct("count", -F.col("mode"))).alias("mode"))


def page_signals(lines: DataFrame, page: list[str]) -> DataFrame:
    """page, kind: drawing, admin, inid, body or unknown; from lines(page, pos, text), with col and region where they are known.

    Sheet counts are looked for in the header, or in the first three lines where no region is known; the rest in the
    body: heading lines among the first 80, the claims phrase in the first 60, a line CLAIMS among the first 80, two claims
    among the first 120, or many lines of some length.
    """
    has = lambda c: c in lines.columns
    rows = lines.withColumn("t", F.trim("text")).where("t <> ''")
    order = [c for c in ("col", "pos") if has(c)]
    if has("region"):
        region = F.col("region")
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*page, "region").orderBy(*order)))
        sheet = F.max(F.col("t").rlike(r"(?i)\bSheet\s+\d+\s+of\s+\d+\b") & (region == "header"))
        body = region == "body"
    else:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*page).orderBy(*order)))
        sheet, body = F.max(F.when(F.col("n") <= 3, F.col("t").rlike(SHEET_OF)).otherwise(F.lit(False))), F.lit(True)
    first = lambda k: body & (F.col("n") <= k)
    head = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(first(k), F.struct("n", "t")))), lambda r: r["t"]), " ")
    facts = rows.groupBy(*page).agg(
        sheet.alias("sheet"), head(60).alias("head"), F.count_if(body & F.col("t").rlike(r"^\(\s*\d+\s*\)")).alias("inids"),
        F.max(first(80) & F.upper("t").isin(*BODY_HEADINGS)).alias("heading"), F.count_if(first(120) & F.col("t").rlike(CLAIM_LINE)).alias("numbered"),
        F.count_if(body).alias("lines"), F.coalesce(F.median(F.when(body, F.length("t"))), F.lit(0)).cast("int").alias("median"))
    kind = (
        F.when(F.col("sheet"), "drawing").when(F.col("head").rlike(ADMIN_PAGE), "admin").when(F.col("inids") >= 3, "inid")
        .when(F.col("heading") | F.col("head").rlike(CLAIMED) | (F.col("numbered") >= 2) | ((F.col("lines") >= 18) & (F.col("median") >= 18)), "body").otherwise("unknown"))
    return facts.select(*page, kind.alias("kind"), "inids", "lines", "median")


def body_starts(lines: DataFrame, page: list[str]) -> DataFrame:
    """page, starts: whether the first 120 lines hold a body heading, the claims phrase or two claims."""
    order = [c for c in ("col", "pos") if c in lines.columns]
    region = [F.desc("region")] if "region" in lines.columns else []  # headers before bodies
    rows = lines.withColumn("t", F.trim(F.regexp_replace(F.translate("text", "\u00a0", " "), r"\s+", " "))).where("t <> ''")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*page).orderBy(*region, *order))).where("n <= 120")
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda r: r["t"]), " ")
    starts = F.max(F.col("t").rlike(BODY_START)) | head.rlike(CLAIMED) | (F.count_if(F.col("t").rlike(CLAIM_LINE)) >= 2)
    return rows.groupBy(*page).agg(starts.alias("starts"))


def front_matter_pages(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """pages(doc, page, kind, starts) with front matter continued.

    If the first page that isn't admin is an inid page, the pages after it up to the first drawing, admin or body page,
    or the first whose text starts the body, are inid pages too.
    """
    by = Window.partitionBy(doc)
    first = F.min(F.when(F.col("kind") != "admin", F.struct("page", "kind"))).over(by)
    rows = pages.withColumn("_first", first)
    stops = (F.col("page") > F.col("_first.page")) & (F.col("kind").isin("drawing", "admin", "body") | F.coalesce("starts", F.lit(False)))
    rows = rows.withColumn("_stop", F.min(F.when(stops, F.col("page"))).over(by))
    inside = (F.col("_first.kind") == "inid") & (F.col("page") > F.col("_first.page")) & (F.col("_stop").isNull() | (F.col("page") < F.col("_stop")))
    return rows.select(doc, "page", F.when(inside, "inid").otherwise(F.col("kind")).alias("kind"))


def page_sets(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, drawing, body, inid: the pages of each kind in order; inid pages are those before the cutoff."""
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("page"))))
    rows = pages.join(inid_cutoff(pages, doc), doc)
    return rows.groupBy(doc).agg(pick(F.col("kind") == "drawing").alias("drawing"), pick(F.col("kind") == "body").alias("body"), pick(F.col("page") < F.col("cutoff")).alias("inid"))


def smooth_drawings(pages: DataFrame, doc: str = "doc_id", most: int = 2) -> DataFrame:
    """pages(doc, page, kind): up to `most` unknown pages in a row between drawings become drawings."""
    by = Window.partitionBy(doc).orderBy("page")
    known = F.when(F.col("kind") != "unknown", F.struct("page", "kind"))
    near = pages.withColumn("before", F.last(known, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(known, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    island = (F.col("kind") == "unknown") & (F.col("before.kind") == "drawing") & (F.col("after.kind") == "drawing") & (F.col("after.page") - F.col("before.page") - 1 <= most)
    return near.select(doc, "page", F.when(island, "drawing").otherwise(F.col("kind")).alias("kind"))


def inid_cutoff(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, cutoff: the first drawing or body page after the first inid page; without one the number of pages, without inid pages 0."""
    first = F.min(F.when(F.col("kind") == "inid", F.col("page"))).over(Window.partitionBy(doc))
    rows = pages.withColumn("first", first)
    stop = F.min(F.when(F.col("kind").isin("drawing", "body") & (F.col("page") > F.col("first")), F.col("page")))
    return rows.groupBy(doc).agg(F.when(F.max("first").isNull(), F.lit(0)).otherwise(F.coalesce(stop, F.max("page") + 1)).alias("cutoff"))


def paragraphs(lines: DataFrame, page: list[str], left: str = "x", right: str | None = None) -> DataFrame:
    """page, block, kind, text, y0, y1: lines(page, pos, y, text, left, right) gathered to headings, subheadings and paragraphs.

    A heading or subheading is a block.  A claim number alone on its line and a paragraph number start a paragraph; other
    labels never do.  Another line starts one after a gap of at least max(16, 2.4 median gaps); at an indent of 10 or more
    after a line at the margin that ended a sentence or was short; at the margin after an indented line; and at the margin
    after a short line that ended a sentence.  The margin is the binned mode of long lines, which are of prose and have 35
    characters or more; short is under 0.62 of their median width or, without widths, under 45 characters.
    """
    by = Window.partitionBy(*page).orderBy("pos")
    rows = lines.where(F.trim("text") != "").withColumn("_t", F.trim("text")).withColumn("role", line_role(F.col("text"))).withColumn("gap", F.col("y") - F.lag("y").over(by))
    alone = F.col("role").isin("section_heading", "subheading")
    long = rows.where(~alone & (F.length("_t") >= 35) & F.col(left).isNotNull() & (F.col(right).isNotNull() if right else F.lit(True)))
    width = F.col(right) - F.col(left) if right else F.lit(None).cast("double")
    typical = rows.groupBy(*page).agg(F.coalesce(F.median(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(10.0)).alias("_gap"))
    typical = typical.join(binned_mode(long, page, left).withColumnRenamed("mode", "_margin"), page, "left").join(long.groupBy(*page).agg(F.median(width).alias("_width")), page, "left")
    rows = rows.join(typical, page)
    at_margin = lambda x: F.coalesce(F.abs(x - F.col("_margin")) <= 3.5, F.lit(False))
    indented = lambda x: F.coalesce(x - F.col("_margin") >= 10, F.lit(False))
    own = F.when(F.col("_width").isNull() | width.isNull(), F.length("_t") < 45).otherwise(width < 0.62 * F.col("_width"))
    rows = rows.withColumn("_short", own).withColumn("_ends", F.col("_t").rlike(SENTENCE_END))
    last = lambda c: F.lag(c).over(by)
    geometry = (
        (F.col("gap") >= F.greatest(F.lit(16.0), 2.4 * F.col("_gap"))) | (indented(F.col(left)) & (at_margin(last(left)) | last(left).isNull()) & (last("_ends") | last("_short")))
        | (at_margin(F.col(left)) & indented(last(left))) | (last("_short") & last("_ends") & at_margin(F.col(left))))
    opens = (
        F.when(alone | F.coalesce(last("role").isin("section_heading", "subheading"), F.lit(True)) | (F.col("role") == "para_marker"), F.lit(True))
        .when(F.col("role") == "enumerator", F.col("_t").rlike(r"^\d{1,3}\s*\.$")).otherwise(F.coalesce(geometry, F.lit(False))))
    rows = rows.withColumn("_opens", opens.cast("int")).withColumn("block", F.sum("_opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda r: r["_t"]), "\n")
    return rows.groupBy(*page, "block").agg(F.coalesce(F.max(F.when(alone, F.col("role"))), F.lit("paragraph")).alias("kind"), text.alias("text"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def merged_headings(blocks: DataFrame, doc: list[str], gap: float = 6.0, overlap: float = 4.0) -> DataFrame:
    """blocks(doc, page, col, pos, kind, text, y0, y1) with headings over several lines as one.

    A section heading joins the one before it on its page and column if it starts at most `gap` below and `overlap` above
    that one's end, is no longer than 120 characters and ends no sentence.
    """
    by = Window.partitionBy(*doc).orderBy("pos")
    head = F.col("kind") == "section_heading"
    same = F.coalesce(head & (F.lag("kind").over(by) == "section_heading") & (F.lag("page").over(by) == F.col("page")) & (F.lag("col").over(by) == F.col("col")), F.lit(False))
    rows = blocks.withColumn("_run", F.sum((~same).cast("int")).over(by))
    fields = ["pos", "page", "col", "kind", "text", "y0", "y1"]
    runs = rows.groupBy(*doc, "_run").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("b"))
    begun = lambda b: F.struct(b["pos"].alias("pos"), b["page"].alias("page"), b["col"].alias("col"), b["kind"].alias("kind"), F.trim(b["text"]).alias("text"), b["y0"].alias("y0"), b["y1"].alias("y1"))
    plain = lambda b: F.struct(*[b[f].alias(f) for f in fields])

    def step(out: Column, b: Column) -> Column:
        last, t = F.element_at(out, -1), F.trim(b["text"])
        joins = (b["y0"] - last["y1"]).between(-overlap, gap) & (t != "") & (F.length(t) <= 120) & ~t.rlike(r"[.!?]\s*$")
        grown = F.struct(last["pos"].alias("pos"), last["page"].alias("page"), last["col"].alias("col"), last["kind"].alias("kind"), F.trim(F.concat(last["text"], F.lit(" "), t)).alias("text"), last["y0"].alias("y0"), F.greatest(last["y1"], b["y1"]).alias("y1"))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(grown))).otherwise(F.concat(out, F.array(begun(b))))

    first = F.get("b", F.lit(0))
    folded = F.aggregate(F.slice("b", F.lit(2), F.size("b")), F.array(begun(first)), step)
    whole = F.when(first["kind"] == "section_heading", folded).otherwise(F.transform("b", plain))
    return runs.select(*doc, F.inline(whole))


def stitched(blocks: DataFrame, doc: str = "doc_id", top: float = 220.0) -> DataFrame:
    """blocks(doc, page, pos, col, y0, kind, tag, text) with field texts continued across pages.

    Text that stands at the top of a page before any field, where the page's top holds no field label, joins the last field
    of its column on earlier pages, or else the last field of any column, and goes from its own page.
    """
    labelled = (F.col("kind") == "inid") & F.col("tag").isNotNull()
    page = Window.partitionBy(doc, "page")
    down = page.orderBy("y0", "col", "pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("_stops", F.max((F.col("kind") == "inid") | (F.col("y0") > top)).over(down)).withColumn("_fresh", F.max(labelled & (F.col("y0") <= top)).over(page))
    field = F.when(labelled, F.struct("page", "pos"))
    earlier = lambda *by: F.max(field).over(Window.partitionBy(doc, *by).orderBy("page").rangeBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_to", F.when(~F.col("_stops") & ~F.col("_fresh") & (F.trim("text") != ""), F.coalesce(earlier("col"), earlier())))
    moved = rows.where("_to is not null").groupBy(doc, F.col("_to.page").alias("page"), F.col("_to.pos").alias("pos"))
    added = moved.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("page").alias("p"), "y0", "col", F.col("pos").alias("k"), F.trim("text").alias("text")))), lambda r: r["text"]), "\n").alias("_added"))
    out = rows.where("_to is null").join(added, [doc, "page", "pos"], "left")
    return out.withColumn("text", F.when(F.col("_added").isNull(), F.col("text")).otherwise(F.trim(F.concat(F.rtrim("text"), F.lit("\n"), F.col("_added"))))).select(*blocks.columns)


def tagged_texts(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, tag, text: blocks(doc, pos, tag, text) of a tag in order, without consecutive repeats, joined by line ends."""
    by = Window.partitionBy(doc, "tag").orderBy("pos")
    rows = blocks.withColumn("_last", F.lag("text").over(by)).where("_last is null or _last <> text")
    return rows.groupBy(doc, "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "\n").alias("text"))


def carry_forward(rows: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """The last value that isn't null, so far."""
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order)))


def group_lines(words: DataFrame, page: list[str], near: float = 3.0) -> DataFrame:
    """The words with `line`: each joins the first line, in order of their making, whose key is within `near` of its middle.

    Keys are whole numbers, so each word looks at a few of them.  The result depends on the words' order, so it is made
    page by page in order of word_no.
    """
    import math

    def numbered(batches):
        for batch in batches:
            out = []
            for middles in batch.column("_y").to_pylist():
                keys, line = {}, []
                for y in middles:
                    hits = [keys[k] for k in range(math.ceil(y - near), math.floor(y + near) + 1) if k in keys]
                    line.append(min(hits) if hits else keys.setdefault(int(y), len(keys)))
                out.append(line)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "_line"])

    rest = [c for c in words.columns if c not in page]
    whole = words.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("word_no", *[c for c in rest if c != "word_no"]))).alias("_w"))
    whole = whole.withColumn("_y", F.transform("_w", lambda w: (w["y0"] + w["y1"]) / 2))
    made = whole.mapInArrow(numbered, T.StructType([*whole.schema, T.StructField("_line", T.ArrayType(T.IntegerType()))]))
    fields = lambda w, k: F.struct(*[w[c].alias(c) for c in rest], k.alias("line"))
    return made.select(*page, F.inline(F.zip_with("_w", "_line", fields)))
