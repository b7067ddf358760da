"""Drawing sheets: boxes(page, k, x0, y0, x1, y1) and labels, in pixels of a sheet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SIDES = ("x0", "y0", "x1", "y1")
# Words that announce a figure, with its number and without, numbers of figures, and the mark of a sheet.
FIG = r"(?i)^fig\.?$"
FIG_WITH = r"(?i)^fig\.?([0-9]+[a-z]?)$"
FIG_NUMBER = r"^[0-9]+[A-Za-z]?$"
SHEET_OF = r"(?i)\bSheet\s+[0-9A-Za-z]+\s+of\s+[0-9]+\b"


@dataclass(frozen=True)
class Settings:
    """Lengths in pixels, shares of a sheet and penalties of the assignment of ink to figures."""

    dpi: int = 200
    merge_gap: int = 12
    crop_margin: int = 12
    label_pad: int = 12
    below_penalty: float = 3.0
    overlap_penalty: float = 5.0
    overlap: float = 0.10
    least_area: float = 0.02
    radius: float = 0.60


@dataclass(frozen=True)
class SheetPolicy:
    """What a document's drawing sheets must hold, and what fails them."""

    warnings_are_errors: bool = False
    least_one_region: bool = True
    strict_count: bool = False
    validate_marker: bool = False
    least_marker_rate: float = 0.4
    strict_marker: bool = False


def area(p: str = "") -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{p}x1") - F.col(f"{p}x0")) * F.greatest(F.lit(0.0), F.col(f"{p}y1") - F.col(f"{p}y0"))


def overlap(a: str, b: str) -> Column:
    """The area that two boxes share."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}{hi}"), F.col(f"{b}{hi}")) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")))
    return side("x0", "x1") * side("y0", "y1")


def middle(p: str = "") -> tuple[Column, Column]:
    return (F.col(f"{p}x0") + F.col(f"{p}x1")) / 2, (F.col(f"{p}y0") + F.col(f"{p}y1")) / 2


def normalised(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Sides as shares of the sheet, within 0 and 1."""
    return boxes.withColumns({s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(s) / (width if s[0] == "x" else height))) for s in SIDES})


def pixels(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Whole pixels of normalised boxes, at least one wide and high."""
    out = boxes.withColumns({s: (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(s))) * (width if s[0] == "x" else height)).cast("int") for s in SIDES})
    return out.withColumns({"x1": F.greatest(F.col("x1"), F.col("x0") + 1), "y1": F.greatest(F.col("y1"), F.col("y0") + 1)})


def padded(boxes: DataFrame, by: float, width: float, height: float) -> DataFrame:
    grow = {"x0": F.greatest(F.lit(0.0), F.col("x0") - by), "y0": F.greatest(F.lit(0.0), F.col("y0") - by), "x1": F.least(F.lit(float(width)), F.col("x1") + by), "y1": F.least(F.lit(float(height)), F.col("y1") + by)}
    return boxes.withColumns(grow)


def union_box(boxes: DataFrame, by: list[str]) -> DataFrame:
    return boxes.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def header_cut(boxes: DataFrame, width: float, height: float, page: str = "page") -> DataFrame:
    """page, cut: below the lowest wide, flat box of the top quarter; else a tenth of the height."""
    wide = (F.col("x1") - F.col("x0") >= 0.45 * width) & (F.col("y1") - F.col("y0") <= 0.18 * height) & (F.col("y1") <= 0.25 * height)
    return boxes.groupBy(page).agg(F.coalesce(F.max(F.when(wide, F.col("y1") + 0.01 * height)), F.lit(0.10 * height)).alias("cut"))


def assign(parts: DataFrame, labels: DataFrame, page: str = "page") -> DataFrame:
    """page, k, label, score: the label with the least squared distance for each part, trebled if the part lies above the label's foot, five-fold if it overlaps the label.

    Parts meet the labels of their own page only, of which a sheet has a few.
    """
    both = parts.alias("p").join(labels.select(page, F.col("k").alias("label"), *[F.col(s).alias(f"l_{s}") for s in SIDES]).alias("l"), page)
    (px, py), (lx, ly) = middle(), middle("l_")
    far = (px - lx) * (px - lx) + (py - ly) * (py - ly)
    score = far * F.when(py > ly, 3.0).otherwise(1.0) * F.when((area() > 0) & (overlap("", "l_") / area() >= 0.10), 5.0).otherwise(1.0)
    rank = Window.partitionBy(page, "k").orderBy("score", "label")
    return both.withColumn("score", score).withColumn("_n", F.row_number().over(rank)).where("_n = 1").select(page, "k", "label", "score")


def partition_boxes(labels: DataFrame, page: str = "page", clamp: bool = False) -> DataFrame:
    """page, k and the cell of each label: half way to the next smaller and larger x and y of the page's labels.

    With `clamp`, for shares of a sheet, cells stay within 0 and 1, and one that is flat reaches 0.25 to both sides of its label.
    """
    x, y = middle()
    at = labels.select(page, "k", x.alias("x"), y.alias("y"))
    for c, low, high in (("x", "x0", "x1"), ("y", "y0", "y1")):
        spots = at.select(page, c).distinct()
        by = Window.partitionBy(page).orderBy(c)
        near = spots.withColumn(low, F.coalesce((F.lag(c).over(by) + F.col(c)) / 2, F.lit(0.0))).withColumn(high, F.coalesce((F.lead(c).over(by) + F.col(c)) / 2, F.lit(1.0)))
        wide = near.withColumns({s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(s))) for s in (low, high)}) if clamp else near
        flat = F.col(high) <= F.col(low) if clamp else F.lit(False)
        near = wide.select(page, c, F.when(flat, F.greatest(F.lit(0.0), F.col(c) - 0.25)).otherwise(F.col(low)).alias(low), F.when(flat, F.least(F.lit(1.0), F.col(c) + 0.25)).otherwise(F.col(high)).alias(high))
        at = at.join(near, [page, c])
    return at.select(page, "k", *SIDES)


def image_boxes(blocks: DataFrame) -> DataFrame:
    """The boxes of the image blocks(type, sides), type 1, that aren't empty."""
    return blocks.where((F.col("type") == 1) & (area() > 0))


def without_overlapped(lines: DataFrame, images: DataFrame, page: str = "page", down: float = 0.60, across: float = 0.25, sheet: float | None = None, ground: float = 0.45) -> DataFrame:
    """Lines that no image of their page covers to these shares of their height and width.

    With `sheet`, the area of a page, images of at least the share `ground` of it are backgrounds and cover nothing.
    """
    images = images.where(area() < ground * sheet) if sheet else images
    im = images.select(page, *[F.col(s).alias(f"i_{s}") for s in SIDES])
    v = F.least(F.col("y1"), F.col("i_y1")) - F.greatest(F.col("y0"), F.col("i_y0"))
    h = F.least(F.col("x1"), F.col("i_x1")) - F.greatest(F.col("x0"), F.col("i_x0"))
    a, b = lines.alias("a"), im.alias("b")
    covered = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (v >= down * (F.col("y1") - F.col("y0"))) & (h >= across * (F.col("x1") - F.col("x0")))
    return a.join(b, covered, "left_anti")


def below_header(parts: DataFrame, cuts: DataFrame, page: str = "page") -> DataFrame:
    """The parts whose middle isn't above their page's cut(page, cut)."""
    return parts.join(cuts, page).where(middle()[1] >= F.col("cut")).drop("cut")


def figure_labels(words: DataFrame, page: str = "page") -> DataFrame:
    """page, label, sides: the first place of each figure label among words(page, block_no, line_no, word_no, sides, text).

    A label is a word such as FIG.3A, or a word FIG. and the number next to it, with a point between at most.
    """
    by = Window.partitionBy(page, "block_no", "line_no").orderBy("x0", "word_no")
    begins = F.min("word_no").over(Window.partitionBy(page, "block_no", "line_no"))
    word = F.struct(*SIDES, F.trim("text").alias("text"))
    rows = words.where(F.trim("text") != "").withColumn("_line", begins).withColumn("_w", word)
    rows = rows.withColumn("_one", F.lead("_w", 1).over(by)).withColumn("_two", F.lead("_w", 2).over(by))
    follows = F.when(F.col("_one.text") == ".", F.col("_two")).otherwise(F.col("_one"))
    rows = rows.withColumn("_next", follows)
    whole, pair = F.col("_w.text").rlike(FIG_WITH), F.col("_w.text").rlike(FIG) & F.col("_next.text").rlike(FIG_NUMBER)
    label = F.when(whole, F.upper(F.regexp_extract("_w.text", FIG_WITH, 1))).when(pair, F.upper("_next.text"))
    side = lambda s: F.when(whole, F.col(f"_w.{s}")).otherwise((F.least if s[1] == "0" else F.greatest)(f"_w.{s}", f"_next.{s}")).alias(s)
    found = rows.select(page, label.alias("label"), "_line", F.col("x0").alias("_x"), "word_no", F.struct(*[side(s) for s in SIDES]).alias("_box")).where("label is not null")
    return found.groupBy(page, "label").agg(F.min_by("_box", F.struct("_line", "_x", "word_no")).alias("b")).select(page, "label", *[F.col(f"b.{s}").alias(s) for s in SIDES])


def token_labels(tokens: DataFrame, page: str = "page", reach: float = 220.0) -> DataFrame:
    """page, label, conf, sides: figure labels from recognised tokens(page, n, t, conf, x, y, w, h), the surest of each.

    A token such as FIG.3A is a label (the last one of a label counts), as are a token FIG. and a number to its right, at
    most `reach` away and at about its height; a pair is as sure as the less sure of the two and wins only if it is surer.
    """
    rows = tokens.select(page, "n", F.trim("t").alias("t"), "conf", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"), "h")
    box = lambda p="": F.struct(*[F.col(f"{p}{s}").alias(s) for s in SIDES])
    whole = rows.where(F.col("t").rlike(FIG_WITH)).select(page, F.upper(F.regexp_extract("t", FIG_WITH, 1)).alias("label"), "conf", "n", box().alias("b"))
    whole = whole.groupBy(page, "label").agg(F.max_by(F.struct("conf", "b"), "n").alias("w")).select(page, "label", "w.conf", F.lit(1).alias("_whole"), F.lit(0).cast("long").alias("_f"), F.lit(0).cast("long").alias("_n"), "w.b")
    fig, number = rows.where(F.col("t").rlike(FIG)).alias("f"), rows.where(F.col("t").rlike(FIG_NUMBER)).alias("d")
    level = F.abs((F.col("d.y0") + F.col("d.h") / 2) - (F.col("f.y0") + F.col("f.h") / 2)) <= F.greatest(F.lit(12.0), F.col("f.h"))
    both = fig.join(number, (F.col(f"f.{page}") == F.col(f"d.{page}")) & level & (F.col("d.x0") - F.col("f.x1")).between(0, reach))
    union = F.struct(*[(F.least if s[1] == "0" else F.greatest)(f"f.{s}", f"d.{s}").alias(s) for s in SIDES])
    pairs = both.select(F.col(f"f.{page}").alias(page), F.upper("d.t").alias("label"), F.least("f.conf", "d.conf").alias("conf"), F.lit(0).alias("_whole"), F.col("f.n").cast("long").alias("_f"), F.col("d.n").cast("long").alias("_n"), union.alias("b"))
    best = whole.unionByName(pairs).groupBy(page, "label").agg(F.max_by(F.struct("conf", "b"), F.struct("conf", "_whole", -F.col("_f"), -F.col("_n"))).alias("m"))
    return best.select(page, "label", F.col("m.conf").alias("conf"), *[F.col(f"m.b.{s}").alias(s) for s in SIDES])


def crops(labels: DataFrame, parts: DataFrame, width: int, height: int, page: str = "page", how: Settings = Settings()) -> DataFrame:
    """page, k, sides, used_radius, used_partition, confidence: the region of each label(page, k, sides), in pixels.

    A label's region is the box around the parts that are assigned to it and don't cover it, below the sheet's header.  One
    under a fiftieth of the sheet grows to the parts above the label within a radius, if that isn't smaller; without parts
    the label's cell of the sheet takes its place.
    """
    padded_labels = padded(labels.select(page, "k", *SIDES), how.label_pad, width, height)
    cuts = labels.select(page).distinct().join(header_cut(parts, width, height, page), page, "left").select(page, F.coalesce("cut", F.lit(0.10 * height)).alias("cut"))
    own = padded_labels.select(page, F.col("k").alias("label"), *[F.col(s).alias(f"l_{s}") for s in SIDES])
    clear = ~((area() > 0) & (overlap("", "l_") / area() >= how.overlap))
    taken = assign(below_header(parts, cuts, page), padded_labels, page).select(page, "k", "label")
    mine = parts.join(taken, [page, "k"]).join(own, [page, "label"]).where(clear)
    box = lambda rows: padded(union_box(rows, [page, "label"]), how.crop_margin, width, height)
    first = box(mine).join(cuts, page).withColumn("y0", F.greatest("y0", "cut")).select(page, "label", *SIDES, area().alias("_area"))
    (px, py), (lx, ly) = middle(), middle("l_")
    near = (py <= ly) & ((px - lx) * (px - lx) + (py - ly) * (py - ly) <= (how.radius * max(width, height)) ** 2)
    small = first.where(F.col("_area") / (width * height) < how.least_area).select(page, "label")
    around = box(parts.join(own.join(small, [page, "label"]), page).where(clear & near)).select(page, "label", *[F.col(s).alias(f"r_{s}") for s in SIDES])
    cells = padded(pixels(partition_boxes(normalised(labels, width, height), page, clamp=True), width, height), how.crop_margin, width, height)
    rows = labels.select(page, F.col("k").alias("label")).join(first, [page, "label"], "left").join(around, [page, "label"], "left")
    rows = rows.join(cells.select(page, F.col("k").alias("label"), *[F.col(s).alias(f"p_{s}") for s in SIDES]), [page, "label"])
    grown = F.coalesce(area("r_") >= F.col("_area"), F.lit(False))
    side = lambda s: F.when(F.col("_area").isNull(), F.col(f"p_{s}")).when(F.col("_grown"), F.col(f"r_{s}")).otherwise(F.col(s)).cast("double").alias(s)
    rows = rows.withColumn("_grown", grown)
    bare = F.col("_area").isNull()
    return rows.select(page, F.col("label").alias("k"), *[side(s) for s in SIDES], F.col("_grown").alias("used_radius"), bare.alias("used_partition"), F.when(bare, 0.4).otherwise(0.6).alias("confidence"))


def sheet_regions(words: DataFrame, tokens: DataFrame, parts: DataFrame, width: int, height: int, page: str = "page", how: Settings = Settings()) -> DataFrame:
    """page, k, figure, source and what crops() gives: labels from a sheet's words, or from recognised tokens where these have none.

    Sheets without labels have no regions.
    """
    written = figure_labels(words, page).withColumn("source", F.lit("text"))
    seen = token_labels(tokens, page).drop("conf").withColumn("source", F.lit("ocr"))
    labels = written.unionByName(seen.join(written.select(page).distinct(), page, "left_anti"))
    number = F.regexp_extract("label", "^[0-9]+", 0).cast("int")
    order = Window.partitionBy(page).orderBy(number, F.regexp_extract("label", "[A-Z]$", 0))
    labels = labels.withColumn("k", F.row_number().over(order))
    return labels.select(page, "k", F.col("label").alias("figure"), "source").join(crops(labels, parts, width, height, page, how), [page, "k"])


def sheets(parses: DataFrame, expected: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(doc, pages, n_sheets, n_regions, dpis) and issues of parses(doc, page, seq, dpi, n_regions) against expected(doc, page).

    The first parse of a page counts; repeated, missing and unexpected pages give warnings.
    """
    first = Window.partitionBy(doc, "page").orderBy("seq")
    rows = parses.withColumn("_n", F.row_number().over(first))
    one = rows.where("_n = 1")
    facts = one.groupBy(doc).agg(F.array_sort(F.collect_list("page")).alias("pages"), F.count("*").alias("n_sheets"), F.sum("n_regions").cast("long").alias("n_regions"), F.array_sort(F.collect_set("dpi")).alias("dpis"))
    issue = lambda frame, code: frame.select(doc, F.lit("warning").alias("severity"), F.lit(f"drawing_sheets.{code}").alias("code"), F.col("page").cast("string").alias("detail"))
    lost, more = expected.join(one, [doc, "page"], "left_anti"), one.join(expected, [doc, "page"], "left_anti")
    return facts, issue(rows.where("_n > 1"), "duplicate_page").unionByName(issue(lost, "pages_missing")).unionByName(issue(more, "pages_unexpected"))


def marker_rate(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, rate: the share of the pages(doc, text) that carry "Sheet i of n"."""
    return pages.groupBy(doc).agg(F.avg(F.col("text").rlike(SHEET_OF).cast("double")).alias("rate"))


def sheet_status(facts: DataFrame, issues: DataFrame, wanted: DataFrame, policy: SheetPolicy = SheetPolicy(), doc: str = "doc_id") -> DataFrame:
    """doc, status, code: ok, partial or failed, and the issue that the counts add; wanted(doc, n_wanted) may be null."""
    n = issues.groupBy(doc).agg(F.count_if(F.col("severity") == "error").alias("_e"), F.count_if(F.col("severity") == "warning").alias("_w"))
    rows = wanted.join(facts, doc, "left").join(n, doc, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    errors = zero("_e") + (zero("_w") if policy.warnings_are_errors else F.lit(0))
    none, off = (zero("n_regions") == 0) if policy.least_one_region else F.lit(False), F.col("n_wanted").isNotNull() & (F.col("n_wanted") != F.col("n_sheets"))
    status = F.when(F.col("n_sheets").isNull() | (errors > 0) | none, "failed").when(off, "failed" if policy.strict_count else "partial").when(zero("_w") > 0, "partial").otherwise("ok")
    code = F.when(F.col("n_sheets").isNull() | (errors > 0), F.lit(None)).when(none, "drawing_sheets.none_found").when(off, "drawing_sheets.sheet_count_mismatch")
    return rows.select(doc, status.alias("status"), code.alias("code"))


def by_page(regions: DataFrame, page: list[str]) -> DataFrame:
    """page, regions: the regions of each page as a list, in order of their number."""
    return regions.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("k", *SIDES))).alias("regions"))


def sheet_name(page: Column, dpi: int = 200) -> Column:
    return F.format_string(f"sheet_p%04d_dpi{dpi}.png", page)


def ink_detector() -> Callable[[bytes], list[tuple[int, int, int, int]]] | None:
    """Boxes of the ink in an image, by edges, thickening and outlines; None where the image library isn't installed."""
    try:
        import cv2
        import numpy as np
    except ImportError:
        return None

    def boxes(image: bytes) -> list[tuple[int, int, int, int]]:
        grey = cv2.imdecode(np.frombuffer(image, np.uint8), cv2.IMREAD_GRAYSCALE)
        square = cv2.getStructuringElement(cv2.MORPH_RECT, (3, 3))
        ink = cv2.morphologyEx(cv2.dilate(cv2.Canny(grey, 50, 150), square, iterations=2), cv2.MORPH_CLOSE, square)
        found = (cv2.boundingRect(c) for c in cv2.findContours(ink, cv2.RETR_EXTERNAL, cv2.CHAIN_APPROX_SIMPLE)[0])
        return [(x, y, x + w, y + h) for x, y, w, h in found if w * h >= 900]

    return boxes


def ink_boxes(images: DataFrame, detect: Callable[[bytes], list[tuple[int, int, int, int]]], page: str = "page") -> DataFrame:
    """page, k, sides of the ink in images(page, content), by a given detector."""
    def run(batches):
        for batch in batches:
            out = [[dict(zip(SIDES, map(float, b), strict=True)) for b in detect(c)] for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(page), pa.array(out, pa.list_(pa.struct([(s, pa.float64()) for s in SIDES])))], [page, "b"])

    kind = images.schema[page].dataType.simpleString()
    found = images.select(page, "content").mapInArrow(run, f"{page} {kind}, b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return found.select(page, F.posexplode("b").alias("k", "b")).select(page, "k", "b.*")


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^a-zA-Z0-9_\-]+", "_"))


def region_name(page: Column, figure: Column, dpi: int = 200) -> Column:
    return F.format_string(f"p%04d_%s_dpi{dpi}.png", page, slug(figure))


def aggregate_sheets(regions: DataFrame, expected: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, n_regions, missing, extra: distinct figures of regions(doc, page, figure) against expected(doc, figure)."""
    first = regions.groupBy(doc, "figure").agg(F.min("page").alias("page"))
    got = first.groupBy(doc).agg(F.count("*").alias("n_regions"), F.collect_set("figure").alias("got"))
    want = expected.groupBy(doc).agg(F.collect_set("figure").alias("want"))
    none = F.expr("cast(array() as array<string>)")
    both = got.join(want, doc, "full").select(doc, F.coalesce("n_regions", F.lit(0)).alias("n_regions"), F.coalesce("got", none).alias("got"), F.coalesce("want", none).alias("want"))
    return both.select(doc, "n_regions", F.array_sort(F.array_except("want", "got")).alias("missing"), F.array_sort(F.array_except("got", "want")).alias("extra"))


def merge_boxes(boxes: DataFrame, gap: float = 10.0, page: str = "page", ref_compat: bool = False) -> DataFrame:
    """page and the boxes that are left when boxes within `gap` of each other are united until none are.

    With ref_compat boxes are taken in order of `k`, and a box that gathers several others in one pass keeps only the last
    of them; what is left is gathered again until nothing changes.
    """
    def meets(a: tuple, b: tuple) -> bool:
        return a[0] - gap <= b[2] and b[0] - gap <= a[2] and a[1] - gap <= b[3] and b[1] - gap <= a[3]

    def union(a: tuple, b: tuple) -> tuple:
        return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])

    def united(left: list[tuple]) -> list[tuple]:
        changed = True
        while changed:
            changed, out = False, []
            for b in left:
                hit = next((k for k, o in enumerate(out) if meets(b, o)), None)
                if hit is None:
                    out.append(b)
                else:
                    out[hit], changed = union(b, out[hit]), True
            left = sorted(out)
        return left

    def gathered(left: list[tuple]) -> list[tuple]:
        changed = True
        while changed:
            changed, out, waiting = False, [], list(left)
            while waiting:
                box = waiting.pop(0)
                while hits := [b for b in waiting if meets(box, b)]:
                    waiting = [b for b in waiting if not meets(box, b)]
                    box, changed = union(box, hits[-1]), True
                out.append(box)
            left = out
        return left

    def each(batches):
        for batch in batches:
            out = []
            for rows in batch.column(1).to_pylist():
                given = [tuple(x[s] for s in SIDES) for x in rows]
                out.append([dict(zip(SIDES, b, strict=True)) for b in (gathered(given) if ref_compat else united(sorted(given)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], [page, "boxes"])

    order = ["k", *SIDES] if ref_compat else list(SIDES)
    grouped = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("b")).select(page, F.transform("b", lambda b: F.struct(*[b[s].alias(s) for s in SIDES])).alias("boxes"))
    kind = to_arrow_schema(grouped.schema).field("boxes").type
    return grouped.mapInArrow(each, grouped.schema).select(page, F.inline("boxes"))
