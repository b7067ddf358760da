"""Queries over pages: columns, headers, classes of pages, stitching; pages are made from the documents' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import columns, layout
from claimloom.plans import lenses
from claimloom.plans.queries import DUCK_WORDS, joined, query, words

#: Pages of 40 lines in two columns of 20; the first lines of some are headers, fields and claims, by the page's number.
PAGES = f"""
SELECT doc_id, page, col, pos, y, y - 4 AS y0, y + 4 AS y1, x0, CASE WHEN g = 3 AND col = 'L' AND r < 8 THEN 520.0 ELSE CAST(x0 + least(length(text) * 5, 240) AS DOUBLE) END AS x1,
  CASE WHEN r = 0 AND g = 0 THEN 'Sheet 4 of 10' WHEN r = 0 AND g = 1 THEN 'Patent Application Publication' WHEN r = 1 AND g = 1 THEN 'US 2009/0123456 A1' WHEN r = 0 AND g = 2 THEN 'CERTIFICATE OF CORRECTION'
    WHEN r < 8 AND g = 3 THEN concat('(', 50 + r, ')field (', 60 + r, ') of it') WHEN r = 4 AND g = 4 THEN 'CLAIMS' WHEN r IN (2, 4) AND g = 5 THEN concat(r, '. The method of a part') ELSE text END AS text
FROM (SELECT doc_id, CAST(floor(pos / 40) AS INT) AS page, CASE WHEN pos % 2 = 0 THEN 'L' ELSE 'R' END AS col, CAST(floor(pos % 40 / 2) AS INT) AS pos, CAST(pos % 40 AS INT) AS r, CAST((doc_id + floor(pos / 40)) % 6 AS INT) AS g,
  CAST(24 + 14 * floor(pos % 40 / 2) + CASE WHEN pos % 40 > 9 THEN 80 ELSE 0 END AS DOUBLE) AS y, CAST(CASE WHEN pos % 2 = 0 THEN 60 ELSE 320 END AS DOUBLE) AS x0, text FROM ({lenses.LINES}))
"""
KEY, WIDTH, HEIGHT = ["doc_id", "page"], 600.0, 800.0
P = f"WITH p AS ({PAGES})"
META = " OR ".join(f"regexp_matches(trim(text), '{x}')" for x in (*layout.PUBLISHED, layout.DATE, layout.SHEET_OF, columns.APPLICATION)) + f" OR (regexp_matches(text, '{layout.KIND}') AND regexp_matches(text, '[0-9]'))"
STRICT = f"CASE WHEN y <= 96 AND ({META}) THEN 'header' ELSE 'body' END"


def pages(spark, sf):
    return lenses.frame(spark, sf, PAGES)


@query(f"""{P}, b AS (SELECT doc_id, page, string_agg(trim(text), ' ' ORDER BY y, col, pos) FILTER (y <= 160 AND trim(text) <> '') AS t, count(*) FILTER (y <= 260 AND regexp_matches(trim(text), '{columns.CODE_BEFORE_WORD}')) AS n FROM p GROUP BY doc_id, page)
SELECT doc_id, page, CASE WHEN regexp_matches(coalesce(t, ''), '{layout.SHEET_OF}') OR (regexp_matches(t, '{columns.APPLICATION}') AND contains(upper(t), 'US')) OR regexp_matches(t, '{columns.ADMIN}') OR n >= 3 THEN 'generic' ELSE 'strict_metadata' END AS mode FROM b""")
def header_modes(spark, sf):
    return columns.header_mode(pages(spark, sf), KEY, HEIGHT)


@query(f"{P} SELECT doc_id, page, col, pos, {STRICT} AS region FROM p")
def header_strict(spark, sf):
    return pages(spark, sf).select(*KEY, "col", "pos", columns.strict_region(HEIGHT).alias("region"))


@query(f"""{P} SELECT doc_id, page, count(*) FILTER (y0 < 85 AND (regexp_matches(text, '{columns.RUNNING}') OR regexp_matches(text, '{columns.PAGE_NUMBER}'))) AS n_header,
count(*) FILTER (y0 > 740 AND regexp_matches(text, '{columns.PAGE_NUMBER}')) AS n_dropped FROM p GROUP BY doc_id, page""")
def header_running(spark, sf):
    rows = pages(spark, sf).withColumn("region", columns.running_region(HEIGHT))
    return rows.groupBy(*KEY).agg(F.count_if(F.col("region") == "header").alias("n_header"), F.count_if(F.col("region").isNull()).alias("n_dropped"))


@query(f"""{P}, s AS (SELECT *, {STRICT} AS region FROM p), n AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (region = 'body') AS b, count(*) FILTER (region = 'header') AS h FROM s GROUP BY doc_id, page)
SELECT doc_id, page, b = 0 OR (n >= 30 AND b <= 6 AND h >= n - 6) OR (n >= 40 AND b <= 10 AND h >= 30) AS failed FROM n""")
def header_failed(spark, sf):
    return columns.split_failed(pages(spark, sf).withColumn("region", columns.strict_region(HEIGHT)), KEY)


@query(f"""{P}, s AS (SELECT *, length(regexp_extract(trim(text), '^(.*?\\([0-9]{{2}}\\).*?)\\([0-9]{{2}}\\)', 1)) AS k, col = 'L' AND x0 < 293 AND x1 > 307 AND len(regexp_extract_all(text, '\\([0-9]{{2}}\\)')) >= 2 AS over FROM p)
SELECT doc_id, page, col, x0, x1, text FROM s WHERE NOT over UNION ALL SELECT doc_id, page, 'L', x0, least(x1, 293), trim(substr(trim(text), 1, k)) FROM s WHERE over UNION ALL SELECT doc_id, page, 'R', greatest(x0, 307), x1, trim(substr(trim(text), k + 1)) FROM s WHERE over""")
def header_gutter(spark, sf):
    rows = columns.split_gutter(pages(spark, sf).withColumn("region", F.lit("header")), KEY, WIDTH)
    return rows.select(*KEY, "col", "x0", "x1", "text")


@query()
def page_layouts(spark, sf):
    """Lines by region of each page after the split that it calls for (its steps have SQL of their own)."""
    return columns.regions(pages(spark, sf), KEY, WIDTH, HEIGHT).groupBy(*KEY, "region", "col").agg(F.count("*").alias("n"))


@query(f"{P} SELECT doc_id, page, string_agg(text, chr(10) ORDER BY col, pos) AS by_column, string_agg(text, chr(10) ORDER BY y, col, pos) AS by_height FROM p WHERE trim(text) <> '' GROUP BY doc_id, page")
def page_texts(spark, sf):
    rows = pages(spark, sf)
    down, across = columns.reading_text(rows, KEY), columns.reading_text(rows, KEY, across=True)
    return down.withColumnRenamed("text", "by_column").join(across.withColumnRenamed("text", "by_height"), KEY)


HEADINGS = "', '".join(layout.BODY_HEADINGS)
CLASSES = f"""s AS (SELECT *, trim(text) AS t, {STRICT} AS region FROM p WHERE trim(text) <> ''), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, region ORDER BY col, pos) AS n FROM s),
f AS (SELECT doc_id, page, bool_or(region = 'header' AND regexp_matches(t, '(?i)\\bSheet\\s+[0-9]+\\s+of\\s+[0-9]+\\b')) AS sheet, coalesce(string_agg(t, ' ' ORDER BY n) FILTER (region = 'body' AND n <= 60), '') AS head,
  count(*) FILTER (region = 'body' AND regexp_matches(t, '^\\(\\s*[0-9]+\\s*\\)')) AS inids, bool_or(region = 'body' AND n <= 80 AND upper(t) IN ('{HEADINGS}')) AS heading,
  count(*) FILTER (region = 'body' AND n <= 120 AND regexp_matches(t, '{layout.CLAIM_LINE}')) AS numbered, count(*) FILTER (region = 'body') AS lines, coalesce(CAST(floor(median(length(t)) FILTER (region = 'body')) AS INT), 0) AS median FROM o GROUP BY doc_id, page),
kinds AS (SELECT doc_id, page, CASE WHEN sheet THEN 'drawing' WHEN regexp_matches(head, '{layout.ADMIN_PAGE}') THEN 'admin' WHEN inids >= 3 THEN 'inid' WHEN heading OR regexp_matches(head, '{layout.CLAIMED}') OR numbered >= 2 OR (lines >= 18 AND median >= 18) THEN 'body' ELSE 'unknown' END AS kind, inids, lines, median FROM f)"""


def classed(spark, sf):
    return layout.page_signals(pages(spark, sf).withColumn("region", columns.strict_region(HEIGHT)), KEY)


@query(f"{P}, {CLASSES} SELECT * FROM kinds")
def page_classes(spark, sf):
    """Drawing, admin, inid, body and unknown pages."""
    return classed(spark, sf)


@query(f"""{P}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY col, pos) AS n, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM p WHERE trim(text) <> '')
SELECT doc_id, page, bool_or(regexp_matches(t, '{layout.BODY_START}')) OR regexp_matches(string_agg(t, ' ' ORDER BY n), '{layout.CLAIMED}') OR count(*) FILTER (regexp_matches(t, '{layout.CLAIM_LINE}')) >= 2 AS starts FROM t WHERE n <= 120 GROUP BY doc_id, page""")
def page_body_starts(spark, sf):
    return layout.body_starts(pages(spark, sf), KEY)


#: Sequences of page kinds, and whether a page's text starts the body.
KINDS = """WITH p AS (SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page,
CASE o_orderkey % 9 WHEN 0 THEN 'drawing' WHEN 1 THEN 'body' WHEN 2 THEN 'inid' WHEN 3 THEN 'inid' WHEN 4 THEN 'admin' ELSE 'unknown' END AS kind, o_orderkey % 5 = 0 AS starts FROM {orders})"""
CONTINUED = """f AS (SELECT doc_id, min(page) AS first FROM p WHERE kind <> 'admin' GROUP BY doc_id), s AS (SELECT p.doc_id, first, any_value(k.kind) AS opens, min(p.page) FILTER (p.page > first AND (p.kind IN ('drawing', 'admin', 'body') OR p.starts)) AS stop
FROM p JOIN f USING (doc_id) JOIN p k ON k.doc_id = f.doc_id AND k.page = first GROUP BY p.doc_id, first),
c AS (SELECT p.doc_id, page, CASE WHEN opens = 'inid' AND page > first AND page < coalesce(stop, 1000000) THEN 'inid' ELSE kind END AS kind FROM p LEFT JOIN s USING (doc_id))"""


def kinds(spark, sf):
    return lenses.frame(spark, sf, f"{KINDS} SELECT * FROM p")


@query(f"{KINDS}, {CONTINUED} SELECT * FROM c")
def page_front_matter(spark, sf):
    return layout.front_matter_pages(kinds(spark, sf))


@query(f"""{KINDS}, i AS (SELECT doc_id, min(page) FILTER (kind = 'inid') AS i, max(page) AS m FROM p GROUP BY doc_id), u AS (SELECT i.doc_id, CASE WHEN i IS NULL THEN 0 ELSE coalesce((SELECT min(page) FROM p WHERE p.doc_id = i.doc_id AND page > i AND kind IN ('drawing', 'body')), m + 1) END AS cut FROM i)
SELECT doc_id, coalesce(string_agg(page, ',' ORDER BY page) FILTER (kind = 'drawing'), '') AS drawing, coalesce(string_agg(page, ',' ORDER BY page) FILTER (kind = 'body'), '') AS body, coalesce(string_agg(page, ',' ORDER BY page) FILTER (page < cut), '') AS inid FROM p JOIN u USING (doc_id) GROUP BY doc_id""")
def page_kind_sets(spark, sf):
    return layout.page_sets(kinds(spark, sf)).select("doc_id", *[joined(c).alias(c) for c in ("drawing", "body", "inid")])


@query(f"""{P}, g AS (SELECT *, lead(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS nxt, count(*) OVER (PARTITION BY doc_id, page) AS n FROM p), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY nxt - y DESC, y) AS k FROM g WHERE n >= 8 AND nxt - y >= 70 AND y >= 40),
c AS (SELECT doc_id, page, (y + nxt) / 2 AS cutoff FROM w WHERE k = 1) SELECT p.doc_id, p.page, any_value(cutoff) AS cutoff, count(*) FILTER (cutoff IS NULL OR y < cutoff) AS n_kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.page = p.page GROUP BY p.doc_id, p.page""")
def page_noise(spark, sf):
    """The gap below which a page holds stamps and the like, and the lines above it."""
    rows = pages(spark, sf)
    cut = columns.noise_cutoff(rows, KEY, below=40.0)
    return columns.above(rows, cut, KEY).groupBy(*KEY).agg(F.count("*").alias("n_kept")).join(cut, KEY, "left").select(*KEY, "cutoff", "n_kept")


# --- columns --------------------------------------------------------------------------------------------------------

PLACED = f"{DUCK_WORDS}, v AS (SELECT doc_id, pos, k, text, x0, x0 + length(text) * 6 AS x1 FROM x WHERE trim(text) <> '' AND 12 * pos + 4 BETWEEN 5 AND 795)"
NUMBER = "length(trim(text)) <= 6 AND NOT regexp_matches(trim(text), '^\\([0-9]+\\)$') AND NOT regexp_matches(trim(text), '^[0-9]{1,3}[.]$') AND (regexp_matches(trim(text), '^[0-9]+$') OR (length(trim(text)) <= 4 AND regexp_matches(trim(text), '[0-9]')))"


def placed(spark, sf):
    """Words on pages, a document each, with lines 12 apart; every seventh word of some documents is a number."""
    y = F.col("pos") * 12.0
    return words(spark, sf).select("doc_id", (F.col("pos") * 100000 + F.col("k")).alias("word_no"), "x0", y.alias("y0"), "x1", (y + 8).alias("y1"), "text")


LONG = f"""{PLACED}, n AS (SELECT doc_id, pos, count(*) AS n, max(x1) - min(x0) AS width FROM v GROUP BY doc_id, pos), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY width) AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM n),
u AS (SELECT doc_id, max(width) FILTER (k = c // 2 + 1) AS upper FROM o GROUP BY doc_id), g AS (SELECT doc_id, pos, n, width, upper > 0 AND width > 1.5 * upper AS long FROM n JOIN u USING (doc_id))"""


@query(f"{LONG} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (long) AS n_long, sum(width)::DOUBLE AS width FROM g GROUP BY doc_id")
def column_long_lines(spark, sf):
    rows = layout.group_lines(columns.within_margins(placed(spark, sf), 800.0), ["doc_id"])
    return columns.long_lines(rows, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("long").alias("n_long"), F.sum("width").alias("width"))


@query(f"""{LONG}, f AS (SELECT v.* FROM v JOIN g ON g.doc_id = v.doc_id AND g.pos = v.pos WHERE NOT (long AND n > 1 AND abs((x0 + x1) / 2 - 200) < 0.15 * 400 AND ({NUMBER.replace("text", "v.text")}))),
s AS (SELECT *, lead(x0) OVER w - x1 AS gap, row_number() OVER w AS i, x0 - lag(x1) OVER w AS back FROM f WINDOW w AS (PARTITION BY doc_id, pos ORDER BY x0, k)),
b AS (SELECT doc_id, pos, arg_max(i, (gap, -i)) FILTER (gap >= 22) AS cut FROM s GROUP BY doc_id, pos),
c AS (SELECT s.*, cut, sum(CASE WHEN back >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id, s.pos ORDER BY x0, k) AS cluster FROM s JOIN b ON b.doc_id = s.doc_id AND b.pos = s.pos),
q AS (SELECT *, CASE WHEN cut IS NOT NULL THEN (i > cut)::INT ELSE cluster END AS piece FROM c),
line AS (SELECT doc_id, pos, piece, any_value(cut) AS cut, min(x0) AS x0, max(x1) AS x1, regexp_replace(regexp_replace(regexp_replace(string_agg(text, ' ' ORDER BY x0, text), ' ([,.;:)\\]}}%])', '\\1', 'g'), '([(\\[{{]) ', '\\1', 'g'), '- ', '-', 'g') AS text FROM q GROUP BY doc_id, pos, piece),
m AS (SELECT *, max(piece) OVER (PARTITION BY doc_id, pos) AS pieces FROM line)
SELECT doc_id, CASE WHEN CASE WHEN cut IS NOT NULL THEN piece = 1 ELSE (x0 + x1) / 2 > 200 + CASE WHEN pieces = 0 THEN 10 ELSE 0 END END THEN 'R' ELSE 'L' END AS col, (12.0 * pos + 4)::DOUBLE AS y, x0::DOUBLE AS x0, x1::DOUBLE AS x1, text FROM m""")
def column_streams(spark, sf):
    """The lines of both columns, from words."""
    return columns.column_lines(placed(spark, sf), ["doc_id"], 400.0, 800.0).select("doc_id", "col", "y", "x0", "x1", "text")


# --- blocks ---------------------------------------------------------------------------------------------------------

BLOCKS = """WITH b AS (SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(row_number() OVER w AS INT) AS pos, CAST(floor(row_number() OVER w / 3) AS INT) AS page, CASE WHEN l_suppkey % 2 = 0 THEN 'L' ELSE 'R' END AS col,
CAST(40 * (row_number() OVER w % 3) + l_partkey % 3 * 100 AS DOUBLE) AS y0, CASE l_partkey % 4 WHEN 0 THEN 'inid' WHEN 1 THEN 'section_heading' WHEN 2 THEN 'section_heading' ELSE 'paragraph' END AS kind,
CAST(CASE WHEN l_partkey % 4 = 0 AND l_partkey % 5 <> 0 THEN 50 + l_partkey % 9 END AS INT) AS tag, CASE WHEN l_partkey % 7 = 0 THEN concat('A sentence ', l_partkey, '.') ELSE concat('Part ', l_partkey) END AS text
FROM {lineitem} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))"""


def blocks(spark, sf):
    return lenses.frame(spark, sf, f"{BLOCKS} SELECT * FROM b")


@query(f"""{BLOCKS}, s AS (SELECT *, bool_or(kind = 'inid' OR y0 > 220) OVER (PARTITION BY doc_id, page ORDER BY y0, col, pos) AS stops, bool_or(kind = 'inid' AND tag IS NOT NULL AND y0 <= 220) OVER (PARTITION BY doc_id, page) AS fresh FROM b),
t AS (SELECT *, CASE WHEN NOT stops AND NOT fresh THEN coalesce((SELECT max(pos) FROM b f WHERE f.doc_id = s.doc_id AND f.page < s.page AND f.col = s.col AND f.kind = 'inid' AND f.tag IS NOT NULL), (SELECT max(pos) FROM b f WHERE f.doc_id = s.doc_id AND f.page < s.page AND f.kind = 'inid' AND f.tag IS NOT NULL)) END AS goal FROM s),
a AS (SELECT doc_id, goal, string_agg(text, chr(10) ORDER BY page, y0, col, pos) AS added FROM t WHERE goal IS NOT NULL GROUP BY doc_id, goal)
SELECT t.doc_id, pos, CASE WHEN added IS NULL THEN text ELSE text || chr(10) || added END AS text FROM t LEFT JOIN a ON a.doc_id = t.doc_id AND a.goal = t.pos WHERE t.goal IS NULL""")
def block_stitching(spark, sf):
    """Field texts that go on at the top of a later page."""
    return layout.stitched(blocks(spark, sf)).select("doc_id", "pos", "text")


@query(f"""{BLOCKS}, h AS (SELECT *, y0 + 10 AS y1 FROM b), j AS (SELECT *, coalesce(kind = 'section_heading' AND lag(kind) OVER w = 'section_heading' AND lag(page) OVER w = page AND lag(col) OVER w = col AND y0 - lag(y1) OVER w BETWEEN -4 AND 30 AND NOT regexp_matches(text, '[.!?]\\s*$'), false) AS joins FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM j)
SELECT doc_id, min(pos) AS pos, any_value(kind) AS kind, string_agg(text, ' ' ORDER BY pos) AS text, min(y0) AS y0, max(y1) AS y1 FROM r GROUP BY doc_id, r""")
def block_headings(spark, sf):
    """Headings over several lines as one."""
    rows = blocks(spark, sf).withColumn("y1", F.col("y0") + 10)
    return layout.merged_headings(rows, ["doc_id"], gap=30.0).select("doc_id", "pos", "kind", "text", "y0", "y1")


@query(f"{BLOCKS} SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, col, y0, pos) AS INT) AS place FROM b")
def block_order(spark, sf):
    """Reading order: page, column, height."""
    from pyspark.sql import Window

    return blocks(spark, sf).select("doc_id", "pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "col", "y0", "pos")).alias("place"))


RESCUED = """WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM {lineitem}),
l AS (SELECT CAST(l_orderkey AS BIGINT) AS page, 'L' AS col, CAST(n AS INT) AS pos, CAST(60 + 9 * n AS DOUBLE) AS y, CASE WHEN n = 1 + l_orderkey % 6 THEN '(54) TITLE' WHEN l_partkey % 9 = 0 THEN '(21) field' ELSE concat('line ', l_partkey) END AS text,
CASE WHEN n < 1 + l_orderkey % 6 THEN 'header' ELSE 'body' END AS region FROM r)"""


@query(f"""{RESCUED}, a AS (SELECT page, min(y) AS at_ FROM l WHERE region = 'body' AND text LIKE '(54)%' GROUP BY page), n AS (SELECT l.*, coalesce(at_ - y > 0 AND at_ - y <= 20 AND text NOT LIKE '(%', false) AS near FROM l LEFT JOIN a USING (page)),
o AS (SELECT *, bool_and(near) OVER w AS open, count(*) OVER w AS k FROM n WINDOW w AS (PARTITION BY page, col, region ORDER BY y DESC, pos DESC)) SELECT page, region, text, y, CASE WHEN region = 'header' AND open AND k <= 4 THEN 'body' ELSE region END AS now FROM o""")
def header_rescue(spark, sf):
    """Header lines that stand close above the title join the body."""
    rows = lenses.frame(spark, sf, f"{RESCUED} SELECT * FROM l").withColumn("was", F.col("region"))
    return layout.rescue(rows, ["page"]).select("page", F.col("was").alias("region"), "text", "y", F.col("region").alias("now"))


LIKE = " OR ".join(f"regexp_matches(text, '{x}')" for x in (*layout.PUBLISHED[:2], layout.DATE, layout.SHEET_OF, layout.KIND))


@query(f"{P} SELECT doc_id, page, col, pos, {LIKE} AS running FROM p")
def header_running_lines(spark, sf):
    return pages(spark, sf).select(*KEY, "col", "pos", layout.running_header(F.col("text")).alias("running"))
