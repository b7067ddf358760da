"""Queries over drawing sheets: figure labels, regions, sheet counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import drawings
from claimloom.plans import lenses
from claimloom.plans.queries import boxes, joined, query

ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
WORDS = f"""WITH w AS (SELECT CAST(l_orderkey AS BIGINT) AS page, CAST(1 AS INT) AS block_no, CAST(l_suppkey % 2 AS INT) AS line_no, CAST(row_number() OVER (PARTITION BY l_orderkey {ORDER}) AS INT) AS word_no,
CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey % 2 * 40 AS DOUBLE) AS y0, CAST(l_partkey % 500 + 20 AS DOUBLE) AS x1, CAST(l_suppkey % 2 * 40 + 10 AS DOUBLE) AS y1,
CASE l_partkey % 7 WHEN 0 THEN 'Fig.' WHEN 1 THEN 'FIG' WHEN 2 THEN '.' WHEN 3 THEN concat(l_suppkey % 4, 'a') WHEN 4 THEN concat('Fig.', l_suppkey % 3) WHEN 5 THEN CAST(l_suppkey % 5 AS STRING) ELSE 'part' END AS text FROM {{lineitem}})"""
ONE = "regexp_matches({0}, '(?i)^fig\\.?$')"


@query(f"""{WORDS}, n AS (SELECT *, min(word_no) OVER (PARTITION BY page, line_no) AS line, lead(text) OVER o AS t1, lead(text, 2) OVER o AS t2, lead(x0) OVER o AS a1, lead(x0, 2) OVER o AS a2, lead(x1) OVER o AS b1, lead(x1, 2) OVER o AS b2 FROM w WINDOW o AS (PARTITION BY page, line_no ORDER BY x0, word_no)),
f AS (SELECT *, CASE WHEN t1 = '.' THEN t2 ELSE t1 END AS t, CASE WHEN t1 = '.' THEN a2 ELSE a1 END AS a, CASE WHEN t1 = '.' THEN b2 ELSE b1 END AS b FROM n),
l AS (SELECT page, line, x0 AS x, word_no, upper(regexp_extract(text, '(?i)^fig\\.?([0-9]+[a-z]?)$', 1)) AS label, x0, x1, y0, y1 FROM f WHERE regexp_matches(text, '(?i)^fig\\.?[0-9]+[a-z]?$')
UNION ALL SELECT page, line, x0, word_no, upper(t), least(x0, a), greatest(x1, b), y0, y1 FROM f WHERE {ONE.replace("{0}", "text")} AND regexp_matches(t, '^[0-9]+[A-Za-z]?$')),
r AS (SELECT *, row_number() OVER (PARTITION BY page, label ORDER BY line, x, word_no) AS k FROM l) SELECT page, label, x0, y0, x1, y1 FROM r WHERE k = 1""")
def drawing_labels(spark, sf):
    return drawings.figure_labels(lenses.frame(spark, sf, f"{WORDS} SELECT * FROM w"))


TOKENS = f"""WITH k AS (SELECT CAST(l_orderkey AS BIGINT) AS page, CAST(row_number() OVER (PARTITION BY l_orderkey {ORDER}) AS INT) AS n, CAST(l_quantity + l_linenumber AS DOUBLE) AS conf, CAST(l_partkey % 300 AS DOUBLE) AS x, CAST(l_suppkey % 3 * 9 AS DOUBLE) AS y,
CAST(20 AS DOUBLE) AS w, CAST(8 + l_suppkey % 9 AS DOUBLE) AS h, CASE l_partkey % 5 WHEN 0 THEN 'Fig.' WHEN 1 THEN 'FIG' WHEN 2 THEN concat(l_suppkey % 3, 'b') WHEN 3 THEN concat('fig.', l_suppkey % 2) ELSE CAST(l_suppkey % 3 AS STRING) END AS t FROM {{lineitem}})"""


@query(f"""{TOKENS}, c AS (SELECT page, regexp_extract(t, '[0-9].*$') AS label, conf, 1 AS whole, 0 AS f, 0 AS d, x AS x0, y AS y0, x + w AS x1, y + h AS y1, row_number() OVER (PARTITION BY page, t ORDER BY n DESC) AS r FROM k WHERE t LIKE 'fig._'),
p AS (SELECT f.page, upper(d.t) AS label, least(f.conf, d.conf) AS conf, 0 AS whole, f.n AS f, d.n AS d, least(f.x, d.x) AS x0, least(f.y, d.y) AS y0, greatest(f.x + f.w, d.x + d.w) AS x1, greatest(f.y + f.h, d.y + d.h) AS y1
FROM k f JOIN k d ON f.page = d.page AND {ONE.replace("{0}", "f.t")} AND regexp_matches(d.t, '^[0-9]+[a-z]?$') AND abs(d.y + d.h / 2 - f.y - f.h / 2) <= greatest(12, f.h) AND d.x - f.x - f.w BETWEEN 0 AND 220),
a AS (SELECT page, label, conf, whole, f, d, x0, y0, x1, y1 FROM c WHERE r = 1 UNION ALL SELECT * FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY page, label ORDER BY conf DESC, whole DESC, f, d) AS i FROM a)
SELECT page, label, conf, x0, y0, x1, y1 FROM o WHERE i = 1""")
def drawing_token_labels(spark, sf):
    return drawings.token_labels(lenses.frame(spark, sf, f"{TOKENS} SELECT * FROM k"))


def padded(a: str, by: int = 12) -> str:
    return f"greatest(0, {a}x0 - {by}) AS x0, greatest(0, {a}y0 - {by}) AS y0, least(500, {a}x1 + {by}) AS x1, least(800, {a}y1 + {by}) AS y1"


AREA = "greatest(0, x1 - x0) * greatest(0, y1 - y0)"
COVERS = "(c.x1 > c.x0 AND c.y1 > c.y0 AND greatest(0, least(c.x1, l.x1) - greatest(c.x0, l.x0)) * greatest(0, least(c.y1, l.y1) - greatest(c.y0, l.y0)) / ((c.x1 - c.x0) * (c.y1 - c.y0)) >= 0.10)"
FAR = "power((c.x0 + c.x1) / 2 - (l.x0 + l.x1) / 2, 2) + power((c.y0 + c.y1) / 2 - (l.y0 + l.y1) / 2, 2)"


@query(f"""WITH x AS ({lenses.BOXES}), c AS (SELECT * FROM x WHERE k > 2 AND page % 3 <> 0), g AS (SELECT * FROM x WHERE k <= 2), l AS (SELECT page, k, {padded("")} FROM g),
cut AS (SELECT page, coalesce(max(CASE WHEN x1 - x0 >= 225 AND y1 - y0 <= 144 AND y1 <= 200 THEN y1 + 8 END), 80) AS cut FROM c GROUP BY page),
s AS (SELECT c.page, c.k, l.k AS label, row_number() OVER (PARTITION BY c.page, c.k ORDER BY ({FAR}) * CASE WHEN (c.y0 + c.y1) / 2 > (l.y0 + l.y1) / 2 THEN 3 ELSE 1 END * CASE WHEN {COVERS} THEN 5 ELSE 1 END, l.k) AS r FROM c JOIN l USING (page) JOIN cut USING (page) WHERE (c.y0 + c.y1) / 2 >= cut),
u AS (SELECT c.page, s.label, min(c.x0) AS x0, min(c.y0) AS y0, max(c.x1) AS x1, max(c.y1) AS y1 FROM s JOIN c ON c.page = s.page AND c.k = s.k AND s.r = 1 JOIN l ON l.page = s.page AND l.k = s.label AND NOT {COVERS} GROUP BY c.page, s.label),
v AS (SELECT u.page, label, {padded("u.")} FROM u), f AS (SELECT v.page, label, x0, greatest(y0, cut) AS y0, x1, y1 FROM v JOIN cut USING (page)), fa AS (SELECT *, {AREA} AS area FROM f),
q AS (SELECT c.page, l.k AS label, min(c.x0) AS x0, min(c.y0) AS y0, max(c.x1) AS x1, max(c.y1) AS y1 FROM c JOIN l USING (page) JOIN fa ON fa.page = l.page AND fa.label = l.k AND area / 400000 < 0.02 WHERE NOT {COVERS} AND (c.y0 + c.y1) / 2 <= (l.y0 + l.y1) / 2 AND {FAR} <= 480 * 480 GROUP BY c.page, l.k),
qr AS (SELECT q.page, label, {padded("q.")} FROM q), r AS (SELECT qr.page, qr.label, qr.x0, qr.y0, qr.x1, qr.y1 FROM qr JOIN fa ON fa.page = qr.page AND fa.label = qr.label WHERE greatest(0, qr.x1 - qr.x0) * greatest(0, qr.y1 - qr.y0) >= area),
m AS (SELECT page, k, (greatest(0, least(1, x0 / 500)) + greatest(0, least(1, x1 / 500))) / 2 AS x, (greatest(0, least(1, y0 / 800)) + greatest(0, least(1, y1 / 800))) / 2 AS y FROM g),
e AS (SELECT m.page, m.k, m.x, m.y, coalesce((m.x + max(o.x) FILTER (o.x < m.x)) / 2, 0) AS x0, coalesce((m.y + max(o.y) FILTER (o.y < m.y)) / 2, 0) AS y0, coalesce((m.x + min(o.x) FILTER (o.x > m.x)) / 2, 1) AS x1, coalesce((m.y + min(o.y) FILTER (o.y > m.y)) / 2, 1) AS y1 FROM m JOIN m o ON o.page = m.page GROUP BY m.page, m.k, m.x, m.y),
z AS (SELECT page, k, trunc(CASE WHEN x1 <= x0 THEN greatest(0, x - 0.25) ELSE x0 END * 500) AS x0, trunc(CASE WHEN y1 <= y0 THEN greatest(0, y - 0.25) ELSE y0 END * 800) AS y0, trunc(CASE WHEN x1 <= x0 THEN least(1, x + 0.25) ELSE x1 END * 500) AS x1, trunc(CASE WHEN y1 <= y0 THEN least(1, y + 0.25) ELSE y1 END * 800) AS y1 FROM e),
zp AS (SELECT z.page, z.k, {padded("z.")} FROM z)
SELECT g.page, g.k, round(coalesce(r.x0, fa.x0, zp.x0), 6)::DOUBLE AS x0, round(coalesce(r.y0, fa.y0, zp.y0), 6)::DOUBLE AS y0, round(coalesce(r.x1, fa.x1, zp.x1), 6)::DOUBLE AS x1, round(coalesce(r.y1, fa.y1, zp.y1), 6)::DOUBLE AS y1,
r.x0 IS NOT NULL AS used_radius, fa.x0 IS NULL AS used_partition, CASE WHEN fa.x0 IS NULL THEN 0.4 ELSE 0.6 END::DOUBLE AS confidence
FROM g JOIN zp ON zp.page = g.page AND zp.k = g.k LEFT JOIN fa ON fa.page = g.page AND fa.label = g.k LEFT JOIN r ON r.page = g.page AND r.label = g.k""")
def drawing_crops(spark, sf):
    """The region of each figure label, with its fallbacks."""
    labels, parts, _ = boxes(spark, sf)
    out = drawings.crops(labels, parts.where("page % 3 <> 0"), 500, 800)
    return out.select("page", "k", *[F.round(s, 6).alias(s) for s in drawings.SIDES], "used_radius", "used_partition", "confidence")


PARSES = """WITH p AS (SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey % 7 AS INT) AS page, CAST(o_orderkey AS BIGINT) AS seq, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 200 ELSE 300 END AS INT) AS dpi, CAST(o_orderkey % 3 AS INT) AS n_regions FROM {orders}),
w AS (SELECT DISTINCT doc_id, CAST(seq % 5 AS INT) AS page FROM p)"""
FIRST = "o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS n FROM p), one AS (SELECT * FROM o WHERE n = 1)"
BAD = """i AS (SELECT doc_id, 'drawing_sheets.duplicate_page' AS code, page::VARCHAR AS detail FROM o WHERE n > 1 UNION ALL SELECT doc_id, 'drawing_sheets.pages_missing', page::VARCHAR FROM w ANTI JOIN one USING (doc_id, page)
UNION ALL SELECT doc_id, 'drawing_sheets.pages_unexpected', page::VARCHAR FROM one ANTI JOIN w USING (doc_id, page))"""


def parses(spark, sf):
    return drawings.sheets(lenses.frame(spark, sf, f"{PARSES} SELECT * FROM p"), lenses.frame(spark, sf, f"{PARSES} SELECT * FROM w"))


@query(f"{PARSES}, {FIRST} SELECT doc_id, string_agg(page, ',' ORDER BY page) AS pages, count(*) AS n_sheets, sum(n_regions)::BIGINT AS n_regions, string_agg(DISTINCT dpi, ',' ORDER BY dpi) AS dpis FROM one GROUP BY doc_id")
def sheet_facts(spark, sf):
    return parses(spark, sf)[0].select("doc_id", joined("pages").alias("pages"), "n_sheets", "n_regions", joined("dpis").alias("dpis"))


@query(f"{PARSES}, {FIRST}, {BAD} SELECT doc_id, code, detail FROM i")
def sheet_issues(spark, sf):
    return parses(spark, sf)[1].select("doc_id", "code", "detail")


@query(f"""{PARSES}, {FIRST}, {BAD}, f AS (SELECT doc_id, count(*) AS n, sum(n_regions) AS r FROM one GROUP BY doc_id)
SELECT doc_id, CASE WHEN r = 0 THEN 'failed' WHEN n <> 4 THEN 'partial' WHEN doc_id IN (SELECT doc_id FROM i) THEN 'partial' ELSE 'ok' END AS status, CASE WHEN r = 0 THEN 'drawing_sheets.none_found' WHEN n <> 4 THEN 'drawing_sheets.sheet_count_mismatch' END AS code FROM f""")
def sheet_states(spark, sf):
    facts, issues = parses(spark, sf)
    return drawings.sheet_status(facts, issues, facts.select("doc_id", F.lit(4).alias("n_wanted")))


@query("WITH o AS (SELECT o_custkey AS doc_id, o_orderkey % 3 <> 0 AS has FROM orders) SELECT CAST(doc_id AS BIGINT) AS doc_id, round(avg(has::INT), 6) AS rate FROM o GROUP BY doc_id")
def sheet_marker_rates(spark, sf):
    """How many of a document's pages carry the mark of a drawing sheet."""
    text = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("a page, sheet "), "o_orderkey", F.lit(" of 9"))).otherwise("Sheet of paper")
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").cast("long").alias("doc_id"), text.alias("text"))
    return drawings.marker_rate(rows).withColumn("rate", F.round("rate", 6))


@query(f"WITH x AS ({lenses.BOXES}) SELECT page, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ks FROM x GROUP BY page")
def drawing_by_page(spark, sf):
    out = drawings.by_page(boxes(spark, sf)[2], ["page"])
    return out.select("page", F.size("regions").cast("long").alias("n"), joined(F.transform("regions", lambda r: r["k"].cast("string"))).alias("ks"))


@query("SELECT DISTINCT CAST(l_orderkey % 500 AS INT) AS page, 'sheet_p' || lpad((l_orderkey % 500)::VARCHAR, 4, '0') || '_dpi200.png' AS sheet, 'p' || lpad((l_orderkey % 500)::VARCHAR, 4, '0') || '_fig_' || l_orderkey % 500 || 'a_dpi200.png' AS region FROM lineitem")
def drawing_names(spark, sf):
    page = F.col("page")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey") % 500).cast("int").alias("page")).distinct()
    return rows.select("page", drawings.sheet_name(page).alias("sheet"), drawings.region_name(page, F.concat(F.lit("FIG "), page, F.lit("A"))).alias("region"))


@query()
def drawing_merged_in_order(spark, sf):
    """Boxes united in their order, as the order decides (tested against a plain version)."""
    return drawings.merge_boxes(boxes(spark, sf)[2], ref_compat=True)


@query(f"""WITH x AS ({lenses.BOXES}), c AS (SELECT * FROM x WHERE k > 2), i AS (SELECT * FROM x WHERE k <= 2 AND (x1 - x0) * (y1 - y0) < 0.45 * 9000)
SELECT page, k FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.page = c.page AND least(c.y1, i.y1) - greatest(c.y0, i.y0) >= 0.6 * (c.y1 - c.y0) AND least(c.x1, i.x1) - greatest(c.x0, i.x0) >= 0.25 * (c.x1 - c.x0))""")
def drawing_lines_off_images(spark, sf):
    """Lines that no image covers, without images that are as large as a background."""
    labels, parts, _ = boxes(spark, sf)
    images = drawings.image_boxes(labels.withColumn("type", F.lit(1)))
    return drawings.without_overlapped(parts, images, sheet=9000.0).select("page", "k")


@query(f"""WITH x AS ({lenses.BOXES}), n AS (SELECT page, k, greatest(0, least(1, x0 / 400)) AS x0, greatest(0, least(1, y0 / 600)) AS y0, greatest(0, least(1, x1 / 400)) AS x1, greatest(0, least(1, y1 / 600)) AS y1 FROM x),
p AS (SELECT page, k, trunc(x0 * 200)::INT AS x0, trunc(y0 * 300)::INT AS y0, trunc(x1 * 200)::INT AS x1, trunc(y1 * 300)::INT AS y1 FROM n) SELECT page, k, x0, y0, greatest(x1, x0 + 1) AS x1, greatest(y1, y0 + 1) AS y1 FROM p""")
def drawing_pixels(spark, sf):
    """Boxes as shares of a sheet, and those as pixels of another size."""
    return drawings.pixels(drawings.normalised(boxes(spark, sf)[2], 400.0, 600.0), 200, 300).select("page", "k", *drawings.SIDES)


@query()
def drawing_regions(spark, sf):
    """Regions of sheets by labels from words, else from tokens (its steps have SQL of their own)."""
    words, tokens = lenses.frame(spark, sf, f"{WORDS} SELECT * FROM w"), lenses.frame(spark, sf, f"{TOKENS} SELECT * FROM k")
    return drawings.sheet_regions(words, tokens, boxes(spark, sf)[1], 500, 800).select("page", "k", "figure", "source", "used_radius", "used_partition")
