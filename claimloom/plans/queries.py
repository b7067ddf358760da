"""Queries over the driver's tables, each with independent DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import text, tokens
from claimloom.operators import citations, claims, compare, diagnostics, drawings, front, layout, sections
from claimloom.plans import lenses
from claimloom.sources import bundle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = lenses.duck(sql)
        return f

    return add


def joined(c, by=","):
    return F.array_join(c, by)


def claim_rows(spark, sf):
    return claims.dependencies(lenses.frame(spark, sf, lenses.CLAIMS).select("doc_id", "pos", "number", "text"))


def bodies(spark, sf):
    rows = lenses.frame(spark, sf, lenses.CLAIMS).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "number", "text"))).alias("c"))
    lines = F.transform("c", lambda c: F.concat(c["number"], F.lit(". "), c["text"]))
    return rows.select("doc_id", F.concat(F.lit("What is claimed is:\n"), joined(lines, "\n")).alias("text"))


C = f"WITH c AS ({lenses.CLAIMS}), e AS (SELECT DISTINCT doc_id, number, parent FROM c WHERE parent IS NOT NULL)"


@query(f"{C} SELECT doc_id, count(*) AS n_claims, count(*) FILTER (parent IS NULL) AS n_independent, count(parent) AS n_dependent, CAST(max(CASE WHEN parent IS NULL THEN 0 ELSE 1 END) AS INT) AS max_depends_on, max(number) AS max_number, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM c GROUP BY doc_id")
def claim_statistics(spark, sf):
    """Claims from the text of each document, dependencies, counts."""
    block = bodies(spark, sf).withColumn("text", claims.claims_block(F.col("text")))
    return claims.statistics(claims.split_claims(block))


@query(f"{C} SELECT doc_id, pos, number, text FROM c")
def claim_split(spark, sf):
    return claims.split_claims(bodies(spark, sf)).select("doc_id", "pos", "number", "text")


@query(f"{C} SELECT doc_id, pos, coalesce(CAST(parent AS STRING), '') AS depends_on, parent IS NULL AS is_independent FROM c")
def claim_dependencies(spark, sf):
    return claim_rows(spark, sf).select("doc_id", "pos", joined("depends_on").alias("depends_on"), "is_independent")


@query(f"""{C}, m AS (SELECT doc_id, max(number) AS most FROM c GROUP BY doc_id),
d AS (SELECT doc_id, number FROM c GROUP BY doc_id, number HAVING count(*) > 1),
g AS (SELECT doc_id, unnest(range(1, most + 1)) AS n FROM m), l AS (SELECT g.doc_id, n FROM g ANTI JOIN c ON c.doc_id = g.doc_id AND c.number = g.n),
b AS (SELECT DISTINCT e.doc_id, parent FROM e JOIN m USING (doc_id) ANTI JOIN c ON c.doc_id = e.doc_id AND c.number = e.parent WHERE parent <= most + 5)
SELECT doc_id, 'body.claims.duplicate_numbers' AS code, string_agg(number, ',' ORDER BY number) AS detail FROM d GROUP BY doc_id
UNION ALL SELECT doc_id, 'body.claims.missing_numbers', string_agg(n, ',' ORDER BY n) FROM l GROUP BY doc_id
UNION ALL SELECT doc_id, 'body.claims.depends_on_missing', string_agg(parent, ',' ORDER BY parent) FROM b GROUP BY doc_id""")
def claim_validation(spark, sf):
    return claims.validate(claim_rows(spark, sf))


@query(f"{C} SELECT doc_id, number, max_by(text, pos) AS text FROM c GROUP BY doc_id, number")
def claim_lookup(spark, sf):
    return claims.lookup(claim_rows(spark, sf))


@query(f"{C} SELECT doc_id, parent AS number, string_agg(number, ',' ORDER BY number) AS children FROM e GROUP BY doc_id, parent")
def claim_dependents(spark, sf):
    return claims.dependents(claim_rows(spark, sf)).select("doc_id", "number", joined("children").alias("children"))


@query(f"""{C}, p AS (SELECT doc_id, number, coalesce(string_agg(DISTINCT parent, ',' ORDER BY parent), '') AS parents, coalesce(string_agg(DISTINCT fig, ',' ORDER BY fig), '') AS figures FROM c GROUP BY doc_id, number),
k AS (SELECT doc_id, parent AS number, string_agg(number, ',' ORDER BY number) AS children FROM e GROUP BY doc_id, parent)
SELECT doc_id, number, parents, coalesce(children, '') AS children, figures FROM p LEFT JOIN k USING (doc_id, number)""")
def claim_context(spark, sf):
    return claims.context(claim_rows(spark, sf)).select("doc_id", "number", *[joined(c).alias(c) for c in ("parents", "children", "figures")])


@query(f"""WITH RECURSIVE c AS ({lenses.CLAIMS}), e AS (SELECT DISTINCT doc_id, number, parent FROM c WHERE parent IS NOT NULL),
t AS (SELECT DISTINCT doc_id, number AS root, number, 0 AS depth, CAST(number AS STRING) AS path FROM c WHERE parent IS NULL
UNION ALL SELECT t.doc_id, t.root, e.number, t.depth + 1, t.path || '>' || e.number FROM t JOIN e ON e.doc_id = t.doc_id AND e.parent = t.number)
SELECT doc_id, root, number, depth, path FROM t""")
def claim_tree(spark, sf):
    return claims.tree(claim_rows(spark, sf)).select("doc_id", "root", "number", "depth", joined("path", ">").alias("path"))


@query(f"{C} SELECT doc_id, CAST(fig AS STRING) AS figure, string_agg(DISTINCT number, ',' ORDER BY number) AS claims FROM c WHERE fig IS NOT NULL GROUP BY doc_id, fig")
def figure_context(spark, sf):
    return claims.figure_mentions(claim_rows(spark, sf)).select("doc_id", "figure", joined("claims").alias("claims"))


@query(f"""{C}, n AS (SELECT *, lead(number) OVER w AS next, lead(text) OVER w AS after FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, fig AS figure_number, CAST(NULL AS STRING) AS figure_suffix, 'FIG. ' || fig AS raw_reference, '.' || CASE WHEN next IS NULL THEN '' ELSE ' ' || next || '. ' || trim(substr(after, 1, strpos(after, 'FIG.') - 1)) END AS description FROM n WHERE fig IS NOT NULL""")
def figure_descriptions(spark, sf):
    return sections.figures(bodies(spark, sf)).select("doc_id", "figure_number", "figure_suffix", "raw_reference", "description")


@query(f"""{C}, g AS (SELECT doc_id, text, 'seen by supplier' AS needle, strpos(lower(text), 'is shown in fig. 4') AS at FROM c)
SELECT doc_id, 'text' AS section, CAST(at AS INT) AS at, substr(text, CAST(greatest(1, at - 10) AS INT), CAST(at - greatest(1, at - 10) + 18 + 10 AS INT)) AS excerpt FROM g WHERE at > 0""".replace(" AS at", " AS a_").replace("CAST(at AS", "CAST(a_ AS").replace("at -", "a_ -").replace("WHERE at", "WHERE a_"))
def text_search(spark, sf):
    rows = claim_rows(spark, sf).select("doc_id", "text")
    return sections.search(rows, F.lit("is shown in FIG. 4"), ["text"], reach=10).withColumnRenamed("at", "a_")


E = f"WITH e AS ({lenses.CITES})"


def cites(spark, sf):
    return lenses.frame(spark, sf, lenses.CITES)


@query(f"""{E}, k AS (SELECT DISTINCT src AS id FROM e), b AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY dst)
SELECT k.id, (SELECT count(*) FROM e WHERE src = k.id) AS n_cited, (SELECT count(*) FROM e WHERE src = k.id AND dst IN (SELECT id FROM k)) AS n_cited_here, coalesce(b.n, 0) AS n_citing FROM k LEFT JOIN b ON b.id = k.id""")
def citation_graph(spark, sf):
    return citations.graph(cites(spark, sf))


CHAIN = "".join(
    f"""l{n} AS (SELECT start, dst AS id, min(path || '>' || dst) AS path FROM l{n - 1} JOIN e ON e.src = l{n - 1}.id JOIN k ON k.id = e.dst ANTI JOIN s{n - 1} s ON s.start = l{n - 1}.start AND s.id = e.dst GROUP BY l{n - 1}.start, dst),
s{n} AS (SELECT start, id FROM s{n - 1} UNION ALL SELECT start, id FROM l{n}),\n""".replace("(SELECT start, dst", f"(SELECT l{n - 1}.start AS start, dst")
    for n in range(2, 6)
)


@query(f"""{E}, k AS (SELECT DISTINCT src AS id FROM e), l1 AS (SELECT id AS start, id, id AS path FROM k), s1 AS (SELECT start, id FROM l1),
{CHAIN.rstrip().rstrip(",")} {" UNION ALL ".join(f"SELECT start, id, {n} AS n_nodes, path FROM l{n}" for n in range(1, 6))}""")
def citation_chains(spark, sf):
    """Shortest chains of up to five ids from every id that cites."""
    # The operator takes citations as a set, so they needn't be made distinct before.
    e = lenses.frame(spark, sf, lenses.CITES.replace("DISTINCT ", ""))
    return citations.chains(e).select("start", "id", "n_nodes", joined("path", ">").alias("path"))


@query(f"{E} SELECT src, dst, regexp_extract(dst, '[0-9]+') AS number, length(regexp_extract(dst, '[0-9]+')) = 11 AS is_publication FROM e")
def citation_ids(spark, sf):
    return cites(spark, sf).select("src", "dst", citations.normalised(F.col("dst")).alias("number"), citations.is_publication(F.col("dst")).alias("is_publication"))


I = f"WITH i AS ({lenses.ISSUES})"  # noqa: E741


def issues(spark, sf):
    return lenses.frame(spark, sf, lenses.ISSUES)


@query(f"{I} SELECT doc_id, min(seq) AS seq, severity, code, message, inid FROM i GROUP BY doc_id, severity, code, message, inid")
def issue_dedup(spark, sf):
    return diagnostics.deduplicate(issues(spark, sf)).select("doc_id", "seq", "severity", "code", "message", "inid")


@query(f"{I} SELECT doc_id, CASE WHEN count(*) FILTER (severity <> 'info') > 0 THEN 'partial' ELSE 'ok' END AS status FROM i GROUP BY doc_id")
def issue_status(spark, sf):
    return diagnostics.status(issues(spark, sf))


@query(f"""{I}, f AS (SELECT doc_id, code, min(seq) AS s FROM i GROUP BY doc_id, code), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS n FROM f)
SELECT doc_id, (SELECT count(*) FROM i WHERE i.doc_id = r.doc_id AND severity = 'error') AS n_error, (SELECT count(*) FROM i WHERE i.doc_id = r.doc_id AND severity = 'warning') AS n_warning,
(SELECT count(*) FROM i WHERE i.doc_id = r.doc_id AND severity = 'info') AS n_info, string_agg(code, ',' ORDER BY s) AS codes FROM r WHERE n <= 5 GROUP BY doc_id""")
def issue_summary(spark, sf):
    return diagnostics.summary(issues(spark, sf))


@query(f"{I} SELECT doc_id, string_agg(upper(severity) || ' ' || code || ': ' || message, chr(10) ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, seq) AS text FROM i GROUP BY doc_id")
def issue_text(spark, sf):
    return diagnostics.rendered(issues(spark, sf))


@query(f"{I} SELECT code, count(*) AS count FROM i WHERE severity = 'warning' GROUP BY code ORDER BY 2 DESC, 1 LIMIT 10")
def issue_histogram(spark, sf):
    return diagnostics.histogram(issues(spark, sf))


# --- comparison -----------------------------------------------------------------------------------------------------

PAIRS = f"""WITH c AS ({lenses.CLAIMS}), a AS (SELECT doc_id AS pair, pos AS id, text FROM c WHERE doc_id % 2 = 0), b AS (SELECT doc_id - 1 AS pair, pos AS id, text FROM c WHERE doc_id % 2 = 1),
u AS (SELECT pair, 'a' AS side, id, text FROM a UNION ALL SELECT pair, 'b', id, text FROM b), n AS (SELECT pair, count(*) AS n FROM u GROUP BY pair),
w AS (SELECT pair, side, id, regexp_extract_all(lower(text), '\\w\\w+') AS w FROM u),
t AS (SELECT pair, side, id, g, count(*) AS tf FROM (SELECT pair, side, id, unnest(w) AS g FROM w UNION ALL SELECT pair, side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w) GROUP BY ALL),
d AS (SELECT pair, g, count(*) AS df FROM t GROUP BY ALL),
x AS (SELECT t.pair, side, id, g, tf * (ln((1.0 + n) / (1 + df)) + 1) AS v FROM t JOIN d USING (pair, g) JOIN n USING (pair)),
y AS (SELECT pair, side, id, g, v / sqrt(sum(v * v) OVER (PARTITION BY pair, side, id)) AS v FROM x),
s AS (SELECT p.pair, p.id AS a, q.id AS b, sum(p.v * q.v) AS similarity FROM y p JOIN y q ON p.pair = q.pair AND p.g = q.g AND p.side = 'a' AND q.side = 'b' GROUP BY ALL)"""


def versions(spark, sf):
    rows = lenses.frame(spark, sf, lenses.CLAIMS)
    left = rows.where("doc_id % 2 = 0").select(F.col("doc_id").alias("pair"), F.col("pos").alias("id"), "text")
    right = rows.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("pair"), F.col("pos").alias("id"), "text")
    return left, right


@query(f"{PAIRS} SELECT pair, a, b, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.3")
def claim_similarity(spark, sf):
    left, right = versions(spark, sf)
    return compare.similarities(left, right, threshold=0.3).withColumn("similarity", F.round("similarity", 6))


@query()
def claim_diff(spark, sf):
    """Status of each claim of two versions after a greedy alignment (sequential, so without SQL)."""
    left, right = versions(spark, sf)
    aligned = compare.align(compare.similarities(left, right, threshold=0.3))
    return compare.diff(left, right, aligned, same=0.96).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH c AS ({lenses.CLAIMS}), t AS (SELECT doc_id, string_agg(text, ' ' ORDER BY pos) AS text FROM c GROUP BY doc_id),
h AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS p FROM t), g AS (SELECT doc_id, p, text FROM h WHERE substr(lower(text), CAST(p AS INT), 18) = 'comprising supplyi'),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM g)
SELECT doc_id, 'comprising supplyi' AS anchor, p AS place, substr(text, CAST(greatest(1, p - 20) AS INT), CAST(p - greatest(1, p - 20) + 18 + 20 AS INT)) AS excerpt FROM r WHERE n <= 2""")
def claim_excerpts(spark, sf):
    rows = lenses.frame(spark, sf, lenses.CLAIMS).groupBy("doc_id").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda c: c["text"]), " ").alias("text"))
    wanted = rows.select("doc_id", F.lit("comprising supplyi").alias("anchor"))
    return compare.excerpts(rows, wanted, reach=20, most=2).withColumnRenamed("at", "place")


@query()
def claim_word_diff(spark, sf):
    """Word differences of claims with the same number in two versions (difflib, so without SQL)."""
    left, right = versions(spark, sf)
    both = left.withColumnRenamed("text", "x").join(right.withColumnRenamed("text", "y"), ["pair", "id"])
    return both.select("pair", "id", joined(compare.word_diff(F.col("x"), F.col("y")), "; ").alias("changes"))


# --- front matter ---------------------------------------------------------------------------------------------------


def fields(spark, sf):
    rows = lenses.frame(spark, sf, lenses.FRONT)
    number = F.format_number("grant_no", 0)
    parts = {
        "54": F.concat(F.lit("(54)\nWIDGET FOR "), F.upper("c_name")),
        "73": F.concat(F.lit("(73) Assignee: "), "c_name", F.lit(", "), "n_name", F.lit(" (*) Notice: Subject to any disclaimer")),
        "21": F.concat(F.lit("(21)\nAppl. No.: "), "series", F.lit("/"), F.format_number("serial", 0)),
        "45": F.concat(F.lit("(45) Date of Patent: Jan. "), (1 + F.col("serial") % 28).cast("string"), F.lit(", 2009")),
        "57": F.concat(F.lit("(57) ABSTRACT\nA device for "), "c_name", F.lit(". "), "n_claims", F.lit(" Claims, "), "n_sheets", F.lit(" Drawing Sheets")),
        "56": F.concat(F.lit("(56) References Cited US "), number, F.lit(" B2")),
        "10": F.concat(F.lit("(10) Patent No.: US "), number, F.lit(" B2")),
        "75": F.concat(F.lit("(75) Inventors: Ann "), "cust", F.lit("; Bo "), "serial"),
        "51": F.concat(F.lit("(51) G01N 21/"), "series"),
        "52": F.concat(F.lit("(52) U.S. Cl. 700/"), "series"),
        "99": F.when(F.col("serial") % 7 == 0, "(99) odd"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("code"), v.alias("raw")) for k, v in parts.items()])
    return rows.select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.*").where("raw is not null")


@query(f"""WITH r AS ({lenses.FRONT}) SELECT doc_id, 'WIDGET FOR ' || upper(c_name) AS title, 'A device for ' || c_name || '.' AS abstract, n_claims AS claims_count, n_sheets AS drawing_sheets_count,
c_name || ', ' || n_name AS assignee, 'Ann ' || cust || '|Bo ' || serial AS inventors, make_date(2009, 1, 1 + serial % 28) AS grant_date, 'US' || grant_no || 'B2' AS publication_id,
series || '/' || serial AS application_id, 'G01N21/' || series AS ipc, '700/' || series AS us_classes, 'US' || grant_no || 'B2' AS cited FROM r""")
def front_matter(spark, sf):
    return front.semantic(fields(spark, sf)).select(
        "doc_id", "title", "abstract", "claims_count", "drawing_sheets_count", "assignee", joined("inventors", "|").alias("inventors"), "grant_date",
        "publication_id", "application_id", joined("ipc").alias("ipc"), joined("us_classes").alias("us_classes"), joined("cited").alias("cited"))


@query(f"WITH r AS ({lenses.FRONT}) SELECT doc_id, 'warning' AS severity, 'front_matter.unexpected_inid' AS code, '99' AS inid FROM r WHERE serial % 7 = 0 UNION ALL SELECT doc_id, 'error', 'front_matter.missing_required_inid', '63' FROM r")
def front_matter_issues(spark, sf):
    return front.registry_issues(fields(spark, sf), required=("54", "63"))


# --- normalisation --------------------------------------------------------------------------------------------------

def normal(sql: str, name: str, c: Callable):
    """A query that applies a Column function to every conversation turn."""

    def run(spark, sf):
        rows = spark.read.parquet(f"{sf}/conversations.parquet")
        return rows.select("conv_id", "turn", c(F.col("text")).alias("out"))

    run.__name__ = name
    query(f"SELECT conv_id, turn, {sql} AS out FROM conversations")(run)


def rx(expr: str, *rules: tuple[str, str]) -> str:
    for pattern, by in rules:
        expr = f"regexp_replace({expr}, '{pattern}', '{by}', 'g')"
    return expr


SQUEEZED = rx("text", (r"[\s\x{85}\p{Z}]+", " "), ("^ | $", ""))
normal(SQUEEZED, "norm_squeeze", text.squeeze)
normal(rx("text", (r"([\pL\pN_])-\n([\pL\pN_])", r"\1\2")), "norm_dehyphenate", text.dehyphenate)
normal(rx("text", (r"\r", r"\n"), (r"[ \t]+", " "), (r"\n{3,}", r"\n\n"), (r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")).replace(r"'\n'", "chr(10)").replace(r"'\n\n'", "chr(10) || chr(10)"), "norm_whitespace", text.normalize_whitespace)
normal(rx(SQUEEZED, (" +([,.;:)-])", r"\1"), ("([(-]) *", r"\1"), ("([,;:])([^ ])", r"\1 \2")), "norm_punctuation", text.punctuation_spacing)
normal("upper(" + rx("replace(text, 'ß', 'ss')", (r"[ \t\n\r\f\v]+", " "), ("^ | $", "")) + ")", "norm_matching", text.for_matching)
normal("translate(upper(replace(text, 'ß', 'ss')), 'OIL', '011')", "norm_code_digits", lambda c: text.codeish_digits(c, bar=False))
normal("round(CASE WHEN length(regexp_replace(text, '[^\\pL]', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) / length(regexp_replace(text, '[^\\pL]', '', 'g')) END, 6)", "norm_upper_ratio", lambda c: F.round(text.uppercase_ratio(c), 6))


DEHYPHENATED = rx("text", (r"([\pL\pN_])-\n([\pL\pN_])", r"\1\2"))
normal(rx(rx(DEHYPHENATED, (r"[\s\x{85}\p{Z}]+", " "), ("^ | $", "")), (" +([,.;:)-])", r"\1"), ("([(-]) *", r"\1"), ("([,;:])([^ ])", r"\1 \2")), "norm_text_field", text.text_field)
normal(rx("text", (r"(?m)^[ \t]*[0-9]+[ \t]*$", ""), (r"\n{3,}", "CR"), (r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")).replace("'CR'", "chr(10) || chr(10)"), "norm_page_noise", text.strip_page_noise)
normal("regexp_replace(text, '(?s)[,.].*$', '')", "norm_before_first", lambda c: text.before_first(c, "[,.]"))
normal("upper(" + rx("replace(text, 'ß', 'ss')", (r"[\s\x{85}\p{Z}]+", " "), ("^ | $", ""), (" *([:/\\-.,;]) *", r"\1")) + ")", "norm_heading", text.heading_text)


@query()
def norm_casefold(spark, sf):
    """NFKC and case folding (tested against Python's own)."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return rows.select("conv_id", "turn", text.casefolded(F.col("text")).alias("out"))


# --- layout ---------------------------------------------------------------------------------------------------------

L = f"WITH l AS ({lenses.LINES})"


def lines(spark, sf):
    return lenses.frame(spark, sf, lenses.LINES)


@query(f"""{L}, g AS (SELECT *, lead(y) OVER (PARTITION BY doc_id ORDER BY y) AS nxt, count(*) OVER (PARTITION BY doc_id) AS n FROM l), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nxt - y DESC, y) AS r FROM g WHERE n >= 6 AND nxt - y >= 45 AND y >= 0.05 * 800)
SELECT doc_id, (y + nxt) / 2 AS cutoff FROM w WHERE r = 1""")
def page_footer_cutoff(spark, sf):
    return layout.footer_cutoff(lines(spark, sf), ["doc_id"], 800.0, share=0.05)


@query(f"""{L}, b AS (SELECT p.doc_id, p.pos, p.y AS high, min(q.y) AS low, count(*) AS n FROM l p JOIN l q ON p.doc_id = q.doc_id AND q.y BETWEEN p.y - 30 AND p.y GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, high) AS k FROM b) SELECT doc_id, low, high, n FROM r WHERE k = 1 AND n >= 2""")
def page_densest_band(spark, sf):
    return layout.densest_band(lines(spark, sf), ["doc_id"])


@query(f"{L}, o AS (SELECT doc_id, length(text) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY length(text)) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM l) SELECT doc_id, avg(w) FILTER (k IN ((n + 1) // 2, n // 2 + 1)) AS median, max(w) FILTER (k = n // 2 + 1) AS upper FROM o GROUP BY doc_id")
def page_median_width(spark, sf):
    rows = lines(spark, sf).withColumn("w", F.length("text").cast("long"))
    return layout.median_width(rows, ["doc_id"], "w")


@query(f"{L}, c AS (SELECT doc_id, x AS v, count(*) AS n FROM l GROUP BY ALL) SELECT doc_id, round_even(arg_max(v, (n, -v)) / 2, 0) * 2 AS mode FROM c GROUP BY doc_id")
def page_left_margin(spark, sf):
    return layout.binned_mode(lines(spark, sf), ["doc_id"], "x")


@query(f"""{L}, t AS (SELECT doc_id, trim(text) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l WHERE trim(text) <> ''),
f AS (SELECT doc_id, count(*) FILTER (regexp_matches(t, '^\\(\\s*[0-9]+\\s*\\)')) AS inids, count(*) FILTER (n <= 120 AND regexp_matches(t, '^[0-9]{{1,3}}[.]\\s+\\S')) AS k, count(*) AS lines, CAST(floor(median(length(t))) AS INT) AS median FROM t GROUP BY doc_id)
SELECT doc_id, CASE WHEN inids >= 3 THEN 'inid' WHEN k >= 2 OR (lines >= 18 AND median >= 18) THEN 'body' ELSE 'unknown' END AS kind, inids, lines, median FROM f""".replace("{{1,3}}", "{1,3}"))
def page_kinds(spark, sf):
    return layout.page_signals(lines(spark, sf), ["doc_id"])


RUNS = """WITH p AS (SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS page,
CASE WHEN o_orderkey % 5 < 2 THEN 'drawing' WHEN o_orderkey % 5 = 2 THEN 'body' WHEN o_orderkey % 7 = 0 THEN 'inid' ELSE 'unknown' END AS kind FROM {orders})"""


def runs(spark, sf):
    return lenses.frame(spark, sf, f"{RUNS} SELECT * FROM p")


@query(f"""{RUNS}, k AS (SELECT * FROM p WHERE kind <> 'unknown'), u AS (SELECT p.*, (SELECT max(page) FROM k WHERE k.doc_id = p.doc_id AND k.page < p.page) AS b, (SELECT min(page) FROM k WHERE k.doc_id = p.doc_id AND k.page > p.page) AS a FROM p)
SELECT u.doc_id, u.page, CASE WHEN u.kind = 'unknown' AND x.kind = 'drawing' AND y.kind = 'drawing' AND a - b - 1 <= 2 THEN 'drawing' ELSE u.kind END AS kind FROM u LEFT JOIN k x ON x.doc_id = u.doc_id AND x.page = b LEFT JOIN k y ON y.doc_id = u.doc_id AND y.page = a""")
def page_smoothed(spark, sf):
    return layout.smooth_drawings(runs(spark, sf))


@query(f"""{RUNS}, f AS (SELECT doc_id, min(page) FILTER (kind = 'inid') AS f, max(page) AS m FROM p GROUP BY doc_id)
SELECT f.doc_id, CASE WHEN f IS NULL THEN 0 ELSE coalesce((SELECT min(page) FROM p WHERE p.doc_id = f.doc_id AND kind IN ('drawing', 'body') AND page > f), m + 1) END AS cutoff FROM f""")
def page_inid_cutoff(spark, sf):
    return layout.inid_cutoff(runs(spark, sf))


ROLE = """CASE WHEN regexp_matches(upper(t), '^(BACKGROUND|SUMMARY|FIELD|CLAIMS|TECHNICAL FIELD|DETAILED DESCRIPTION)$') THEN 'section_heading' WHEN regexp_matches(t, '^[0-9]{4}') THEN 'para_marker'
WHEN regexp_matches(t, '^([0-9]+|[IVXLC]+|[A-Z])([.):])?$') OR regexp_matches(t, '^\\([ ]*[0-9]+[ ]*\\)$') THEN 'enumerator' WHEN length(t) <= 90 AND regexp_matches(t, '^[A-Z0-9][A-Z0-9\\s\\-:,]{3,}$') AND NOT suffix(t, '.') THEN 'subheading' ELSE 'paragraph' END"""


@query(f"""{L}, t AS (SELECT *, trim(text) AS t FROM l WHERE trim(text) <> ''), r AS (SELECT *, {ROLE} AS role, y - lag(y) OVER w AS gap FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
b AS (SELECT doc_id, round_even(x / 2, 0) * 2 AS m, count(*) AS n FROM r WHERE role NOT IN ('section_heading', 'subheading') AND length(t) >= 35 GROUP BY ALL), m AS (SELECT doc_id, arg_max(m, (n, -m)) AS m FROM b GROUP BY doc_id),
g AS (SELECT doc_id, coalesce(median(gap) FILTER (gap > 0), 10) AS typical FROM r GROUP BY doc_id),
p AS (SELECT r.*, m, typical, role IN ('section_heading', 'subheading') AS alone, lag(role) OVER w AS was, lag(x) OVER w AS px, length(lag(t) OVER w) < 45 AS short, regexp_matches(lag(t) OVER w, '[.!?]["'')\\]]?\\s*$') AS ended FROM r LEFT JOIN m USING (doc_id) JOIN g USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
o AS (SELECT *, CASE WHEN alone OR was IS NULL OR was IN ('section_heading', 'subheading') OR role = 'para_marker' THEN true WHEN role = 'enumerator' THEN regexp_matches(t, '^[0-9]{{1,3}}\\s*[.]$')
  ELSE gap >= greatest(16, 2.4 * typical) OR (m IS NOT NULL AND ((x - m >= 10 AND abs(px - m) <= 3.5 AND (ended OR short)) OR (abs(x - m) <= 3.5 AND px - m >= 10) OR (short AND ended AND abs(x - m) <= 3.5))) END AS opens FROM p),
k AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS block FROM o)
SELECT doc_id, block, CASE WHEN max(alone::INT) = 1 THEN max(role) ELSE 'paragraph' END AS kind, string_agg(t, chr(10) ORDER BY pos) AS text, min(y) AS y0, max(y) AS y1 FROM k GROUP BY doc_id, block""".replace("{{1,3}}", "{1,3}"))
def body_paragraphs(spark, sf):
    return layout.paragraphs(lines(spark, sf), ["doc_id"]).select("doc_id", "block", "kind", "text", "y0", "y1")


TAGS = "WITH b AS (SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn AS INT) AS pos, role AS tag, text FROM {conversations} WHERE text IS NOT NULL)"


@query(f"{TAGS}, w AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, tag ORDER BY pos) AS l FROM b) SELECT doc_id, tag, string_agg(text, chr(10) ORDER BY pos) AS text FROM w WHERE l IS NULL OR l <> text GROUP BY doc_id, tag")
def block_texts(spark, sf):
    return layout.tagged_texts(lenses.frame(spark, sf, f"{TAGS} SELECT * FROM b"))


@query(f"{TAGS}, u AS (SELECT *, CASE WHEN tag = 'user' THEN text END AS v FROM b) SELECT doc_id, pos, (SELECT arg_max(x.v, x.pos) FROM u x WHERE x.doc_id = u.doc_id AND x.pos <= u.pos AND x.v IS NOT NULL) AS last FROM u")
def block_carry_forward(spark, sf):
    rows = lenses.frame(spark, sf, f"{TAGS} SELECT * FROM b").withColumn("v", F.when(F.col("tag") == "user", F.col("text")))
    return layout.carry_forward(rows, ["doc_id"], "pos", "v", "last").select("doc_id", "pos", "last")


@query(f"{L} SELECT doc_id, pos, CAST(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos) - length(text) - 2 AS BIGINT) AS start, CAST(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos) - 2 AS BIGINT) AS stop FROM l")
def block_offsets(spark, sf):
    rows = sections.linearize(lines(spark, sf))
    return rows.select("doc_id", "pos", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


HEADS = """WITH h AS (SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS pos, CAST(l_partkey % 6 AS INT) AS h, CAST(l_partkey AS STRING) AS v FROM {lineitem}),
b AS (SELECT doc_id, pos, h, v, CASE h WHEN 0 THEN 'BACKGROUND OF THE INVENTION' WHEN 1 THEN 'I. Summary:' WHEN 2 THEN 'Detailed  Description' ELSE concat('part number ', v) END AS text FROM h)"""


@query(f"""{HEADS}, k AS (SELECT *, max(CASE WHEN h < 3 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS at_ FROM b)
SELECT k.doc_id, CASE s.h WHEN 0 THEN 'background' WHEN 1 THEN 'summary' ELSE 'detailed_description' END AS section, string_agg(k.text, chr(10) || chr(10) ORDER BY k.pos) AS text
FROM k JOIN h s ON s.doc_id = k.doc_id AND s.pos = k.at_ WHERE k.h >= 3 GROUP BY ALL""")
def body_sections(spark, sf):
    return sections.sections(lenses.frame(spark, sf, f"{HEADS} SELECT doc_id, pos, text FROM b"))


@query(f"{HEADS} SELECT doc_id, pos, CASE WHEN h < 3 THEN 'section_heading' ELSE 'paragraph' END AS role FROM b")
def line_roles(spark, sf):
    return lenses.frame(spark, sf, f"{HEADS} SELECT doc_id, pos, text FROM b").select("doc_id", "pos", sections.line_role(F.col("text")).alias("role"))


# --- drawings -------------------------------------------------------------------------------------------------------

X = f"WITH x AS ({lenses.BOXES}), l AS (SELECT * FROM x WHERE k <= 2), c AS (SELECT * FROM x WHERE k > 2)"


def boxes(spark, sf):
    rows = lenses.frame(spark, sf, lenses.BOXES)
    return rows.where("k <= 2"), rows.where("k > 2"), rows


@query(f"""{X}, s AS (SELECT c.page, c.k, l.k AS label,
(power((c.x0 + c.x1) / 2 - (l.x0 + l.x1) / 2, 2) + power((c.y0 + c.y1) / 2 - (l.y0 + l.y1) / 2, 2)) * CASE WHEN (c.y0 + c.y1) / 2 > (l.y0 + l.y1) / 2 THEN 3 ELSE 1 END
* CASE WHEN greatest(0, least(c.x1, l.x1) - greatest(c.x0, l.x0)) * greatest(0, least(c.y1, l.y1) - greatest(c.y0, l.y0)) / ((c.x1 - c.x0) * (c.y1 - c.y0)) >= 0.10 THEN 5 ELSE 1 END AS score FROM c JOIN l USING (page)),
r AS (SELECT *, row_number() OVER (PARTITION BY page, k ORDER BY score, label) AS n FROM s) SELECT page, k, label, round(score, 6) AS score FROM r WHERE n = 1""")
def drawing_assignment(spark, sf):
    labels, parts, _ = boxes(spark, sf)
    return drawings.assign(parts, labels).withColumn("score", F.round("score", 6))


@query(f"{X} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM x GROUP BY page")
def drawing_union(spark, sf):
    return drawings.union_box(boxes(spark, sf)[2], ["page"])


@query(f"{X} SELECT page, coalesce(max(CASE WHEN x1 - x0 >= 0.45 * 120 AND y1 - y0 <= 0.18 * 800 AND y1 <= 0.25 * 800 THEN y1 + 0.01 * 800 END), 80.0)::DOUBLE AS cut FROM x GROUP BY page")
def drawing_header_cut(spark, sf):
    return drawings.header_cut(boxes(spark, sf)[2], 120.0, 800.0)


@query(f"{X} SELECT page, k, CAST(trunc(greatest(0, x0 - 12)) AS INT) AS x0, CAST(trunc(greatest(0, y0 - 12)) AS INT) AS y0, CAST(trunc(least(500, x1 + 12)) AS INT) AS x1, CAST(trunc(least(800, y1 + 12)) AS INT) AS y1 FROM x")
def drawing_padded(spark, sf):
    rows = drawings.padded(boxes(spark, sf)[2], 12.0, 500, 800)
    return rows.select("page", "k", *[F.col(s).cast("int").alias(s) for s in drawings.SIDES])


@query(f"{X}, p AS (SELECT page, k, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM l) SELECT p.page, p.k, round(coalesce((x + (SELECT max(x) FROM p q WHERE q.page = p.page AND q.x < p.x)) / 2, 0), 6) AS x0, round(coalesce((y + (SELECT max(y) FROM p q WHERE q.page = p.page AND q.y < p.y)) / 2, 0), 6) AS y0, round(coalesce((x + (SELECT min(x) FROM p q WHERE q.page = p.page AND q.x > p.x)) / 2, 1), 6) AS x1, round(coalesce((y + (SELECT min(y) FROM p q WHERE q.page = p.page AND q.y > p.y)) / 2, 1), 6) AS y1 FROM p")
def drawing_partition(spark, sf):
    cells = drawings.partition_boxes(boxes(spark, sf)[0])
    return cells.select("page", "k", *[F.round(s, 6).alias(s) for s in drawings.SIDES])


@query(f"{X} SELECT page, k FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.page = c.page AND least(c.y1, l.y1) - greatest(c.y0, l.y0) >= 0.6 * (c.y1 - c.y0) AND least(c.x1, l.x1) - greatest(c.x0, l.x0) >= 0.25 * (c.x1 - c.x0))")
def drawing_clear_lines(spark, sf):
    labels, parts, _ = boxes(spark, sf)
    return drawings.without_overlapped(parts, labels).select("page", "k")


@query(f"""{C}, g AS (SELECT DISTINCT doc_id, CAST(fig AS STRING) AS f FROM c WHERE fig IS NOT NULL), w AS (SELECT DISTINCT doc_id, CAST(number AS STRING) AS f FROM c),
k AS (SELECT DISTINCT doc_id FROM c) SELECT k.doc_id, (SELECT count(*) FROM g WHERE g.doc_id = k.doc_id) AS n_regions,
coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM w WHERE w.doc_id = k.doc_id AND f NOT IN (SELECT f FROM g WHERE g.doc_id = k.doc_id)), '') AS missing,
coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM g WHERE g.doc_id = k.doc_id AND f NOT IN (SELECT f FROM w WHERE w.doc_id = k.doc_id)), '') AS extra FROM k""")
def drawing_sheets(spark, sf):
    rows = claim_rows(spark, sf)
    got = rows.select("doc_id", F.col("pos").alias("page"), F.explode(tokens.figure_ids(F.col("text"))).alias("figure"))
    want = rows.select("doc_id", F.col("number").cast("string").alias("figure"))
    out = drawings.aggregate_sheets(got, want)
    return out.select("doc_id", "n_regions", joined("missing").alias("missing"), joined("extra").alias("extra"))


@query()
def drawing_merged(spark, sf):
    """Boxes united to a fix point (sequential, so without SQL)."""
    return drawings.merge_boxes(boxes(spark, sf)[2])


# --- words ----------------------------------------------------------------------------------------------------------

WORDS = f"""WITH l AS ({lenses.LINES}), w AS (SELECT doc_id, pos, {{words}} FROM l),
x AS (SELECT doc_id, pos, k, text, CAST(sum(length(text) * 6 + CASE WHEN k % 9 = 8 THEN 30 ELSE 4 END) OVER (PARTITION BY doc_id, pos ORDER BY k) - length(text) * 6 AS DOUBLE) AS x0 FROM w)"""
DUCK_WORDS = WORDS.replace("{words}", "unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS k")


def words(spark, sf):
    sql = WORDS.replace("{words}", "posexplode(split(text, ' ', -1)) AS (k, text)")
    return lenses.frame(spark, sf, f"{sql} SELECT doc_id, pos, k, text, x0, x0 + length(text) * 6 AS x1 FROM x")


@query(f"""{DUCK_WORDS}, g AS (SELECT *, x0 + length(text) * 6 AS x1, lag(x0 + length(text) * 6) OVER (PARTITION BY doc_id, pos ORDER BY x0) AS p FROM x),
c AS (SELECT *, sum(CASE WHEN x0 - p >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pos ORDER BY x0) AS cluster FROM g)
SELECT doc_id, pos, cluster::BIGINT AS cluster, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM c GROUP BY ALL""")
def word_clusters(spark, sf):
    found = layout.clusters(words(spark, sf), ["doc_id", "pos"])
    return found.groupBy("doc_id", "pos", "cluster").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(f"""{DUCK_WORDS} SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(string_agg(text, ' ' ORDER BY k), ' ([,.;:)\\]}}%])', '\\1', 'g'), '([(\\[{{]) ', '\\1', 'g'), '- ', '-', 'g') AS text FROM x GROUP BY doc_id, pos""")
def word_lines(spark, sf):
    return layout.joined_words(words(spark, sf), ["doc_id", "pos"]).select("doc_id", "pos", "text")


@query(f"""{DUCK_WORDS} SELECT doc_id, count(*) AS n FROM x WHERE length(trim(text)) <= 6 AND NOT regexp_matches(trim(text), '^\\([0-9]+\\)$') AND NOT regexp_matches(trim(text), '^[0-9]{{1,3}}[.]$')
AND (regexp_matches(trim(text), '^[0-9]+$') OR (length(trim(text)) <= 4 AND regexp_matches(trim(text), '[0-9]'))) GROUP BY doc_id""")
def word_line_numbers(spark, sf):
    return words(spark, sf).where(layout.likely_line_number(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def word_grouping(spark, sf):
    """Words to lines in their order, which decides the result (so without SQL)."""
    rows = words(spark, sf).select("doc_id", (F.row_number().over(_reading()) - 1).alias("word_no"), (F.col("pos") * 12.0 + F.col("k") % 3).alias("y0"), (F.col("pos") * 12.0 + F.col("k") % 3 + 8).alias("y1"), "text")
    return layout.group_lines(rows, ["doc_id"]).groupBy("doc_id", "line").agg(F.count("*").alias("n"))


def _reading():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("pos", "k")


HEADER = """WITH h AS (SELECT CAST(o_orderkey AS BIGINT) AS doc_id, CAST(o_orderkey % 6 AS INT) AS k, CASE o_orderkey % 6 WHEN 0 THEN concat('US 2009/0', 100000 + o_orderkey, ' A1') WHEN 1 THEN 'Dec. 8, 2009' WHEN 2 THEN 'Sheet 4 of 10'
WHEN 3 THEN 'Patent Application Publication' WHEN 4 THEN concat('type B2 no ', o_orderkey) ELSE concat('a part of the body ', o_orderkey) END AS text FROM {orders})"""


@query(f"{HEADER} SELECT doc_id, k < 5 AS is_header FROM h")
def header_lines(spark, sf):
    return lenses.frame(spark, sf, f"{HEADER} SELECT * FROM h").select("doc_id", layout.header_metadata(F.col("text")).alias("is_header"))


TOP = "SELECT CAST(doc_id AS BIGINT) AS doc_id, pos, CAST(30 + 14 * pos + CASE WHEN pos > 4 THEN 60 ELSE 0 END AS DOUBLE) AS y, CASE WHEN pos = 0 AND doc_id % 2 = 0 THEN 'Sheet 4 of 10' ELSE text END AS text FROM ({lines})"


def top_lines(spark, sf):
    return lenses.frame(spark, sf, TOP.replace("{lines}", lenses.LINES))


LIKE_HEADER = " OR ".join(f"regexp_matches(title, '{p}')" for p in (*layout.PUBLISHED[:2], layout.DATE, layout.SHEET_OF, layout.KIND))


@query(f"""WITH l AS ({TOP.replace("{lines}", lenses.LINES)}), t AS (SELECT * FROM l WHERE y <= 176), d AS (SELECT p.doc_id, p.y AS high, min(q.y) AS low, count(*) AS n FROM t p JOIN t q ON p.doc_id = q.doc_id AND q.y BETWEEN p.y - 30 AND p.y GROUP BY p.doc_id, p.pos, p.y),
b AS (SELECT doc_id, low, high FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, high) AS k FROM d) WHERE k = 1 AND n >= 2),
s AS (SELECT l.*, low, high, lead(y) OVER (PARTITION BY l.doc_id ORDER BY y, pos) - y AS gap FROM l JOIN b USING (doc_id) WHERE y <= 360 AND y >= low - 2),
f AS (SELECT doc_id, any_value(high) AS high, coalesce(string_agg(trim(text), ' ' ORDER BY y, pos) FILTER (y BETWEEN low AND high), '') AS title, count(*) AS n, coalesce(median(gap) FILTER (gap > 0), 10) AS typical FROM s GROUP BY doc_id),
w AS (SELECT s.doc_id, min(y) AS edge FROM s JOIN f USING (doc_id) WHERE n >= 6 AND y >= s.high + 4 AND gap >= greatest(24, 2.5 * typical) GROUP BY s.doc_id),
e AS (SELECT f.doc_id, CASE WHEN {LIKE_HEADER} THEN least(high + 4, 80) ELSE coalesce(edge, high) + 4 END AS e FROM f LEFT JOIN w USING (doc_id))
SELECT l.doc_id, count(*) FILTER (y <= e) AS n_header, count(*) FILTER (e IS NULL OR y > e) AS n_body FROM l LEFT JOIN e USING (doc_id) GROUP BY l.doc_id""")
def page_header_split(spark, sf):
    """Lines of the header and of the body of each page."""
    split = layout.split_header(top_lines(spark, sf), ["doc_id"], 800.0)
    return split.groupBy("doc_id").agg(F.count_if(F.col("region") == "header").alias("n_header"), F.count_if(F.col("region") == "body").alias("n_body"))


@query()
def page_field_blocks(spark, sf):
    """Field blocks of each page; every seventh line stands as a label (tested against a plain version)."""
    label = F.when(F.col("pos") % 7 == 3, F.concat(F.lit("("), (F.col("pos") % 90 + 10).cast("string"), F.lit(") "), "text")).otherwise(F.col("text"))
    rows = top_lines(spark, sf).select("doc_id", "pos", "y", (F.col("y") - 4).alias("y0"), (F.col("y") + 4).alias("y1"), label.alias("text"))
    return layout.field_blocks(rows, ["doc_id"]).select("doc_id", "first", "kind", "tag", F.length("text").alias("chars"))


@query(f"""WITH c AS ({lenses.CLAIMS}), o AS (SELECT *, number - lag(number) OVER (PARTITION BY doc_id ORDER BY pos) AS d FROM c),
t AS (SELECT doc_id, CAST(20 AS INT) AS start, CAST(least(25020, 19 + sum(length(concat(number, '. ', text)) + 1)) AS INT) AS "end", count(*) AS markers, count(*) FILTER (d > 0) AS increases, count(*) FILTER (d = 1) AS steps, count(*) FILTER (d < -3) AS falls FROM o GROUP BY doc_id)
SELECT *, 2 * markers + 2 * increases + 3 * steps - 10 * falls AS score FROM t WHERE markers >= 5""")
def claims_tail(spark, sf):
    """The claims region of the whole text, found by its numbers alone."""
    return claims.claims_tail(bodies(spark, sf), share=0.0)


# --- identifiers ----------------------------------------------------------------------------------------------------

IDS = """WITH r AS (SELECT CAST(o_orderkey AS BIGINT) AS doc_id, CAST(1000000 + o_orderkey AS INT) AS n, CAST(10 + o_orderkey % 90 AS INT) AS d FROM {orders}),
t AS (SELECT doc_id, n, d, concat('See 2009/0', substr(CAST(n AS STRING), 2, 6), ' AL, EP ', n, ' B1 and PCT/US', d, '/', 10000 + d, ', Int. Cl. GO1N ', d, '/0', d, '; 438/', d, '.5') AS text FROM r)"""


@query(f"""{IDS} SELECT doc_id, 'EP' || n || 'B1,US20090' || substr(n::STRING, 2, 6) || 'A1' AS patents, 'PCT/US' || d || '/' || (10000 + d) AS applications, 'G01N' || d || '/0' || d AS ipc FROM t""")
def identifiers(spark, sf):
    rows, c = lenses.frame(spark, sf, f"{IDS} SELECT * FROM t"), F.col("text")
    return rows.select("doc_id", joined(tokens.patent_ids(c)).alias("patents"), joined(tokens.application_ids(c)).alias("applications"), joined(tokens.ipc_codes(c)).alias("ipc"))


@query(f"{IDS} SELECT doc_id, 'SEE 2009/0' || substr(n::STRING, 2, 6) || ' AL, EP ' || n || ' 81 AND PCT/U5' || d || '/' || (10000 + d) || ', INT. CL. 601N' AS out FROM t".replace("601N", "G01N"))
def code_token_text(spark, sf):
    rows = lenses.frame(spark, sf, f"{IDS} SELECT doc_id, concat('See 2009/0', substr(CAST(n AS STRING), 2, 6), ' AL, EP ', n, ' B1 and PCT/US', d, '/', 10000 + d, ', Int. Cl. GO1N') AS text FROM t")
    return rows.select("doc_id", text.for_contains(F.col("text")).alias("out"))


PATHS = """WITH p AS (SELECT CAST(o_orderkey AS BIGINT) AS doc_id, o_orderkey % 2 = 0 AS has_regions, concat(CASE WHEN o_custkey % 3 = 0 THEN 'drawings/sheets/' ELSE 'drawings/' END, 'p', o_orderkey, CASE o_custkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.json' ELSE '.png' END) AS path FROM {orders})"""


@query(f"""{PATHS} SELECT doc_id, CASE WHEN strpos(path, 'sheets/') > 0 AND suffix(path, '.pdf') THEN 'sheet_pdfs' WHEN strpos(path, 'sheets/') > 0 AND suffix(path, '.png') THEN 'sheet_pngs' WHEN suffix(path, '.png') AND has_regions THEN 'figure_pngs' ELSE 'other' END AS bucket, path AS paths FROM p""")
def manifest_buckets(spark, sf):
    """Files by the manifest's lists; each of the lists has some."""
    return bundle.file_lists(lenses.frame(spark, sf, f"{PATHS} SELECT * FROM p")).select("doc_id", "bucket", joined("paths").alias("paths"))


@query(f"{C}, f AS (SELECT doc_id, count(fig) AS n FROM c GROUP BY doc_id) SELECT CAST(doc_id AS STRING) AS doc_id, '1.1.0' AS schema_version, count(*) AS n_claims, max(f.n) AS n_figures, CASE WHEN max(f.n) > 0 THEN 'claims,figures' ELSE 'claims' END AS artifacts FROM c JOIN f USING (doc_id) GROUP BY doc_id")
def bundle_manifest(spark, sf):
    rows = claim_rows(spark, sf).withColumn("doc_id", F.col("doc_id").cast("string"))
    figures = rows.select("doc_id", F.explode(tokens.figure_ids(F.col("text"))).alias("figure"))
    return bundle.manifest({"claims": rows, "figures": figures}).select("doc_id", "schema_version", "n_claims", "n_figures", joined("artifacts").alias("artifacts"))


# --- relations ------------------------------------------------------------------------------------------------------


@query(f"""{C}, a AS (SELECT DISTINCT doc_id // 2 AS g, number FROM c WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT doc_id // 2 AS g, number FROM c WHERE doc_id % 2 = 1)
SELECT coalesce(a.g, b.g) AS g, coalesce(a.number, b.number) AS number, CASE WHEN a.g IS NULL THEN 'added' WHEN b.g IS NULL THEN 'removed' ELSE 'both' END AS side FROM a FULL JOIN b ON a.g = b.g AND a.number = b.number""")
def number_reconciliation(spark, sf):
    """Numbers of two versions: on one side, on the other, on both."""
    rows = lenses.frame(spark, sf, lenses.CLAIMS).select(F.floor(F.col("doc_id") / 2).alias("g"), (F.col("doc_id") % 2).alias("s"), "number").distinct()
    side = lambda s: rows.where(F.col("s") == s).select("g", "number", F.lit(True).alias(f"_{s}"))
    both = side(0).join(side(1), ["g", "number"], "full")
    return both.select("g", "number", F.when(F.col("_0").isNull(), "added").when(F.col("_1").isNull(), "removed").otherwise("both").alias("side"))


@query(f"{I}, a AS (SELECT doc_id, code, message FROM i WHERE severity = 'error'), b AS (SELECT doc_id, code, message FROM i WHERE severity = 'warning') SELECT DISTINCT doc_id, message FROM (SELECT doc_id, message FROM a INTERSECT SELECT doc_id, message FROM b)")
def issue_overlap(spark, sf):
    """Messages that a document has both as errors and as warnings."""
    rows = issues(spark, sf)
    pick = lambda s: rows.where(F.col("severity") == s).select("doc_id", "message")
    return pick("error").intersect(pick("warning"))


@query(f"{I} SELECT doc_id, count(DISTINCT code) AS n_codes, round(avg(CASE WHEN severity = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM i GROUP BY doc_id")
def issue_rates(spark, sf):
    return issues(spark, sf).groupBy("doc_id").agg(F.count_distinct("code").alias("n_codes"), F.round(F.avg((F.col("severity") == "error").cast("double")), 6).alias("error_rate"))


from claimloom.plans import bodies as _bodies, documents, pages, sheets  # noqa: E402, F401  register their queries
