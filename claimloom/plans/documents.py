"""Queries over bundles: texts, contexts, JSON forms, statistics, versions, front-matter policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.functions import text, tokens
from claimloom.operators import claims, compare, diagnostics, documents, front
from claimloom.plans import lenses
from claimloom.plans.queries import IDS, C, I, bodies, claim_rows, fields, issues, joined, query, versions

FRONT = f"WITH r AS ({lenses.FRONT})"


def fronts(spark, sf):
    rows = lenses.frame(spark, sf, lenses.FRONT)
    return rows.select("doc_id", F.concat(F.lit("A device for "), "c_name", F.lit(".")).alias("abstract"), F.concat(F.lit("WIDGET "), "serial").alias("title"), F.col("c_name").alias("assignee"), F.array(F.lit("Ann"), F.concat(F.lit("Bo "), "serial")).alias("inventors"))


def parts(spark, sf):
    rows = lenses.frame(spark, sf, lenses.FRONT)
    each = F.array(F.struct(F.lit("background").alias("section"), F.concat(F.lit("Parts as in FIG. "), (F.col("serial") % 9).cast("string"), F.lit(" are known.")).alias("text")), F.struct(F.lit("summary").alias("section"), F.when(F.col("serial") % 2 == 0, "A summary.").alias("text")), F.struct(F.lit("claims").alias("section"), F.lit("1. A part.").alias("text")))
    return rows.select("doc_id", F.inline(each)).where("text is not null")


def files(spark, sf):
    rows = lenses.frame(spark, sf, lenses.FRONT).select("doc_id", "serial")
    each = F.array(F.struct(F.when(F.col("serial") % 3 == 0, "sheet_pngs").alias("bucket"), F.lit("drawings/sheets/sheet_p0002_dpi200.png").alias("path")), F.struct(F.when(F.col("serial") % 4 == 0, "figure_pngs").alias("bucket"), F.lit("drawings/p0002_3_dpi200.png").alias("path")))
    return rows.select("doc_id", F.inline(each)).where("bucket is not null")


def pictured(spark, sf):
    """A described figure for each one that a claim shows."""
    rows = claim_rows(spark, sf)
    return rows.select("doc_id", F.explode(tokens.figure_ids(F.col("text"))).alias("id")).distinct().select("doc_id", tokens.figure_number(F.col("id")).alias("figure_number"), tokens.figure_suffix(F.col("id")).alias("figure_suffix"), F.concat(F.lit("view "), "id").alias("description"))


TEXTS = f"""{FRONT}, t AS (SELECT doc_id, serial, 'A device for ' || c_name || '.' AS abstract, 'Parts as in FIG. ' || serial % 9 || ' are known.' AS background, CASE WHEN serial % 2 = 0 THEN 'A summary.' ELSE '' END AS summary, '' AS detailed_description, c_name FROM r)"""


@query(f"{TEXTS} SELECT doc_id, abstract, background, summary, detailed_description FROM t")
def document_texts(spark, sf):
    return documents.texts(fronts(spark, sf), parts(spark, sf))


CONTEXT = f"""{TEXTS}, c AS ({lenses.CLAIMS}), f AS (SELECT doc_id, fig, string_agg(DISTINCT number, ',' ORDER BY number) AS claims FROM c WHERE fig IS NOT NULL GROUP BY doc_id, fig)"""


@query(f"""{CONTEXT} SELECT f.doc_id, fig::VARCHAR AS figure, 'view ' || fig AS description, claims, CASE WHEN serial % 3 = 0 THEN 'drawings/sheets/sheet_p0002_dpi200.png' END AS sheet_png, CASE WHEN serial % 4 = 0 AND fig = 3 THEN 'drawings/p0002_3_dpi200.png' END AS figure_png,
CASE WHEN serial % 9 = fig THEN 'background: ' || background ELSE '' END AS excerpts FROM f LEFT JOIN t USING (doc_id)""")
def figure_contexts(spark, sf):
    """Every figure with its claims, images and first mentions."""
    out = documents.figure_contexts(pictured(spark, sf), claim_rows(spark, sf), documents.texts(fronts(spark, sf), parts(spark, sf)), files(spark, sf))
    return out.select("doc_id", "figure", "description", joined("claims").alias("claims"), "sheet_png", "figure_png", joined("excerpts").alias("excerpts"))


@query(f"{CONTEXT} SELECT f.doc_id, fig::VARCHAR AS figure, claims FROM f WHERE fig IN (2, 5)")
def figures_for_grading(spark, sf):
    out = documents.figure_contexts(pictured(spark, sf), claim_rows(spark, sf), documents.texts(fronts(spark, sf), parts(spark, sf)))
    return documents.for_grading(out, ["2", "5"]).select("doc_id", "figure", joined("claims").alias("claims"))


@query(f"{C} SELECT DISTINCT doc_id, fig AS figure_number, 'view ' || fig AS description FROM c WHERE fig = 7")
def figure_lookup(spark, sf):
    return documents.figure_lookup(pictured(spark, sf), F.lit("7")).select("doc_id", "figure_number", "description")


@query(f"""{C}, {TEXTS[5:]}, k AS (SELECT doc_id, string_agg('{{"number":' || number || ',"text":' || to_json(text)::VARCHAR || ',"is_independent":' || (parent IS NULL) || ',"depends_on":[' || coalesce(parent::VARCHAR, '') || ']}}', ',' ORDER BY number, pos) AS cs FROM c GROUP BY doc_id),
g AS (SELECT doc_id, string_agg('{{"id":"' || fig || '","number":' || fig || ',"suffix":null,"description":"view ' || fig || '"}}', ',' ORDER BY fig::VARCHAR) AS fs FROM (SELECT DISTINCT doc_id, fig FROM c WHERE fig IS NOT NULL) GROUP BY doc_id)
SELECT t.doc_id, '{{"meta":{{"id":' || t.doc_id || ',"title":"WIDGET ' || serial || '","assignee":"' || c_name || '","inventors":["Ann","Bo ' || serial || '"]}},"claims":' || coalesce('[' || cs || ']', 'null') || ',"figures":' || coalesce('[' || fs || ']', 'null')
|| ',"sections":{{"background":' || to_json(background)::VARCHAR || ',"summary":' || to_json(summary)::VARCHAR || ',"detailed_description":""}}}}' AS json FROM t LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)""")
def document_json(spark, sf):
    """A whole document as JSON."""
    return documents.as_json(fronts(spark, sf), parts(spark, sf), claim_rows(spark, sf), pictured(spark, sf))


@query(f"""{C}, {TEXTS[5:]}, k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (parent IS NULL) AS i, count(DISTINCT fig) AS f FROM c GROUP BY doc_id)
SELECT t.doc_id, coalesce(n, 0) AS total_claims, coalesce(i, 0) AS independent_claims, coalesce(n - i, 0) AS dependent_claims, coalesce(f, 0) AS total_figures, serial % 3 = 0 AS has_sheet_images, serial % 4 = 0 AS has_figure_images, CAST(2 AS INT) AS inventors_count, c_name AS assignee FROM t LEFT JOIN k USING (doc_id)""")
def document_statistics(spark, sf):
    return documents.statistics(fronts(spark, sf), claim_rows(spark, sf), pictured(spark, sf), files(spark, sf))


@query(f"{C}, k AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) SELECT doc_id, n AS total_claims FROM k WHERE n > 5 AND doc_id IN (SELECT o_orderkey FROM orders)")
def document_filter(spark, sf):
    """Documents of more than five claims."""
    return documents.matching(document_statistics(spark, sf), F.col("total_claims") > 5).select("doc_id", "total_claims")


@query(f"""{C}, l AS (SELECT doc_id, number, max_by(text, pos) AS text FROM c GROUP BY doc_id, number), p AS (SELECT e.doc_id, e.number, string_agg(e.parent || ':' || l.text, '|' ORDER BY e.parent) AS parents FROM e JOIN l ON l.doc_id = e.doc_id AND l.number = e.parent GROUP BY e.doc_id, e.number),
k AS (SELECT e.doc_id, e.parent AS number, string_agg(e.number || ':' || l.text, '|' ORDER BY e.number) AS children FROM e JOIN l ON l.doc_id = e.doc_id AND l.number = e.number GROUP BY e.doc_id, e.parent)
SELECT doc_id, number, text, coalesce(parents, '') AS parents, coalesce(children, '') AS children FROM l LEFT JOIN p USING (doc_id, number) LEFT JOIN k USING (doc_id, number)""")
def claim_contexts(spark, sf):
    """Every claim with the texts of its parents and children."""
    out = documents.claim_contexts(claim_rows(spark, sf))
    flat = lambda c: joined(F.transform(c, lambda x: F.concat_ws(":", x["number"], x["text"])), "|").alias(c)
    return out.select("doc_id", "number", "text", flat("parents"), flat("children"))


@query(f"""WITH RECURSIVE c AS ({lenses.CLAIMS}), l AS (SELECT doc_id, number, max_by(text, pos) AS text, min(parent) AS parent FROM c GROUP BY doc_id, number), e AS (SELECT DISTINCT doc_id, number, parent FROM c WHERE parent IS NOT NULL),
s AS (SELECT DISTINCT doc_id, number FROM c WHERE parent IS NULL), t AS (SELECT doc_id, number AS root, number, 1 AS n FROM s UNION ALL SELECT t.doc_id, t.root, e.number, n + 1 FROM t JOIN e ON e.doc_id = t.doc_id AND e.parent = t.number)
SELECT doc_id, root, count(*) AS n_nodes, max(n)::BIGINT AS n_levels FROM t GROUP BY doc_id, root""")
def claim_tree_nested(spark, sf):
    """Trees as JSON, by their numbers of nodes and their depth."""
    rows = claims.nested(claim_rows(spark, sf))
    deep = F.array_max(F.transform(F.sequence(F.lit(1), F.length("tree")), lambda i: F.lit(0)))
    opened = F.regexp_replace("tree", r'"(?:[^"\\]|\\.)*"', "")
    marks = F.filter(F.split(F.regexp_replace(opened, r"[^{}]", ""), ""), lambda x: x != "")
    level = F.aggregate(marks, F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("m")), lambda a, x: F.struct((a["d"] + F.when(x == "{", 1).otherwise(-1)).cast("long").alias("d"), F.greatest(a["m"], (a["d"] + F.when(x == "{", 1).otherwise(-1)).cast("long")).alias("m")))
    return rows.select("doc_id", "root", F.regexp_count("tree", F.lit('"number":')).cast("long").alias("n_nodes"), level["m"].alias("n_levels"))


@query(f"{C}, a AS (SELECT doc_id // 2 * 2 AS pair, count(*) FILTER (doc_id % 2 = 0) AS a, count(*) FILTER (doc_id % 2 = 1) AS b FROM c GROUP BY ALL) SELECT CAST(pair AS BIGINT) AS pair, a AS n_a, b AS n_b, a = 0 OR b = 0 AS claims_empty FROM a")
def claim_diff_summary(spark, sf):
    """Counts of a comparison by status; all claims of both sides are in them."""
    left, right = versions(spark, sf)
    out = compare.summary(compare.diff(left, right, compare.align(compare.similarities(left, right, threshold=0.3))))
    both = F.col("unchanged") + F.col("renumbered") + F.col("modified")
    return out.select("pair", (both + F.col("removed")).alias("n_a"), (both + F.col("added")).alias("n_b"), "claims_empty")


@query()
def claim_versions(spark, sf):
    """Phrases of changed claims, found in the later version (its steps are tested by themselves)."""
    left, right = versions(spark, sf)
    return compare.versions(left, right, near=0.3)["excerpts"]


@query(f"""{C}, p AS (SELECT doc_id, pos, trim(unnest(string_split_regex(text, '[,;:.]'))) AS p FROM c), q AS (SELECT DISTINCT doc_id, pos, CASE WHEN length(p) > 80 THEN regexp_replace(p[:80], '\\s+\\S*$', '') ELSE p END AS p FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY length(p) DESC, p) AS n FROM q WHERE length(p) >= 12) SELECT doc_id, pos, string_agg(p, '|' ORDER BY n) AS anchors FROM o WHERE n <= 30 GROUP BY doc_id, pos""")
def claim_anchors(spark, sf):
    """The phrases of each claim that are long enough to be found again."""
    rows = claim_rows(spark, sf).select("doc_id", "pos", compare.anchors(F.col("text")).alias("a"))
    return rows.where(F.size("a") > 0).select("doc_id", "pos", joined("a", "|").alias("anchors"))


@query()
def claim_line_diff(spark, sf):
    """Line differences of claims with the same number in two versions (difflib, so without SQL)."""
    left, right = versions(spark, sf)
    both = left.withColumnRenamed("text", "x").join(right.withColumnRenamed("text", "y"), ["pair", "id"])
    return both.select("pair", "id", compare.line_diff(F.regexp_replace("x", " ", "\n"), F.regexp_replace("y", " ", "\n")).alias("changes"))


# --- front matter and diagnostics -----------------------------------------------------------------------------------

STRICT = front.Policy(abstract=True, inventors_or_assignee=True, publication=True, application=True)


def thinned(spark, sf):
    """Fields of which some documents lack one or two."""
    d = F.col("doc_id")
    return fields(spark, sf).where(~((F.col("code") == "57") & (d % 5 == 0)) & ~(F.col("code").isin("73", "75") & (d % 7 == 0)) & ~((F.col("code") == "10") & (d % 3 == 0))).withColumn("raw", F.when((F.col("code") == "54") & (d % 4 == 0), " ").otherwise(F.col("raw")))


@query(f"""{FRONT} SELECT doc_id, 'error' AS severity, 'front_matter.missing_required_inid' AS code, '54' AS inid FROM r WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'error', 'front_matter.missing_required_inid', '57' FROM r WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'error', 'front_matter.missing_required_inid', '75' FROM r WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'error', 'front_matter.missing_required_inid', '10' FROM r WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'warning', 'front_matter.unexpected_inid', '99' FROM r WHERE serial % 7 = 0""")
def front_policy(spark, sf):
    return front.policy_issues(thinned(spark, sf), STRICT)


@query(f"{FRONT} SELECT DISTINCT doc_id FROM r WHERE doc_id % 4 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 0")
def front_failed(spark, sf):
    return front.failed(front.policy_issues(thinned(spark, sf), STRICT), STRICT)


@query(f"""{FRONT} SELECT doc_id, 'info' AS severity, 'inid_parse.abstract_tail' AS code FROM r WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'error', 'inid_parse.missing_title_text' FROM r WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'error', 'inid_parse.missing_pub_id_token' FROM r WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'warning', 'inid_parse.inventor_truncated' FROM r WHERE doc_id % 2 = 0 AND doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'warning', 'inid_parse.assignee_multiple_states' FROM r WHERE doc_id % 6 = 1 AND doc_id % 7 <> 0""")
def front_semantic_issues(spark, sf):
    d = F.col("doc_id")
    raw = F.when((F.col("code") == "75") & (d % 2 == 0), F.concat("raw", F.lit("; Cy,"))).when((F.col("code") == "73") & (d % 6 == 1), F.lit("(73) Assignee: One, CA (US); Two, NY (US)")).otherwise(F.col("raw"))
    return front.semantic_issues(front.semantic(thinned(spark, sf).withColumn("raw", raw)), STRICT).select("doc_id", "severity", "code")


@query(f"""{FRONT} SELECT doc_id, '{{"schema_version":"front_matter.v1","pages":[],"identification":{{"publication":{{"primary":"US' || grant_no || 'B2","tokens":["US' || grant_no || 'B2"]}}}},"application":{{"application_number":{{"primary":"' || series || '/' || serial || '","tokens":["' || series || '/' || serial || '"]}},"grant_date":"Jan. ' || (1 + serial % 28) || ', 2009"}},"technical":{{"title":"WIDGET FOR ' || upper(c_name) || '","abstract":"A device for ' || c_name || '.","ipc":{{"primary":"G01N21/' || series || '","tokens":["G01N21/' || series || '"]}},"uscl":{{"primary":"700/' || series || '","tokens":["700/' || series || '"]}},"references":{{"primary":"US' || grant_no || 'B2","tokens":["US' || grant_no || 'B2"]}},"claims_count":' || n_claims || ',"drawing_sheets_count":' || n_sheets || '}},"parties":{{"inventors":["Ann ' || cust || '","Bo ' || serial || '"],"assignee":"' || c_name || ', ' || n_name || '"}},"publication_id":"US' || grant_no || 'B2","publication_tokens":["US' || grant_no || 'B2"]}}' AS json FROM r""")
def front_json(spark, sf):
    """Front matter as canonical JSON."""
    return front.canonical(front.semantic(fields(spark, sf)))


@query(f"""{I}, o AS (SELECT doc_id, severity, seq, '{{"code":"' || code || '","message":"' || message || '","inid":' || CASE WHEN inid IS NULL THEN 'null' ELSE '"' || inid || '"' END || '}}' AS j FROM i),
g AS (SELECT doc_id, coalesce(string_agg(j, ',' ORDER BY seq) FILTER (severity = 'error'), '') AS e, coalesce(string_agg(j, ',' ORDER BY seq) FILTER (severity = 'warning'), '') AS w, coalesce(string_agg(j, ',' ORDER BY seq) FILTER (severity = 'info'), '') AS n,
count(*) FILTER (severity = 'error') AS ne, count(*) FILTER (severity = 'warning') AS nw, count(*) FILTER (severity = 'info') AS nn FROM o GROUP BY doc_id)
SELECT doc_id, '{{"errors":[' || e || '],"warnings":[' || w || '],"infos":[' || n || '],"summary":{{"num_errors":' || ne || ',"num_warnings":' || nw || ',"num_infos":' || nn || '}}}}' AS json FROM g""")
def issue_json(spark, sf):
    return diagnostics.as_json(issues(spark, sf))


@query(f"{I}, a AS (SELECT *, 1 AS k FROM i WHERE doc_id % 2 = 0 UNION ALL SELECT *, 2 FROM i WHERE doc_id % 3 = 0) SELECT doc_id, min(seq) AS seq, severity, code, message, inid FROM a GROUP BY doc_id, severity, code, message, inid")
def issue_merge(spark, sf):
    """Issues of two sources, each once."""
    rows = issues(spark, sf)
    return diagnostics.merge(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 3 = 0")).select("doc_id", "seq", "severity", "code", "message", "inid")


DATES = """WITH t AS (SELECT CAST(o_orderkey AS BIGINT) AS doc_id, concat('Filed Dec. ', 1 + o_orderkey % 28, ', 2009 and 2011-03-0', 1 + o_orderkey % 9, ' as ', 10 + o_orderkey % 90, '/', 100 + o_orderkey % 900, ',123 after US 7,629,', 100 + o_orderkey % 900, ' B2 and 2009/0', 100000 + o_orderkey, ' A1; Primary Examiner: X; REFERENCES CITED') AS text FROM {orders})"""


@query(f"""{DATES} SELECT doc_id, '2009-12-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || ',2011-03-0' || (1 + doc_id % 9) AS dates, (10 + doc_id % 90) || '/' || (100 + doc_id % 900) || '123' AS applications, '20090' || (100000 + doc_id) AS publications,
list_contains(regexp_extract_all(text, '[0-9]{{1,2}},[0-9]{{3}},[0-9]{{3}}'), '7,629,' || (100 + doc_id % 900)) AS has_patent, true AS cites FROM t""")
def running_text_tokens(spark, sf):
    """Dates and numbers in running text."""
    rows, c = lenses.frame(spark, sf, f"{DATES} SELECT * FROM t"), F.col("text")
    has = F.array_contains(tokens.us_patents(c), F.concat(F.lit("7629"), (100 + F.col("doc_id") % 900).cast("string")))
    return rows.select("doc_id", joined(tokens.dates(c)).alias("dates"), joined(tokens.application_numbers(c)).alias("applications"), joined(tokens.us_publications(c)).alias("publications"), has.alias("has_patent"), (c.rlike(tokens.REFERENCES) & c.rlike(tokens.EXAMINER)).alias("cites"))


@query("""SELECT conv_id, turn, trim(lower(regexp_replace(text, '[\\s\\x{85}\\p{Z}]+', ' ', 'g'))) AS words, CASE WHEN strpos(text, 'e') = 0 AND strpos(text, 'a') = 0 THEN text ELSE text[:CASE WHEN strpos(text, 'e') = 0 THEN strpos(text, 'a') WHEN strpos(text, 'a') = 0 THEN strpos(text, 'e') ELSE least(strpos(text, 'a'), strpos(text, 'e')) END - 1] END AS cut FROM conversations""")
def text_cuts(spark, sf):
    """Claim words, and texts up to the first of two stops."""
    rows, c = spark.read.parquet(f"{sf}/conversations.parquet"), F.col("text")
    return rows.select("conv_id", "turn", text.claim_words(c).alias("words"), text.earliest_cut(c, ["e", "a"])["text"].alias("cut"))


@query(f"""{IDS} SELECT doc_id, '' || n AS patents, '20090' || substr(n::STRING, 2, 6) AS publications FROM t""")
def document_references(spark, sf):
    """Cited grants and publications of a text."""
    rows = lenses.frame(spark, sf, f"{IDS} SELECT * FROM t")
    refs = documents.references(F.col("text"))
    return rows.select("doc_id", joined(refs["patents"]).alias("patents"), joined(refs["publications"]).alias("publications"))


@query(f"""{C} SELECT doc_id, 'no_claim_depends_on_itself' AS rule, count(*) AS n FROM c WHERE parent = number GROUP BY doc_id UNION ALL SELECT doc_id, 'number_is_even', count(*) FROM c WHERE number % 2 = 1 GROUP BY doc_id""")
def claim_rules(spark, sf):
    """Rows that break the rules of their table, and a rule that half of them break."""
    rules = schemas.RULES["claims"] | {"number_is_even": "number % 2 = 0"}
    return diagnostics.violations(claim_rows(spark, sf), rules)


RANGES = "WITH r AS (SELECT CAST(o_orderkey AS BIGINT) AS doc_id, CAST(1 + o_orderkey % 4 AS INT) AS a, CAST(o_custkey % 8 AS INT) AS b FROM {orders})"


@query(f"""{RANGES} SELECT doc_id, CASE WHEN a = b THEN a::VARCHAR WHEN a < b THEN list_aggregate(range(a, b + 1), 'string_agg', ',') ELSE a || ',' || b END AS numbers,
CASE WHEN b % 3 = 0 THEN a || 'A' ELSE list_aggregate(list_transform(range(0, b % 3 + 1), lambda i: a || chr(65 + i::INT)), 'string_agg', ',') END AS letters, list_aggregate(list_distinct_in_order, 'string_agg', ',') AS listed
FROM (SELECT *, CASE WHEN a = b THEN [a::VARCHAR, '9B'] ELSE [a::VARCHAR, b::VARCHAR, '9B'] END AS list_distinct_in_order FROM r)""")
def figure_ranges(spark, sf):
    """Ranges of numbers and of letters, and lists, as single figures."""
    rows, a, b = lenses.frame(spark, sf, f"{RANGES} SELECT * FROM r"), F.col("a").cast("string"), F.col("b").cast("string")
    end = F.concat(a, F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("b") % 3 + 1).cast("int")))
    return rows.select("doc_id", joined(tokens.figure_range(a, b)).alias("numbers"), joined(tokens.figure_range(F.concat(a, F.lit("A")), end)).alias("letters"), joined(tokens.figure_list(F.concat(a, F.lit(", "), b, F.lit(" and 9b")))).alias("listed"))


@query(f"""{FRONT}, m AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'US' || grant_no || 'B2' END AS publication_id, (doc_id % 4 = 0)::INT * 2 + (doc_id % 5 = 0)::INT + (doc_id % 7 = 0)::INT + (doc_id % 3 = 0)::INT * 2 + (serial % 7 = 0)::INT + (doc_id % 5 <> 0)::INT AS n_issues FROM r) SELECT doc_id, publication_id, n_issues::BIGINT AS n_issues FROM m""")
def front_parse(spark, sf):
    """Front matter with the number of its issues."""
    parsed, found = front.parse(thinned(spark, sf), STRICT)
    n = found.groupBy("doc_id").agg(F.count("*").alias("n_issues"))
    return parsed.select("doc_id", "publication_id").join(n, "doc_id", "left").select("doc_id", "publication_id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


__all__ = ["bodies"]
