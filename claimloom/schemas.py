"""The tables of a document bundle as DDL."""

FRONT = "doc_id string, title string, abstract string, assignee string, inventors array<string>, publication_id string, application_id string, cited array<string>"
SECTIONS = "doc_id string, section string, text string"
CLAIMS = "doc_id string, pos int, number int, text string, depends_on array<int>, is_independent boolean"
FIGURES = "doc_id string, figure_number int, figure_suffix string, description string, raw_reference string"
MANIFEST = "doc_id string, schema_version string, sha256 string, n_claims bigint, n_figures bigint, artifacts array<string>"
WORDS = "doc_id string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string, block_no int, line_no int"
ISSUES = "doc_id string, seq bigint, severity string, code string, message string, inid string, meta string"

FIGURE_CONTEXT = "doc_id string, figure string, figure_number int, figure_suffix string, description string, sheet_png string, figure_png string, claims array<int>, excerpts array<string>"
CLAIM_CONTEXT = "doc_id string, number int, text string, parents array<struct<number:int,text:string>>, children array<struct<number:int,text:string>>, figures array<string>"
CITATION_CONTEXT = "id string, n_cited bigint, n_cited_here bigint, n_citing bigint"
ALIGNMENT = "pair bigint, a int, b int, similarity double, status string"
WARNING = "code string, message string"
#: What must hold for each row of a table: a name and a condition.
RULES = {
    "claims": {"number_is_positive": "number >= 1", "text_is_there": "trim(text) <> ''", "flag_fits_dependencies": "is_independent = (size(depends_on) = 0)", "no_claim_depends_on_itself": "NOT array_contains(depends_on, number)"},
    "figures": {"number_is_positive": "figure_number >= 1", "suffix_is_one_letter": "figure_suffix IS NULL OR figure_suffix RLIKE '^[A-Z]$'"},
    "sections": {"section_is_known": "section IN ('cross_reference', 'background', 'summary', 'brief_description_of_drawings', 'detailed_description', 'claims', 'abstract', 'other')"},
    "issues": {"severity_is_known": "severity IN ('error', 'warning', 'info')", "code_is_there": "code <> ''"},
}

BUNDLE = {"front": FRONT, "sections": SECTIONS, "claims": CLAIMS, "figures": FIGURES}
VERSION = "1.1.0"
