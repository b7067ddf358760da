"""Literal cases of the Column functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text, tokens
from claimloom.operators import citations, claims, front, layout, sections


@pytest.fixture
def of(spark):
    def run(f, value):
        return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("o")).first()["o"]

    return run


@pytest.mark.parametrize("value,want", [
    ("The method of claim 1", [1]), ("as in claims 2-4", [2, 3, 4]), ("claim 9 to 7", [7, 8, 9]), ("claims 1, 3 and 5", [1, 3, 5]),
    ("any of claim 2, or claim 4", [2, 4]), ("claiming 3", []), ("claim 1-900", [1]), ("", []), ("claim 99999999999", []),
])
def test_depends_on(of, value, want):
    assert of(tokens.depends_on, value) == want


def test_depends_on_as_the_reference_reads_it(of):
    assert of(lambda c: tokens.depends_on(c, ref_compat=True), "any of claims 1-3") == []


@pytest.mark.parametrize("value,want", [
    ("1", ["1"]), ("2-5", ["2", "3", "4", "5"]), ("2A-2C", ["2A", "2B", "2C"]), ("2A-3A", ["2A", "3A"]), ("5-5", ["5"]), ("1, 2 and 3", ["1", "2", "3"]),
    ("1A-1C, 2 and 3", ["1A", "1B", "1C", "2", "3"]), ("1, 1, 2", ["1", "2"]), ("1–3", ["1", "2", "3"]), ("3a", ["3A"]),
])
def test_figure_list(of, value, want):
    assert of(tokens.figure_list, value) == want


def test_figure_ids(of):
    assert of(tokens.figure_ids, "FIG. 10 and FIGS. 2A-2B, 3") == ["10", "2A", "2B", "3"]
    assert of(tokens.figure_ids, "no figures") == []


@pytest.mark.parametrize("value,want", [
    ("US 2011/0054659 A1", ["US20110054659A1"]), ("US 6,878,301 B2", ["US6878301B2"]), ("6,878,301 B2", ["US6878301B2"]), ("2009/0296075 AL 12/2009", ["US20090296075A1"]),
    ("3,963,354 A", ["US3963354A"]), ("none", []),
])
def test_patent_ids(of, value, want):
    assert of(tokens.patent_ids, value) == want


def test_other_identifiers(of):
    assert of(tokens.application_ids, "12/527,981 and PCT/US08/54913") == ["12/527981", "PCT/US08/54913"]
    assert of(tokens.ipc_codes, "GO1N 21/88, H01L 21/66") == ["G01N21/88", "H01L21/66"]
    assert of(lambda c: tokens.ipc_codes(c, ref_compat=True), "H01L21/66") == ["H01121/66"]
    assert of(tokens.us_classes, "700/109; 315/111.21") == ["315/111.21", "700/109"]
    assert of(text.kind_code, "al") == "A1" and of(text.kind_code, "82") == "B2" and of(text.kind_code, "41") == "A1"


@pytest.mark.parametrize("f,value,want", [
    (text.dehyphenate, "exam-\nple", "example"), (text.normalize_whitespace, " a \t b\n\n\n\nc ", "a b\n\nc"), (text.punctuation_spacing, "Oct . 20 , 2016", "Oct. 20, 2016"),
    (text.punctuation_spacing, "1,000", "1, 000"), (text.strip_page_noise, "a\n 12 \nb", "a\n\nb"), (text.comparable, "A , b / c - d ( e ) 1 , 2 , 3", "A, b/c-d (e) 1,2,3"),
    (text.code_tokens, "goin 21/88 b0x", "G01N 21/88 80X"), (text.squeeze, " a  b\n", "a b"), (text.casefolded, "ﬁne – Straße ; x", "fine-strasse;x"),
])
def test_normalisation(of, f, value, want):
    assert of(f, value) == want


def test_casefold_equals_python(spark):
    rows = ["ÄÖÜ ß ﬀ", "Ⅳ ½", "İstanbul"]
    got = [r["o"] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string").select("i", text.casefolded(F.col("c")).alias("o")).orderBy("i").collect()]
    assert got == [unicodedata.normalize("NFKC", r).casefold() for r in rows]


@pytest.mark.parametrize("value,want", [
    ("BACKGROUND", "background"), ("II. Summary of the Invention:", "summary"), ("CROSS REFERENCE TO RELATED APPLICATIONS", "cross_reference"), ("A) FIELD", "background"),
    ("Detailed Description", "detailed_description"), ("0017", None), ("the background of it", None), ("What is claimed is:", "claims"), ("", None),
])
def test_section_key(of, value, want):
    assert of(sections.section_key, value) == want


@pytest.mark.parametrize("value,want", [("0017 The part", "para_marker"), ("12.", "enumerator"), ("( 3 )", "enumerator"), ("MAIN PARTS", "subheading"), ("SUMMARY", "section_heading"), ("Prose goes here.", "paragraph"), ("", "paragraph")])
def test_line_role(of, value, want):
    assert of(sections.line_role, value) == want


def test_front_fields(of):
    assert of(front.strip_prefix, " (54) (57) X") == "X"
    assert of(lambda c: front.clean(c, "73"), "(73) Assignee: Acme, Inc. (*) Notice: Subject") == "Acme, Inc."
    tail = of(front.abstract_tail, "A device. 14 Claims, 4 Drawing Sheets")
    assert (tail["text"], tail["claims_count"], tail["drawing_sheets_count"]) == ("A device.", 14, 4)
    only = of(front.abstract_tail, "A device. 4 Drawing Sheets")
    assert (only["text"], only["claims_count"]) == ("A device.", None)
    assert of(front.people, "A B; C D") == ["A B", "C D"] and of(front.people, "A\nB") == ["A", "B"]


def test_line_tests(of):
    assert [of(layout.likely_line_number, w) for w in ("12", "(3)", "4.", "a1", "abc")] == [True, False, False, True, False]
    assert [of(layout.header_metadata, w) for w in ("US 2009/0296075 A1", "Dec. 8, 2009", "Sheet 4 of 10", "an arm B2", "an arm B2 4", "prose")] == [True, True, True, True, True, False]


def test_citation_ids(of):
    assert of(citations.normalised, "US 7,629,993 B2") == "7629993" and of(citations.is_publication, "US20110054659A1") is True


STANDARD = "What is claimed is:\n1. A method of making a part, comprising a step.\n2. The method of claim 1, wherein the step is long.\n3. The method of claims 1 or 2 wherein it is short.\n4. An apparatus comprising a frame and a wheel.\n5. The apparatus of claim 4, further comprising a brake."


def split(spark, value):
    return claims.split_claims(spark.createDataFrame([("d", value)], "doc_id string, text string").withColumn("text", F.coalesce(claims.claims_block(F.col("text")), F.col("text")))).orderBy("pos").collect()


def test_claims(spark):
    got = split(spark, STANDARD)
    assert [r["number"] for r in got] == [1, 2, 3, 4, 5]
    assert [r["depends_on"] for r in got] == [[], [1], [1, 2], [], [4]]
    assert [r["is_independent"] for r in got] == [True, False, False, True, False]


@pytest.mark.parametrize("mark", ["2-", "2)", "2:", "2 -4"])
def test_damaged_marks(spark, mark):
    got = split(spark, STANDARD.replace("\n2.", f"\n{mark}"))
    assert [r["number"] for r in got][:2] == [1, 2] and got[1]["text"].startswith("The method of claim 1")


def test_dropped_period(spark):
    assert [r["number"] for r in split(spark, STANDARD.replace("\n2. The", "\n2 The"))] == [1, 2, 3, 4, 5]


def test_claims_end(spark):
    got = split(spark, STANDARD[: STANDARD.index("\n3.")] + "\nABSTRACT OF THE DISCLOSURE\n3. A method that isn't claimed, comprising a step.")
    assert [r["number"] for r in got] == [1, 2]


def test_falling_numbers_end_the_claims(spark):
    text_ = "\n".join(f"{n}. A method comprising step number {n} of the parts." for n in (1, 2, 6, 7, 1, 2))
    assert [r["number"] for r in split(spark, text_)] == [1, 2, 6, 7]


def test_cycles_end_a_chain(spark):
    rows = spark.createDataFrame([("d", 1, 1, "A part comprising a thing of some kind."), ("d", 2, 2, "of claim 1 and claim 3"), ("d", 3, 3, "of claim 2")], "doc_id string, pos int, number int, text string")
    paths = sorted(r["path"] for r in claims.tree(claims.dependencies(rows)).collect())
    assert paths == [[1], [1, 2], [1, 2, 3]]


def test_serials_of_more_than_six_digits(of):
    assert of(tokens.application_ids, "10/1,234,567, 12/527,981, 13/12345678 and 14/1,234") == ["10/1234567", "12/527981", "13/12345678"]
    assert of(lambda c: tokens.application_ids(c, ref_compat=True), "10/1,234,567 and 12/527,981") == ["12/527981"]
    assert of(tokens.us_publications, "2009/0123456 A1 and 2009/01234567 A1") == ["20090123456", "200901234567"]
    assert of(lambda c: tokens.us_publications(c, ref_compat=True), "2009/0123456 A1 and 2009/01234567 A1") == ["20090123456"]
