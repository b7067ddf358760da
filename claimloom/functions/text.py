"""Text normalisation as Column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, BLANK = "[\\p{L}\\p{N}_]", "[\\s\\x{85}\\p{Z}]"


def let(c: Column, body) -> Column:
    """body(c) with c evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def odd_parts(parts: Column) -> Column:
    """at (from 0) and part of the second, fourth, ... of adjoining parts, in order."""
    none = F.expr("cast(array() as array<struct<at: int, part: string>>)")

    def step(acc: Column, p: Column) -> Column:
        out = F.when(acc["k"] % 2 == 1, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), p.alias("part"))))).otherwise(acc["out"])
        return F.struct((acc["k"] + 1).alias("k"), (acc["at"] + F.length(p)).alias("at"), out.alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), none.alias("out")), step)["out"]


def after_first(c: Column, pattern: str, word: str) -> Column:
    """What follows the first match of a pattern whose matches all hold `word` in some case; else null."""
    rest = let(F.split(c, pattern, 2), lambda p: F.when(F.size(p) == 2, F.get(p, F.lit(1))))
    return F.when(F.lower(c).contains(word), rest)


def sub(c: Column, *rules: tuple[str, str]) -> Column:
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def strip(c: Column) -> Column:
    return sub(c, (f"^{BLANK}+|{BLANK}+$", ""))


def dehyphenate(c: Column) -> Column:
    """Joins words that a hyphen and a line end part."""
    return sub(c, (f"({WORD})-\\n({WORD})", "$1$2"))


def normalize_whitespace(c: Column, soft_hyphens: bool = False) -> Column:
    """Line ends to \\n, runs of blanks to one, three or more line ends to two."""
    c = F.translate(c, "­", "") if soft_hyphens else c
    return strip(sub(c, ("\\r", "\n"), ("[ \\t]+", " "), ("\\n{3,}", "\n\n")))


def squeeze(c: Column) -> Column:
    """All white space to single spaces."""
    return strip(sub(c, (f"{BLANK}+", " ")))


def punctuation_spacing(c: Column) -> Column:
    """No space before marks and after opening ones, one after commas, semicolons and colons (so 1,000 becomes 1, 000)."""
    return sub(squeeze(c), (" +([,.;:)-])", "$1"), ("([(-]) *", "$1"), ("([,;:])([^ ])", "$1 $2"))


def text_field(c: Column) -> Column:
    return punctuation_spacing(normalize_whitespace(dehyphenate(c)))


def strip_page_noise(c: Column) -> Column:
    """Without lines of digits only."""
    return strip(sub(c, ("(?md)^[ \\t]*[0-9]+[ \\t]*$", ""), ("\\n{3,}", "\n\n")))


def comparable(c: Column) -> Column:
    """Spacing around marks, brackets, slashes, dashes and in number series made uniform."""
    c = F.regexp_replace(c, "\\r\\n?", "\n")
    c = sub(c, ("­", ""), ("[   ]", " "), (f"({WORD})-{BLANK}*\\n{BLANK}*({WORD})", "$1$2"))
    c = sub(c, (f"{BLANK}+([,.;:])", "$1"), (f"([(\\[{{]){BLANK}+", "$1"), (f"{BLANK}+([)\\]}}])", "$1"))
    c = sub(c, (f"{BLANK}*/{BLANK}*", "/"), (f"{BLANK}*-{BLANK}*", "-"), (f"(?<=[0-9]){BLANK}*,{BLANK}*(?=[0-9])", ","))
    return F.coalesce(squeeze(c), F.lit(""))


def code_tokens(c: Column) -> Column:
    """Upper case; letters that look like digits become digits in tokens that hold a digit, and in prefixes of N/M."""
    token, pair = "[A-Z0-9][A-Z0-9/.\\-]*", "\\b([A-Z]{3,6})\\s+([0-9]{1,3}/[0-9]{1,4})\\b"
    digits = lambda t: F.translate(t, "OILSBZ", "011582")
    fixed = lambda t: F.when(t.rlike("[0-9]") & t.rlike("[A-Z/.\\-]"), digits(t)).otherwise(t)
    turned = lambda p: F.concat(digits(F.regexp_extract(p, "^([A-Z]+)", 1)), F.lit(" "), F.regexp_extract(p, "([0-9]+/[0-9]+)$", 1))
    return let(let(F.upper(c), lambda s: _replaced(s, token, fixed)), lambda s: _replaced(s, pair, turned))


def _replaced(s: Column, pattern: str, by) -> Column:
    """s with by(match) in the place of each match."""
    made = F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), by)
    return F.array_join(F.zip_with(F.split(s, pattern, -1), F.concat(made, F.array(F.lit(""))), lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")


def for_contains(c: Column) -> Column:
    return code_tokens(comparable(c))


def for_matching(c: Column) -> Column:
    """Upper case, soft hyphens gone, single spaces."""
    return F.upper(sub(normalize_whitespace(c, soft_hyphens=True), ("\\s+", " ")))


def codeish_digits(c: Column, bar: bool = True) -> Column:
    return F.translate(c, "OIL|", "0111") if bar else F.translate(F.upper(c), "OIL", "011")


def kind_code(c: Column) -> Column:
    """AL, AI, A| to A1; 8d to Bd; 4d to Ad."""
    k = F.translate(F.upper(c), " ", "")
    return F.when(k.rlike("^A[LI|]$"), "A1").when(k.rlike("^8[0-9]$"), F.concat(F.lit("B"), F.substring(k, 2, 1))).when(k.rlike("^4[0-9]$"), F.concat(F.lit("A"), F.substring(k, 2, 1))).otherwise(k)


def uppercase_ratio(c: Column) -> Column:
    letters = F.length(sub(c, ("[^\\p{L}]", "")))
    return F.when(letters == 0, 0.0).otherwise(F.length(sub(c, ("[^\\p{Lu}]", ""))) / letters)


def casefolded(c: Column) -> Column:
    """NFKC and full case folding, which Spark has no function for; dashes to -, no spaces around marks."""
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC").str.casefold()

    return squeeze(sub(F.translate(fold(c), "–—", "--"), (f"{BLANK}*([:/\\-.,;]){BLANK}*", "$1")))


def before_first(c: Column, pattern: str) -> Column:
    """The text before the first match."""
    return F.element_at(F.split(c, pattern, 2), 1)


def claim_words(c: Column) -> Column:
    """Lower case and single spaces, as claims are compared."""
    return F.lower(squeeze(c))


def heading_text(c: Column) -> Column:
    """A heading as headings are compared: compatible forms, dashes as hyphens, upper case."""
    return F.upper(casefolded(F.translate(c, "−–—‐‑", "-----")))


def earliest_cut(c: Column, patterns: list[str]) -> Column:
    """Struct of the text before the earliest match of any pattern, and its place from 0; the whole text and null without."""
    before = [F.when(c.rlike(p), F.length(before_first(c, p))) for p in patterns]
    at = before[0] if len(before) == 1 else F.least(*before)
    return F.struct(F.when(at.isNull(), c).otherwise(F.left(c, at)).alias("text"), at.alias("at"))


def without_label(c: Column, labels: list[str]) -> Column:
    """Struct of the text after the first of the labels that it begins with, and how many characters went."""
    one = F.regexp_replace(c, r"(?i)^\s*(?:" + "|".join(rf"\Q{x}\E" for x in labels) + r")\s*[:\x{2014}\-]?\s*", "")
    return F.struct(one.alias("text"), (F.length(c) - F.length(one)).alias("at"))
