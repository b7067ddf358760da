"""Claims: from a text to rows, their dependencies and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import tokens
from claimloom.functions.text import after_first, odd_parts, squeeze
from claimloom.stored import read, stable

# The marker of a claim's start, the texts that end the claims, and what a claim looks like.
_OPEN = "['\"‘’“”(\\[{]"
MARKER = (
    f"(?mid)(?:(?:^|(?<=\\s)){_OPEN}*\\s*(?<!claim\\s)(?<!claims\\s)(\\d{{1,3}})(\\s*(?:[.):]|[-–—]\\s*\\d{{0,2}})\\s*(?={_OPEN}?\\s*[A-Za-z])))"
    f"|(?:^\\s*{_OPEN}*\\s*(?<!claim\\s)(?<!claims\\s)(\\d{{1,3}})(\\s+(?=(?-i:(?:A|An|The|Means)\\b))))"
)
END_PHRASE = r"(?i)\b(?:ABSTRACT\s+OF\s+THE\s+(?:DISCLOSURE|INVENTION)|END\s+OF\s+CLAIMS|WHAT\s+IS\s+CLAIMED\s+ABOVE)\b"
END_STARS = r"(?md)^\s*(?:\*\s*){3,}$"
END_CAPS = r"(?md)^[A-Z\s]{20,}$"
STARTS = r"(?i)^\d{1,3}\.\s+(?:(?:A|An|The)\s+\w+|(?:In|For|As|According\s+to)\s+|\w+\s+of\s+claim\s+\d+|Claim\s+\d+\s+further\s+comprising)"
TELLING = (r"\ba\s+(?:method|apparatus|system|device|process|composition)", r"\ban\s+(?:apparatus|assembly|element)", r"\bthe\s+(?:method|apparatus|system|device)\s+of\s+claim", r"\bcomprising\b", r"\bwherein\b")
OTHER = (r"\bfig\.", r"\btable\s+\d+", r"\bpage\s+\d+", r"\bparagraph\s+\d+", r"^\d+\.\s+(?:background|summary|description|embodiment)")
ANCHOR = r"(?i)\b(?:what\s+is\s+claimed(?:\s+is)?|we\s+claim|i\s+claim|the\s+invention\s+claimed\s+is)\b\s*:?"
#: Stands before each claim number when a text is cut; texts are freed of it first.
_CUT = "\x01"


def looks_like_claim(c: Column) -> Column:
    head = F.lower(F.left(c, F.lit(100)))
    some = lambda patterns: F.greatest(*[head.rlike(p) for p in patterns])
    return (F.length(c) >= 30) & (c.rlike(STARTS) | (some(TELLING) & ~some(OTHER)))


def claims_end(c: Column) -> Column:
    """The text up to the first end phrase, else row of stars, else line of capitals."""
    cut = lambda p: F.element_at(F.split(c, p, 2), 1)
    return F.when(c.rlike(END_PHRASE), cut(END_PHRASE)).when(c.rlike(END_STARS), cut(END_STARS)).when(c.rlike(END_CAPS), cut(END_CAPS)).otherwise(c)


def claims_block(c: Column) -> Column:
    """What follows the anchor phrase."""
    return after_first(c, ANCHOR, "claim")


def claims_tail(docs: DataFrame, text: str = "text", key: str = "doc_id", share: float = 0.6, reach: int = 25_000, least: int = 5) -> DataFrame:
    """key, start, end, markers, increases, steps, falls, score of the best claims region in a text's last part (offsets from 0).

    A region begins at a claim number and holds those that begin within `reach` characters.  Numbers, increases and steps
    by one raise its score, falls by more than 3 lower it; the first of the best counts.
    """
    begins = F.floor(F.length(text) * share).cast("int")
    last = F.replace(F.substring(F.col(text), begins + 1, F.length(text)), F.lit(_CUT), F.lit(" "))
    cut = F.regexp_replace(last, f"({MARKER})", f"{_CUT}$1{_CUT}")
    listed = F.transform(odd_parts(F.split(cut, _CUT, -1)), lambda m: F.struct(m["at"].alias("at"), F.regexp_extract(m["part"], r"\d+", 0).try_cast("int").alias("n")))
    marks = docs.select(key, begins.alias("_begins"), F.length(text).alias("_length"), F.inline(listed)).withColumn("start", F.col("_begins") + F.col("at"))
    step = F.col("n") - F.lag("n").over(Window.partitionBy(key).orderBy("start"))
    facts = {"increases": step > 0, "steps": step == 1, "falls": step < -3}
    marks = marks.select("*", *[F.coalesce(c, F.lit(False)).cast("int").alias(f"_{name}") for name, c in facts.items()])
    ahead = Window.partitionBy(key).orderBy("start").rangeBetween(0, reach - 1)
    found = marks.withColumn("markers", F.count("*").over(ahead)).select("*", *[(F.sum(f"_{name}").over(ahead) - F.col(f"_{name}")).alias(name) for name in facts])
    score = 2 * F.col("markers") + 2 * F.col("increases") + 3 * F.col("steps") - 10 * F.col("falls")
    fine = found.where(F.col("markers") >= least).withColumn("score", score).withColumn("end", F.least(F.col("start") + reach, F.col("_length")))
    best = F.max_by(F.struct("start", "end", "markers", *facts, "score"), F.struct("score", -F.col("start")))
    return fine.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def split_claims(docs: DataFrame, text: str = "text", key: str = "doc_id", expected: str | None = None) -> DataFrame:
    """key, pos, number, text, depends_on, is_independent of the claims in a block of text.

    Slices run from number to number.  What comes before the first claim-like slice is skipped; the first slice that
    isn't claim-like ends the claims, as does a number that falls by more than 3, or one claim too many for `expected`.
    """
    body = claims_end(F.translate(F.col(text), _CUT, ""))
    cut = F.regexp_replace(body, MARKER, f"{_CUT}$1$3{_CUT}$2$4")
    parts = docs.select(key, *([expected] if expected else []), F.posexplode(F.split(cut, _CUT, -1)).alias("k", "part"))
    by = Window.partitionBy(key).orderBy("k")
    pairs = parts.withColumn("rest", F.lead("part").over(by)).where("k % 2 = 1")
    tail = F.regexp_replace(squeeze(F.col("rest")), "^(?:[).:]|[-–—]\\s*\\d{0,2})\\s*", "")
    one = pairs.select(key, *([expected] if expected else []), "k", F.col("part").try_cast("int").alias("number"), F.concat(F.trim("part"), F.lit(". "), tail).alias("chunk"))
    fine = one.withColumn("fine", looks_like_claim(F.col("chunk")))
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    past = fine.withColumn("begun", F.coalesce(F.max("fine").over(upto), F.lit(False))).where("begun or fine")
    last = F.last(F.when(F.col("fine"), F.col("number")), ignorenulls=True).over(upto)
    many = F.count("*").over(upto) >= F.col(expected) * 1.2 + 3 if expected else F.lit(False)
    stops = past.withColumn("stop", ~F.col("fine") | F.coalesce(last - F.col("number") > 3, F.lit(False)) | F.coalesce(many, F.lit(False)))
    stay = stops.withColumn("stopped", F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("not stopped")
    return dependencies(stay.select(key, F.row_number().over(by).alias("pos"), "number", F.regexp_extract("chunk", r"(?sd)^\s*\d+\s*\.\s*(.*)$", 1).alias("text")))


def dependencies(claims: DataFrame, ref_compat: bool = False) -> DataFrame:
    """The claims with depends_on and is_independent; ref_compat keeps every claim independent."""
    deps = tokens.depends_on(F.col("text"), ref_compat)
    return claims.withColumn("depends_on", deps).withColumn("is_independent", F.lit(True) if ref_compat else F.size("depends_on") == 0)


def edges(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, number, parent, one row for each distinct dependency."""
    return claims.select(key, "number", F.explode("depends_on").alias("parent")).distinct()


def validate(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, code, detail: duplicate and missing numbers, dependencies that don't exist, a first claim that depends."""
    claims = stable(claims.select(key, "number", "depends_on"))
    per = claims.groupBy(key).agg(F.collect_set("number").alias("have"), F.max("number").alias("most"))
    double = claims.groupBy(key, "number").count().where("count > 1").groupBy(key).agg(F.array_sort(F.collect_list("number")).alias("n"))
    lost = per.select(key, F.array_sort(F.array_except(F.sequence(F.lit(1), "most"), "have")).alias("n")).where("size(n) > 0")
    wanted = edges(claims, key).join(per.select(key, "most"), key).where(F.col("parent") <= F.col("most") + 5)
    have = claims.select(key, F.col("number").alias("parent")).distinct()
    broken = wanted.join(have, [key, "parent"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("parent")).alias("n"))
    first = claims.where("number = 1 and size(depends_on) > 0").groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("depends_on")))).alias("n"))
    code = lambda frame, name: frame.select(key, F.lit(f"body.claims.{name}").alias("code"), F.array_join("n", ",").alias("detail"))
    return code(double, "duplicate_numbers").unionByName(code(lost, "missing_numbers")).unionByName(code(broken, "depends_on_missing")).unionByName(code(first, "claim1_has_deps"))


def lookup(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """One claim for each number, the last one."""
    return claims.groupBy(key, "number").agg(F.max_by("text", "pos").alias("text"))


def dependents(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, number, children: the claims that depend on each claim."""
    return edges(claims, key).groupBy(key, F.col("parent").alias("number")).agg(F.array_sort(F.collect_set("number")).alias("children"))


def context(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, number, parents, children and figures of each claim number."""
    claims = stable(claims.select(key, "number", "depends_on", tokens.figure_ids(F.col("text")).alias("_figures")))
    own = claims.groupBy(key, "number").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("depends_on")))).alias("parents"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_figures")))).alias("figures"),
    )
    return own.join(dependents(claims, key), [key, "number"], "left").select(key, "number", "parents", F.coalesce("children", F.expr("cast(array() as array<int>)")).alias("children"), "figures")


def tree(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, root, number, depth, path of every chain of dependencies from an independent claim; cycles end a chain.

    Levels are joined one at a time until one is empty; their number is the length of the longest chain.  Claims are read
    once, and each level is a table that the next one reads.
    """
    claims = stable(claims.select(key, "number", "depends_on", "is_independent"))
    links = stable(edges(claims, key).withColumnsRenamed({"number": "child", "parent": "number"}))
    roots = claims.where("is_independent").select(key, F.col("number").alias("root"), "number").distinct()
    level = stable(roots.withColumn("depth", F.lit(0)).withColumn("path", F.array("number")))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        step = level.join(links, [key, "number"]).where(~F.array_contains("path", F.col("child")))
        level = stable(step.select(key, "root", F.col("child").alias("number"), F.lit(len(levels)).alias("depth"), F.concat("path", F.array("child")).alias("path")))
    return read(level.sparkSession, level.schema, *[n for one in levels for n in one._names]) if levels else level


def nested(claims: DataFrame, key: str = "doc_id", most: int = 100) -> DataFrame:
    """key, root, tree: each independent claim as JSON with the claims that depend on it below it, texts cut at `most` characters.

    A claim stands below each claim that it depends on; cycles end.  Trees are put together from their deepest level up.
    """
    claims = stable(claims.select(key, "pos", "number", "text", "depends_on", "is_independent"))
    one = claims.groupBy(key, "number").agg(F.max_by("text", "pos").alias("_t"))
    cut = F.when(F.length("_t") > most, F.concat(F.left("_t", F.lit(most)), F.lit("..."))).otherwise(F.col("_t"))
    rows = stable(tree(claims, key).select(key, "root", "number", "depth", F.array_join("path", ">").alias("path")).join(one.select(key, "number", cut.alias("text")), [key, "number"]))
    node = lambda children: F.concat(F.lit('{"number":'), F.col("number").cast("string"), F.lit(',"text":'), F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", ""), F.lit(',"children":['), children, F.lit("]}"))
    depth = rows.agg(F.max("depth")).first()[0]
    below = None
    for level in range(depth if depth is not None else -1, -1, -1):
        here = rows.where(F.col("depth") == level)
        made = here.withColumn("_c", F.lit("")) if below is None else here.join(below, [key, "path"], "left").withColumn("_c", F.coalesce("_c", F.lit("")))
        made = made.select(key, "root", "number", "path", node(F.col("_c")).alias("tree"))
        if level:
            up = F.regexp_replace("path", ">[0-9]+$", "")
            below = stable(made.groupBy(key, up.alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "tree"))), lambda x: x["tree"]), ",").alias("_c")))
        else:
            return made.select(key, "root", "tree")
    return rows.select(key, "root", F.lit("").alias("tree")).limit(0)


def statistics(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts for each document."""
    return claims.groupBy(key).agg(
        F.count("*").alias("n_claims"), F.count_if("is_independent").alias("n_independent"), F.count_if(~F.col("is_independent")).alias("n_dependent"),
        F.max(F.size("depends_on")).alias("max_depends_on"), F.max("number").alias("max_number"), F.sum(F.length("text")).alias("n_chars"))


def figure_mentions(claims: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, figure, claims: the claims that refer to each figure."""
    return claims.select(key, "number", F.explode(tokens.figure_ids(F.col("text"))).alias("figure")).groupBy(key, "figure").agg(F.array_sort(F.collect_set("number")).alias("claims"))
