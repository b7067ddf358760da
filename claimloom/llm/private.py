"""Personal data: base spans by pattern, further spans by disclosure; DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.  Each valid base span names a protected
entity.  The words of a document outside its base spans are the context of all its entities.  Over the whole corpus, the
pointwise mutual information of an entity and a word, counted by documents (words over all rows) and divided by the entity's own information,
is the share of the entity that the word discloses.  Every occurrence of a word whose share reaches `generalise`, in
every document that holds the entity, is replaced by a class; where it reaches `remove`, it is deleted; both are added
as spans of kind `term`.  A word and an entity count only if at least `support` documents hold them together.

Positions come without user functions: splitting a text by a pattern gives the gaps and extracting all matches gives
the matches, in the same order; sums of their lengths are code-point offsets.

Defined results: a null text counts as empty; rows with equal id and text count as one document and give a result
row each; a row that shares an id with another text is a document of its own; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm import common
from claimloom.llm.common import bytes_of, hidden, meet, shown, small, written

#: The four kinds in their order, a character that a text must hold, and the pattern.  Quantifiers are
#: possessive where that changes no match, which keeps long runs linear and off the stack.
PATTERNS = (
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: The words that may disclose.
TERM = r"\p{L}{3,}"


def _valid(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    octets = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).try_cast("int"), F.lit(999)) <= 255))
    luhn = F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.when(kind == 0, F.lit(True)).when(kind == 1, octets).when(kind == 2, luhn).otherwise(F.length(digits).between(10, 15))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc key, kind (number in PATTERNS), start, end and value of each valid match in `docs(_id, _h, _text)`."""
    found = []
    for number, (_, needs, pattern) in enumerate(PATTERNS):
        holds = F.col("_text").contains(needs) if needs else F.col("_text").rlike("[0-9][ -]?[0-9]")
        gaps, hits = F.split("_text", pattern, -1), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
        found.append(F.when(holds, F.struct(F.lit(number).alias("kind"), gaps.alias("gaps"), hits.alias("hits"))))
    one = docs.select("_id", "_h", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).where(F.size("x.hits") > 0)
    one = one.select("_id", "_h", "x.kind", F.transform("x.gaps", F.length).alias("gaps"), "x.hits")
    rows = one.select("_id", "_h", "kind", F.posexplode(F.arrays_zip(F.slice("gaps", F.lit(1), F.size("hits")).alias("left"), F.col("hits").alias("hit"))).alias("i", "m"))
    upto = Window.partitionBy("_id", "_h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.left") + F.length("m.hit")).over(upto)
    rows = rows.select("_id", "_h", "kind", end.alias("end"), F.col("m.hit").alias("value"))
    rows = rows.where(_valid(F.col("kind"), F.col("value")))
    return rows.withColumn("start", F.col("end") - F.length("value"))


def same(a: DataFrame, b: DataFrame) -> Column:
    """Whether rows are of one document; ids may be null."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_h"])


def _masked(text: Column, spans: Column) -> Column:
    """The text with blanks for the sorted spans, as long as before."""
    reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda s: s["end"])), F.lit(0))
    piece = F.transform(spans, lambda s, i: F.concat(
        F.substring(text, (reach(i) + 1).cast("int"), F.greatest(F.lit(0), s["start"] - reach(i)).cast("int")),
        F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(reach(i), s["start"])).cast("int"))))
    return F.concat(F.array_join(piece, ""), F.substring(text, (reach(F.size(spans)) + 1).cast("int"), F.length(text)))


def masked(docs: DataFrame, masks: DataFrame, how: str) -> DataFrame:
    """docs(_id, _h, _text) with blanks for their base spans, masks(_id, _h, spans)."""
    m = small(masks).alias("m")
    text = F.when(F.col("m.spans").isNull(), docs["_text"]).otherwise(_masked(docs["_text"], F.col("m.spans")))
    on = docs["_id"].eqNullSafe(F.col("m._id")) & (docs["_h"] == F.col("m._h"))
    return docs.join(m, on, how).select(docs["_id"], docs["_h"], text.alias("_text"))


def _terms(text: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)), F.lower))


def disclosing(docs: DataFrame, masks: DataFrame, named: DataFrame, support: int, generalise: float) -> DataFrame:
    """_id, _h, term, share: the words that disclose an entity of named(_id, _h, entity), in each document that holds both."""
    total = float(max(docs.count(), 1))
    entities = written(named.groupBy("entity").agg(F.count("*").alias("of_entity")).where(F.col("of_entity") >= support), "entities")
    holders = written(named.join(small(entities), "entity"), "holders")
    wanted_docs = written(holders.select("_id", "_h").distinct().join(masks.withColumnsRenamed({"_id": "_i", "_h": "_g"}), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g"))).select("_id", "_h", "spans"), "held")
    terms = masked(docs, wanted_docs, "inner").dropDuplicates(["_id", "_h"]).select("_id", "_h", F.explode(_terms("_text")).alias("term"))
    terms = written(terms, "terms")
    wanted = written(terms.groupBy("term").count().where(F.col("count") >= support).select("term"), "wanted")
    held = masked(docs, masks, "left").select(F.explode(_terms("_text")).alias("term"))
    if bytes_of(wanted) <= common.BROADCAST_BYTES:  # else terms are counted before they are joined, so that no hot one is shuffled
        held = held.join(F.broadcast(wanted), "term", "left_semi")
    in_docs = written(held.groupBy("term").agg(F.count("*").alias("of_term")).join(small(wanted), "term"), "counted")
    # A word that even in all of an entity's documents would tell too little needn't be paired with it.
    t, h = meet(terms, in_docs, ["term"], "of_term"), holders
    able = F.col("of_term") <= 1.000001 * total * F.pow(F.col("of_entity") / total, F.lit(float(generalise)))
    pairs = written(t.join(h, same(t, h) & able).select(t["_id"], t["_h"], "entity", "term", "of_entity", "of_term"), "joint")
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("of_entity").alias("of_entity"), F.first("of_term").alias("of_term")).where(F.col("both") >= support)
    information = F.log2(F.lit(total) / F.col("of_entity"))
    mutual = F.log2(F.lit(total) * F.col("both") / (F.col("of_entity") * F.col("of_term")))
    share = F.when(information > 0, mutual / information).otherwise(0.0)
    told = written(joint.select("entity", "term", "both", share.alias("share")).where(F.col("share") >= generalise), "told")
    return meet(pairs.select("_id", "_h", "entity", "term"), told, ["entity", "term"], "both").groupBy("_id", "_h", "term").agg(F.max("share").alias("share"))


def occurrences(docs: DataFrame, masks: DataFrame, told: DataFrame) -> DataFrame:
    """told(_id, _h, term, share) with start and end of every occurrence of the term in its document."""
    keys = told.select(F.col("_id").alias("_i"), F.col("_h").alias("_g")).distinct()
    some = written(masks.join(keys, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g")), "left_semi"), "marked")
    texts = masked(docs, some, "inner").dropDuplicates(["_id", "_h"])
    words, gaps = F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)), F.transform(F.split("_text", TERM, -1), F.length)
    rows = texts.select("_id", "_h", F.posexplode(F.arrays_zip(words.alias("w"), F.slice(gaps, F.lit(1), F.size(words)).alias("g"))).alias("i", "m"))
    upto = Window.partitionBy("_id", "_h").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("_id", "_h", F.lower("m.w").alias("term"), F.length("m.w").alias("n"), F.sum(F.col("m.g") + F.length("m.w")).over(upto).alias("end"))
    return rows.join(told, same(rows, told) & (rows["term"] == told["term"])).select(rows["_id"], rows["_h"], (F.col("end") - F.col("n")).alias("start"), "end", "share")


def _grouped(docs: DataFrame, support: int = 2, generalise: float = 0.5, remove: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, _h, n, spans: the spans of the n rows that share id and text."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    base = written(base_spans(rows), "base")
    masks = written(base.groupBy("_id", "_h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")), "masks")
    entity = F.concat_ws(":", F.col("kind"), F.when(F.col("kind") == 0, F.lower("value")).otherwise(F.regexp_replace("value", "[ ().-]", "")))
    named = written(base.select("_id", "_h", entity.alias("entity")).distinct(), "named")
    told = written(disclosing(rows, masks, named, support, generalise), "disclosing")
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    added = occurrences(rows, masks, told).withColumn("action", action)
    span = lambda kind, action: F.struct(F.col("start").cast("long").alias("start"), kind.cast("int").alias("kind"), F.col("end").cast("long").alias("end"), action.alias("action")).alias("span")
    key = ["_id", "_h"]
    nothing = F.lit(None).cast("struct<start:bigint,kind:int,end:bigint,action:string>").alias("span")
    every = rows.select(*key, nothing).unionByName(base.select(*key, span(F.col("kind"), F.lit("remove")))).unionByName(added.select(*key, span(F.lit(len(PATTERNS)), F.col("action"))))
    return every.groupBy(*key).agg(F.array_sort(F.collect_set("span")).alias("spans"), F.count_if(F.col("span").isNull()).alias("n")).select(F.col("_id").alias(id_col), "_h", "n", "spans")


def private_spans(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """A row for each document: the id, and spans array<struct<start, kind, end, action>> in order of start and kind."""
    return _grouped(docs, id_col=id_col, **options).select(id_col, "_h", "spans", F.explode(F.sequence(F.lit(1), "n")).alias("_n")).drop("_n")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """The documents with base spans replaced by their kind's name, removed terms by nothing, other terms by their class.

    A term's class is its form: <ABBREVIATION> in capitals, <NAME> with a capital at its start, else <WORD>.
    """
    kinds = F.array(*[F.lit(f"<{k.upper()}>") for k, _, _ in PATTERNS], F.lit(""))
    rows, names = hidden(docs)
    found = _grouped(docs, **options).select(F.col("doc_id").alias("_id"), F.col("_h").alias("_g"), "spans").where(F.size("spans") > 0)
    text = F.col(names["text"])
    same = F.col(names["doc_id"]).eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_g"))
    form = lambda word: F.when(word.rlike(r"^\p{Lu}+$"), "<ABBREVIATION>").when(word.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
    reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice("spans", F.lit(1), i), lambda s: s["end"])), F.lit(0))
    piece = F.transform("spans", lambda s, i: F.concat(
        F.substring(text, (reach(i) + 1).cast("int"), F.greatest(F.lit(0), s["start"] - reach(i)).cast("int")),
        F.when(s["start"] < reach(i), "").when(s["action"] == "generalise", form(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))).otherwise(F.get(kinds, s["kind"]))))
    tail = F.substring(text, (reach(F.size("spans")) + 1).cast("int"), F.length(text))
    clean = F.when(F.col("spans").isNotNull(), F.concat(F.array_join(piece, ""), tail)).otherwise(text)
    return shown(rows.join(found, same, "left"), names, text=clean)
