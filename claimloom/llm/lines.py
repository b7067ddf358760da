"""Line deduplication by a suffix array over line numbers, in DataFrame operations only.

Every line start is a suffix of its document's line sequence.  Prefix doubling ranks the suffixes by their first 1, 2,
4, ... lines: a level's rank is the order-preserving name of a pair of ranks of the level before, given by a range
partitioned sort of the distinct pairs.  Suffixes whose rank no other suffix has leave the table, so a level holds only
the members of intervals whose longest common prefix reaches the level's length.

A line goes if any run of lines around it, of whatever length, holds `min_chars` characters or more and equals a run that
starts earlier (in a document with a smaller id, or earlier in the same document).  Runs within a run that stands earlier
stand earlier too, so it is enough to judge two runs for each line: the shortest that starts there and holds enough
characters, and the shortest that ends there.  All lines of a longer repeated run lie in one of these.  A run of n lines
is named by n and the ranks of its first and its last 2**floor(log2 n) lines; equal names are one interval of the
suffix array.  Deletions that touch merge, which gives the maximal repeated runs.

A line that very many documents share is one key: first occurrences come from partial minima, and names return by joins
that take hot names apart.

Defined results: a null text has no lines and stays null; an empty text is one empty line; rows with equal id and text
count as one document and are each rewritten alike; rows that share an id but not the text don't delete each other's
lines; rows with a null id keep all lines; an empty table gives an empty result; ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import hidden, meet, release, rows_of, shown, small, written

KEY = ["_id", "_h"]


def named(pairs: DataFrame, *cols: str) -> DataFrame:
    """The distinct rows with `rank`, which increases with the columns' order."""
    return written(pairs.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def interval(rows: DataFrame, *cols: str) -> DataFrame:
    """The values that two rows or more have, ranked, and how many have them."""
    return named(rows.groupBy(*cols).agg(F.count("*").alias("many")).where("many > 1"), *cols)


def shortest_runs(lines: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _h, at, n): for each of lines(_id, _h, at, chars) the shortest runs of adjoining lines with `min_chars` characters that start or end there.

    With the characters before and up to each line as its start and stop, the run from a line ends at the first stop of
    start + min_chars or more; one that ends at a line begins at the last start of stop - min_chars or less.
    """
    by = Window.partitionBy(*KEY).orderBy("at")
    rows = lines.select(*KEY, "at", "chars", (F.col("at") - F.row_number().over(by)).alias("_run"))
    run = Window.partitionBy(*KEY, "_run")
    rows = rows.withColumn("stop", F.sum("chars").over(run.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("stop") - F.col("chars"))
    event = lambda place, asks: F.struct(place.alias("place"), F.lit(asks).alias("asks"))
    ask = lambda place, wanted: rows.select(*KEY, "_run", "at", F.inline(F.array(event(place, False), event(wanted, True))))
    met = F.when(~F.col("asks"), F.col("at"))
    upto = lambda *order: run.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = ask(F.col("stop"), F.col("start") + min_chars).withColumn("end", F.min(met).over(upto(F.desc("place"), "asks"))).where("asks and end is not null")
    back = ask(F.col("start"), F.col("stop") - min_chars).withColumn("first", F.max(met).over(upto("place", "asks"))).where("asks and first is not null")
    both = ahead.select(*KEY, "at", (F.col("end") - F.col("at") + 1).alias("n")).unionByName(back.select(*KEY, F.col("first").alias("at"), (F.col("at") - F.col("first") + 1).alias("n")))
    return both.where("n > 0").distinct()


def later_runs(runs: DataFrame, *name: str) -> DataFrame:
    """(_id, _h, start, end) of the runs(_id, _h, at, n, name) whose name starts earlier elsewhere."""
    runs = written(runs, "runs")
    first = written(runs.groupBy(*name).agg(F.min("_id").alias("least"), F.count("*").alias("many")).where("many > 1"), "first")
    twin = Window.partitionBy(*KEY, *name).orderBy("at")
    met = meet(runs.withColumn("_twin", F.row_number().over(twin)), first, list(name), "many")
    return met.where((F.col("_id") > F.col("least")) | (F.col("_twin") > 1)).select(*KEY, F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"))


def repeated_runs(rows: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _h, start, end) of the maximal runs of lines to delete, for rows(_id, _h, _text)."""
    lines = rows.select(*KEY, F.posexplode(F.split("_text", "\n", -1)).alias("at", "line"))
    lines = lines.select(*KEY, "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"), F.length("line").cast("long").alias("chars"))
    level = written(meet(lines, interval(lines, "a", "b"), ["a", "b"], "many").select(*KEY, "at", "chars", "rank"), "level")
    release(rows.sparkSession)
    runs = written(shortest_runs(level, max(min_chars, 1)), "shortest")
    size, most, found = 1, runs.agg(F.max("n")).first()[0] or 0, None
    while size <= most and rows_of(level):
        here = runs.where(F.col("n").between(size, 2 * size - 1))
        one, rank = KEY + ["at"], level.select(*KEY, "at", "rank")
        named_runs = here.join(rank.withColumnRenamed("rank", "a"), one)
        last = rank.select(*KEY, F.col("at").alias("_last"), F.col("rank").alias("b"))
        if size > 1:
            named_runs = named_runs.withColumn("_last", F.col("at") + F.col("n") - size).join(last, [*KEY, "_last"])
        else:
            named_runs = named_runs.withColumn("b", F.col("a"))
        gone = later_runs(named_runs.select(*KEY, "at", "n", "a", "b"), "n", "a", "b")
        found = gone if found is None else found.unionByName(gone)
        if 2 * size <= most:
            ahead = Window.partitionBy(*KEY).orderBy("at").rangeBetween(size, size)
            pairs = level.select(*KEY, "at", F.col("rank").alias("a"), F.max("rank").over(ahead).alias("b")).where("b is not null")
            level = written(meet(pairs, interval(pairs, "a", "b"), ["a", "b"], "many").select(*KEY, "at", "rank"), "level")
        size *= 2
    if found is None:
        return rows.sparkSession.createDataFrame([], "_id long, _h long, start int, end int")
    order = Window.partitionBy(*KEY).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("_reach") >= F.col("start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    islands = found.withColumn("_reach", reach).withColumn("_island", island).groupBy(*KEY, "_island")
    return islands.agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _kept(lines: Column, runs: Column) -> Column:
    """The lines outside the sorted runs."""
    between = F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: F.struct(
        F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["end"]).alias("start"),
        F.when(i == F.size(runs), F.size(lines)).otherwise(F.get(runs, i)["start"]).alias("end")))
    return F.flatten(F.transform(between, lambda s: F.slice(lines, s["start"] + 1, s["end"] - s["start"])))


def _deduped(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """The columns with the text rewritten, and n_lines, n_removed and n_runs."""
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), key.alias("_h"), F.col(text).alias("_text")).where("_id is not null and _text is not null")
    runs = repeated_runs(rows.dropDuplicates(KEY) if _repeats(rows) else rows, min_chars)
    runs = written(runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_runs")), "runs")
    release(docs.sparkSession)
    full = docs.withColumn("_id", F.col(id_col).cast("long")).withColumn("_h", key).join(small(runs), KEY, "left")
    lines, removed = F.split(text, "\n", -1), F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    changed = F.when(F.col("_runs").isNull(), F.col(text)).otherwise(F.array_join(_kept(lines, F.col("_runs")), "\n"))
    count = lambda x: F.coalesce(x.cast("long"), F.lit(0).cast("long"))
    facts = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"), count(removed).alias("n_removed"), count(F.when(F.col("_runs").isNotNull(), F.size("_runs"))).alias("n_runs")
    return full.select(*[changed.alias(c) if c == text else F.col(c) for c in docs.columns], *facts)


def line_dedup(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, the text without later copies of repeated runs, n_lines, n_removed and n_runs."""
    return _deduped(docs.select(id_col, text), id_col, text, min_chars)


def deduplicated(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with their columns, rewritten; those of which nothing but blanks is left after a deletion go."""
    rows, names = hidden(docs)
    kept = _deduped(rows, names[id_col], names[text], min_chars)
    return shown(kept.where((F.col("n_removed") == 0) | (F.length(F.trim(names[text])) > 0)), names)


def _repeats(rows: DataFrame) -> bool:
    """Whether any row repeats id and text; only then the texts are shuffled to keep one of each."""
    return not rows.groupBy(*KEY).count().where("count > 1").isEmpty()
