"""Headers, field blocks and the tail's claims region."""

import random

from claimloom.operators import claims, layout

LINES = "page int, col string, pos int, y double, text string"


def regions(spark, ys, texts=None, height=800.0):
    rows = [(1, "L", i, float(y), (texts or {}).get(i, f"line {chr(97 + i % 26)}")) for i, y in enumerate(ys)]
    return [r["region"] for r in layout.split_header(spark.createDataFrame(rows, LINES), ["page"], height).orderBy("pos").collect()]


def test_split_header(spark):
    assert regions(spark, [40, 50, 150, 250, 260, 400], {0: "US 2009/0123456 A1", 1: "Dec. 8, 2009"}) == ["header"] * 2 + ["body"] * 4
    assert regions(spark, [60, 75, 90, 160], {0: "Sheet 1 of 3"}) == ["header"] * 2 + ["body"] * 2  # never below a tenth of the page
    assert regions(spark, [40, 50, 60, 75, 180, 190, 200]) == ["header"] * 3 + ["header"] + ["body"] * 3  # the first wide gap
    assert regions(spark, [300, 310]) == ["body"] * 2


def test_rescue(spark):
    rows = [(1, "L", 0, 30.0, "far", "header"), (1, "L", 1, 88.0, "two", "header"), (1, "L", 2, 94.0, " ", "header"), (1, "L", 3, 96.0, "one", "header"), (1, "L", 4, 100.0, "(54) TITLE", "body"),
            (1, "R", 5, 90.0, "up", "header"), (1, "R", 6, 92.0, "(10) US", "header"), (1, "R", 7, 98.0, "x", "header"), (2, "L", 8, 50.0, "no anchor", "header")]
    got = {r["pos"]: r["region"] for r in layout.rescue(spark.createDataFrame(rows, LINES + ", region string"), ["page"]).collect()}
    assert {k for k, v in got.items() if v == "body"} == {1, 3, 4, 7}


def plain_blocks(rows):
    """rows (pos, y, text) of one column, by following each label down and up."""
    labels, out, used = [i for i, r in enumerate(rows) if r[2].startswith("(")], [], set()
    end = float("-inf")
    for n, i in enumerate(labels):
        y = rows[i][1]
        after = rows[labels[n + 1]][1] if n + 1 < len(labels) else None
        reach = 90 if after is None else min(90, 0.4 * (after - y))
        stop = y + 900 if after is None else max(y + 1e-3, after - reach)
        above, below, j = [], [], i - 1
        while j >= 0 and j not in labels and rows[j][1] >= max(end, y - reach):
            above.insert(0, j)
            j -= 1
        j = i + 1
        while j < len(rows) and j not in labels and rows[j][1] < stop and rows[j][1] - rows[j - 1][1] <= 70:
            below.append(j)
            j += 1
        took = [i, *above, *below]
        used |= set(took)
        out.append("\n".join(rows[k][2] for k in took))
        end = stop
    run = []
    for k in range(len(rows) + 1):
        if k < len(rows) and k not in used:
            run.append(rows[k][2])
        elif run:
            out.append("\n".join(run))
            run = []
    return sorted(out)


def test_field_blocks(spark):
    rng, rows, want = random.Random(4), [], {}
    for page in range(60):
        y, column = 0.0, []
        for k in range(rng.randint(1, 25)):
            y += rng.choice((8, 12, 12, 20, 45, 80))
            column.append((k, y, f"({rng.choice((54, 57, 73))}) field {k}" if rng.random() < 0.25 else f"line {k}"))
        want[page] = plain_blocks(column)
        rows += [(page, k, y, y - 4, y + 4, t) for k, y, t in column]
    got = layout.field_blocks(spark.createDataFrame(rows, "page int, pos int, y double, y0 double, y1 double, text string"), ["page"]).collect()
    have = {page: sorted(r["text"] for r in got if r["page"] == page) for page in want}
    assert have == want
    assert all((r["kind"] == "inid") == (r["tag"] is not None) for r in got)


def test_claims_tail(spark):
    filler, wording = "Some words of the description go here again. " * 300, "A method of doing a thing well, comprising a step.\n"
    text = filler + "\n" + "".join(f"{n}. {wording}" for n in (1, 2, 3, 5, 6))
    rows = [(1, text), (2, filler), (3, None), (4, ""), (5, filler + "\n9. " + wording + "1. " + wording)]
    got = claims.claims_tail(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in got] == [1]
    r = got[0]
    assert text[r["start"] :].lstrip().startswith("1. A method") and r["end"] == len(text)
    assert (r["markers"], r["increases"], r["steps"], r["falls"], r["score"]) == (5, 4, 3, 0, 27)
