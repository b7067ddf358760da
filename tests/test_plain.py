"""Sequential operators against plain loops."""

import math
import random
import re
from collections import Counter

from claimloom.operators import body, claims, columns, compare, drawings, layout


def test_words_join_the_first_line_in_reach(spark):
    r = random.Random(3)
    rows = [(p, k, round(r.uniform(0, 60), 1), round(r.uniform(0, 60), 1)) for p in range(6) for k in range(r.randint(0, 60))]
    rows = [(p, k, a, max(a, b), f"w{k}") for p, k, a, b in rows]
    want = {}
    for p in range(6):
        keys = []
        for _, k, a, b, _ in sorted(x for x in rows if x[0] == p):
            y = (a + b) / 2
            hit = next((i for i, key in enumerate(keys) if abs(y - key) <= 3), None)
            if hit is None:
                keys.append(int(y))
                hit = len(keys) - 1
            want[p, k] = hit
    got = layout.group_lines(spark.createDataFrame(rows, "page int, word_no int, y0 double, y1 double, text string").repartition(3), ["page"]).collect()
    assert {(x["page"], x["word_no"]): x["line"] for x in got} == want
    assert all(x["text"] == f"w{x['word_no']}" for x in got)


def apart(boxes, gap):
    return all(a[0] - gap > b[2] or b[0] - gap > a[2] or a[1] - gap > b[3] or b[1] - gap > a[3] for i, a in enumerate(boxes) for b in boxes[i + 1 :])


def in_order(boxes, gap):
    """Each box takes what touches it, pass by pass; of several in one pass only the last counts."""
    changed = True
    while changed:
        changed, out, used = False, [], set()
        for i, box in enumerate(boxes):
            if i in used:
                continue
            used.add(i)
            while True:
                hits = [j for j, b in enumerate(boxes) if j not in used and not apart([box, b], gap)]
                if not hits:
                    break
                used |= set(hits)
                b = boxes[hits[-1]]
                box, changed = (min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3])), True
            out.append(box)
        boxes = out
    return boxes


def test_merged_boxes(spark):
    r = random.Random(4)
    rows = []
    for p in range(25):
        for k in range(r.randint(1, 14)):
            x, y = r.uniform(0, 200), r.uniform(0, 200)
            rows.append((p, k, x, y, x + r.uniform(1, 40), y + r.uniform(1, 40)))
    frame = spark.createDataFrame(rows, "page int, k int, x0 double, y0 double, x1 double, y1 double").repartition(3)
    given = {p: [b[2:] for b in rows if b[0] == p] for p in range(25)}
    for compat in (False, True):
        got = {p: [] for p in given}
        for b in drawings.merge_boxes(frame, 10.0, ref_compat=compat).collect():
            got[b["page"]].append(tuple(b[1:]))
        for p, boxes in given.items():
            if compat:
                assert sorted(got[p]) == sorted(in_order(boxes, 10.0))
            else:
                assert apart(got[p], 10.0)
                inside = lambda b, o: o[0] <= b[0] and o[1] <= b[1] and b[2] <= o[2] and b[3] <= o[3]
                assert all(sum(inside(b, o) for o in got[p]) == 1 for b in boxes)


def similarities(left, right):
    grams = lambda t: Counter((w := re.findall(r"\b\w\w+\b", t.lower())) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    docs = {("a", k): grams(t) for k, t in left} | {("b", k): grams(t) for k, t in right}
    df = Counter(g for d in docs.values() for g in d)
    weight = {d: {g: n * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in c.items()} for d, c in docs.items()}
    norm = {d: math.sqrt(sum(v * v for v in w.values())) for d, w in weight.items()}
    return {(a, b): sum(v * weight["b", b].get(g, 0) for g, v in weight["a", a].items()) / norm["a", a] / norm["b", b] for a, _ in left for b, _ in right if norm["a", a] and norm["b", b]}


def test_differences_of_two_versions(spark):
    r = random.Random(6)
    words = ["widget", "method", "claim", "part", "step", "valve", "small", "round", "with", "of"]
    left, right, want = [], [], {}
    for pair in range(12):
        a = [(k, " ".join(r.choice(words) for _ in range(r.randint(3, 12)))) for k in range(1, r.randint(2, 7))]
        b = [(k + r.randint(0, 1), t if r.random() < 0.5 else f"{t} {r.choice(words)}") for k, t in a if r.random() < 0.8]
        b = list(dict(b).items())
        left += [(pair, *x) for x in a]
        right += [(pair, *x) for x in b]
        used_a, used_b = set(), set()
        scored = sorted(((-round(s, 9), x, y) for (x, y), s in similarities(a, b).items() if s >= 0.3 - 1e-12))
        for s, x, y in scored:
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                want[pair, x, y] = "modified" if -s < 0.96 else "renumbered" if x != y else "unchanged"
        want |= {(pair, k, None): "removed" for k, _ in a if k not in used_a} | {(pair, None, k): "added" for k, _ in b if k not in used_b}
    kind = "pair long, id int, text string"
    x, y = spark.createDataFrame(left, kind), spark.createDataFrame(right, kind)
    got = compare.diff(x, y, compare.align(compare.similarities(x, y, threshold=0.3)))
    assert {(g["pair"], g["a"], g["b"]): g["status"] for g in got.collect()} == want


def test_ink_by_a_given_detector(spark):
    images = spark.createDataFrame([(1, bytearray(b"ab")), (2, bytearray(b""))], "page int, content binary")
    got = drawings.ink_boxes(images, lambda c: [(k, k, k + 5, k + 5) for k in range(len(c))]).collect()
    assert [(g["page"], g["k"], g["x1"]) for g in got] == [(1, 0, 5.0), (1, 1, 6.0)]
    detect = drawings.ink_detector()
    assert detect is None or callable(detect)


def test_regions_of_a_sheet(spark):
    words = spark.createDataFrame([(1, 0, 0, 0, 100.0, 300.0, 120.0, 310.0, "FIG."), (1, 0, 0, 1, 124.0, 300.0, 130.0, 310.0, "2a")], "page int, block_no int, line_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    tokens = spark.createDataFrame([(1, 0, "FIG.7", 90.0, 5.0, 5.0, 9.0, 9.0), (2, 0, "Fig", 80.0, 50.0, 400.0, 20.0, 10.0), (2, 1, "3", 60.0, 80.0, 402.0, 8.0, 10.0)], "page int, n int, t string, conf double, x double, y double, w double, h double")
    parts = spark.createDataFrame([(1, 1, 60.0, 120.0, 260.0, 280.0), (1, 2, 0.0, 5.0, 300.0, 20.0)], "page int, k int, x0 double, y0 double, x1 double, y1 double")
    got = {g["page"]: g for g in drawings.sheet_regions(words, tokens, parts, 500, 800).collect()}
    one, two = got[1], got[2]
    assert (one["figure"], one["source"], one["used_partition"], one["x0"], one["y0"], one["x1"], one["y1"]) == ("2A", "text", False, 48.0, 108.0, 272.0, 292.0)
    assert (two["figure"], two["source"], two["used_partition"], two["confidence"]) == ("3", "ocr", True, 0.4)


def test_columns_of_a_page(spark):
    line = lambda n, y, *spots: [(0, 100 * n + k, x, y, x + 6.0 * len(t), y + 8.0, t) for k, (x, t) in enumerate(spots)]
    rows = line(0, 20.0, (40.0, "left"), (70.0, "side"), (320.0, "right")) + line(1, 40.0, (40.0, "only"), (68.0, "left")) + line(2, 60.0, (320.0, "only"), (350.0, "right"))
    rows += line(3, 80.0, (40.0, "long"), (66.0, "line"), (92.0, "of"), (106.0, "text"), (132.0, "that"), (158.0, "goes"), (184.0, "on"), (210.0, "over"), (236.0, "the"), (262.0, "gutter"), (300.0, "30"), (318.0, "and"), (340.0, "on"), (356.0, "up"))
    rows += line(4, -2.0, (40.0, "margin")) + line(5, 100.0, (40.0, "short"), (74.0, "one")) + line(6, 120.0, (40.0, "short"), (74.0, "two"))
    frame = spark.createDataFrame(rows, "page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = [(g["col"], g["text"]) for g in columns.column_lines(frame, ["page"], 600.0, 800.0).orderBy("col", "pos").collect()]
    assert got[0] == ("L", "left side") and ("R", "right") in got and ("L", "only left") in got and ("R", "only right") in got
    assert not any("30" in t.split() or "margin" in t for _, t in got)
    kept = [g["text"] for g in columns.column_lines(frame, ["page"], 600.0, 800.0, numbers=True).collect()]
    assert any("30" in t.split() for t in kept)


def test_similarities_move_each_text_once(spark):
    left = spark.createDataFrame([(1, 1, "A round valve"), (1, 2, None), (2, 1, "of"), (None, 1, "A round valve")], "pair long, id int, text string")
    right = spark.createDataFrame([(1, 5, "A round valve and a part"), (1, 6, ""), (3, 1, "A round valve"), (None, 1, "A round valve")], "pair long, id int, text string")
    got = compare.similarities(left, right, threshold=0.1)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = similarities([(1, "A round valve"), (2, "")], [(5, "A round valve and a part"), (6, "")])
    assert [(r["pair"], r["a"], r["b"], round(r["similarity"], 9)) for r in got.collect()] == [(1, 1, 5, round(want[1, 5], 9))]


def claims_place(t, least, window, run):
    """Where claims begin, by Python's own patterns."""
    anchor = r"(?i)\b(?:what\s+is\s+claimed\s+is|the\s+invention\s+claimed\s+is|i\s*/\s*we\s+claim)\b\s*:?"
    if len(t) < least:
        return None
    at = math.floor(len(t) * 0.3)
    if m := re.search(anchor, t[at:]):
        return at + m.end()
    at = math.floor(len(t) * 0.4)
    if m := re.search(r"(?i)\blimited\s+only\s+by\s+the\s+claims\b", t[at:]):
        at += m.end()
    numbers = [at + m.start() for m in re.finditer(r"(?<!\d)\b\d{1,3}\s*\.\s*(?=[A-Z(])", t[at:])]
    ranges = [at + m.start() for m in re.finditer(r"(?i)\b\d{1,3}\s*[-–]\s*\d{1,3}\s*\.\s*\(?\s*cance(?:l|ll)ed\s*\)?", t[at:])]
    return next((s for s in sorted(numbers + ranges) if sum(s <= n < s + window for n in numbers) >= run), None)


def test_claims_begin_without_moving_texts(spark):
    r = random.Random(8)
    words = ["A part of it. ", "1. A part. ", "2. The part. ", "13 . (A) ", "3-5. (Canceled) ", "6 – 7. cancelled ", "LIMITED only by the claims ", "limited only ", "What is  Claimed is: ", "claims é ", "x1. A ", "9. a "]
    rows = [(k, "".join(r.choices(words, [9, 3, 3, 1, 1, 1, 0.3, 1, 0.2, 1, 1, 1])[0] for _ in range(r.randint(0, 40)))) for k in range(300)]
    got = body.claims_start(spark.createDataFrame(rows, "doc_id long, text string"), least=60, window=80)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {k: at for k, t in rows if (at := claims_place(t, 60, 80, 3)) is not None}
    assert 30 < len(want) < 300 and {g["doc_id"]: g["start"] for g in got.collect()} == want


def test_tails_move_no_texts(spark):
    got = claims.claims_tail(spark.createDataFrame([(1, "1. A part. 2. A part. 3. A part. " * 9)], "doc_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and got.first()["markers"] > 4
