"""Every operator against a plain version, on rows with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import math
import random
import re
import textwrap
from collections import Counter

import brute
import numpy as np
import pytest
import xxhash

from claimloom.llm import common, components, decontaminate, licences, lines, pieces, private, quality, queries, shards, simhash, substrings, topk

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(40)] + ["Ünïcode", "日本", "😀", "Mixed", "a-b"]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE, LINE = prose(70), "A line that very many of the documents share, word for word."
ITEMS = [(1, prose(30)), (2, "only four words here"), (3, None), (4, ""), (None, prose(20)), (1, prose(14))]


def texts():
    out = [None, "", "   \n\t ", "one", "one two", "a\nb\n\nb\na", prose(3000), "x" * 5000, "1." * 3000, "9 " * 4000, "\n".join(["", LINE, ""] * 3)]
    out += [prose(rng.randint(1, 120)) for _ in range(40)]
    out += [f"{prose(20)}\n{LINE}\n{prose(10)} {PASSAGE} {prose(5)}" for _ in range(12)]
    out += [f"{prose(8)} {ITEMS[0][1]} {prose(k)} only FOUR words, here" for k in (0, 5, 900)]
    out += [f"Mail ann{i % 3}@mail.example.org or +1 (555) 010-99{i % 3}0, card 4539 1488 0343 6467, host 10.0.0.{i % 3}, 300.1.1.1. Zebrafish {i}" for i in range(9)]
    return out + out[20:30]


ROWS = [(i, t) for i, t in enumerate(texts())]
ROWS += [ROWS[25], ROWS[25], (None, "no id"), (None, None)]
CLASH = "doc_id long, text string, _id string, _h int, _text string, spans string, lines string, n_words string, _runs string, _col0 string, copy string, signature string, left string, expected_grade string"
UNIQUE = {d: t for d, t in ROWS if d is not None}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, *["x"], 1, *["x"] * 10) for d, t in ROWS], CLASH).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def one_each(rows):
    return {r["doc_id"]: r for r in rows if r["doc_id"] is not None}


@pytest.fixture(params=["broadcast", "shuffle"])
def both_ways(request, monkeypatch):
    """The joins with and without broadcast sides."""
    if request.param == "shuffle":
        for module in (common, components, lines, private, shards, simhash, substrings):
            monkeypatch.setattr(module, "small", lambda df, bound=0: df)
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)


def test_simhash(docs, empty, both_ways):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    want = brute.groups([(d, brute.fingerprint(t)) for d, t in ROWS])
    assert {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in got if r["doc_id"] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("leaf,front", [(4, 8), (1 << 17, 1 << 16)])
def test_trie_finds_all_links(spark, monkeypatch, leaf, front):
    monkeypatch.setattr(simhash, "FRONT", front)
    monkeypatch.setattr(simhash, "DIRECT", 2 if leaf == 4 else 64)
    r = random.Random(leaf)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(6)} | {0, (1 << 64) - 1, 1, 1 << 63})
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    links = components.components(simhash.print_links(spark.createDataFrame(rows, "_print long, _rep long"), leaf=leaf, most_rows=40 if leaf == 4 else 1 << 20)).collect()
    want = brute.groups([(i, p) for i, p in enumerate(prints)])
    root = {r["node"]: r["root"] for r in links}
    assert {i: root.get(i, i) for i in range(len(prints))} == {i: w for (i, _), w in want.items()}


def test_components_of_a_long_chain(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(299)] + [(5000, 5001), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 300)}, 5001: 5000}


def test_near_copies(spark, empty):
    r = random.Random(9)
    base = [f"t{r.randrange(10**6)}" for _ in range(400)]
    near = [[w if k % 97 else f"other{j}" for k, w in enumerate(base)] for j in range(1, 4)]
    other = [[f"t{r.randrange(10**6)}" for _ in range(400)] for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate([base, *near, *other])] + [(100, " ".join(base)), (101, None), (102, ""), (None, "x"), (100, " ".join(base)), (200, "b of its own"), (200, "a of its own"), (201, "b of its own")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as component_id", "'y' as signature")
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    ids = [x["doc_id"] for x in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, *range(4, 24), 101, 200, 201] and ids.count(None) == 1
    assert {x["text"] for x in kept.where("doc_id = 200").collect()} == {"a of its own"}
    assert simhash.one_of_each(empty).collect() == []


def test_private(docs, empty, both_ways):
    got = private.private_spans(docs)
    rows = got.collect()
    names = len(private.PATTERNS)
    for r in rows:
        if r["doc_id"] is not None:
            base = [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < names]
            assert base == sorted(brute.base_spans(UNIQUE[r["doc_id"]]))
    assert any(s["kind"] == names for r in rows for s in r["spans"])  # words that always stand by one entity
    assert private.private_spans(empty).collect() == []
    clean = one_each(private.sanitise(docs).collect())
    assert private.sanitise(docs).columns == docs.columns
    mail = next(d for d, t in ROWS if t and t.startswith("Mail ann0"))
    assert "ann0@" not in clean[mail]["text"] and "<EMAIL>" in clean[mail]["text"] and "300.1.1.1" in clean[mail]["text"]
    assert clean[3]["text"] == "one" and clean[0]["text"] is None


def test_disclosed_terms_follow_the_shares(spark):
    """A word that stands by one entity alone tells it; a word that stands everywhere tells nothing."""
    rows = [(i, f"{prose(3)} the zebrafish keeper writes from keeper{i % 2}@zoo.example.org to all") for i in range(4)] + [(10 + i, "the others write to all and from none") for i in range(40)]
    found = private.private_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = {rows[r["doc_id"]][1][s["start"] : s["end"]]: s["action"] for r in found for s in r["spans"] if s["kind"] == len(private.PATTERNS) and r["doc_id"] < 4}
    assert told.get("zebrafish") and "the" not in told and "all" not in told


def test_substrings(docs, empty, both_ways):
    want = brute.substring_dedup(UNIQUE)
    got = substrings.substring_dedup(docs).collect()
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], brute.sha(bytes(r["kept"]))) == want[r["doc_id"]]
    assert len(got) == len(ROWS) and substrings.substring_dedup(empty).collect() == []


def test_cover_aligns_every_shift():
    for shift in range(substrings.PERIOD):
        assert any((c + shift) % substrings.PERIOD in substrings.COVER for c in substrings.COVER)


def test_decontaminate(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    real = [(i, t) for i, t in ITEMS if i is not None]
    for block in (32 << 20, 60):  # one pass, and a pass for each block of items
        got = decontaminate.benchmark_spans(docs, items, block_bytes=block).collect()
        assert len(got) == len(ROWS)
        for r in got:
            if r["doc_id"] is not None:
                n, hit, found, names, dirty = brute.benchmark_hits(UNIQUE[r["doc_id"]], real)
                assert (r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"]))) == (n, hit, found, names)
                assert sum(s["end"] - s["start"] for s in r["spans"]) == hit
    assert decontaminate.benchmark_spans(empty, items).collect() == []
    assert decontaminate.benchmark_spans(docs, items.limit(0)).where("n_hit > 0").count() == 0
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    rows = one_each(kept.collect())
    assert set(rows) == {d for d, t in UNIQUE.items() if not brute.benchmark_hits(t, real)[4]}
    assert all(brute.benchmark_hits(r["text"], real)[2] == 0 or r["text"] == UNIQUE[d] for d, r in rows.items())


def test_phrases_stay_small():
    import pickle

    r = random.Random(1)
    items = [(str(k), " ".join(f"w{r.randrange(20000)}" for _ in range(150)).encode()) for k in range(1200)]
    size = sum(len(t) for _, t in items)
    phrases = decontaminate.Phrases(items, 13)
    assert len(phrases.rows) == 1200 * 138 and len(pickle.dumps(phrases)) < 12 * size


def test_fm_index_against_scanning():
    r = np.random.default_rng(3)
    text = np.append(r.integers(0, 4, 400), 0)
    index = decontaminate.FmIndex(text)
    phrases = [p for n in (1, 2, 3, 5) for p in itertools.islice(itertools.product((1, 2, 3), repeat=n), 60)]
    rows = np.zeros((len(phrases), 5), np.int64)
    for k, p in enumerate(phrases):
        rows[k, 5 - len(p) :] = p
    low, high = index.search(rows, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high, strict=True):
        at = sorted(index.locate(np.arange(a, b)).tolist()) if a < b else []
        assert at == [i for i in range(len(text) - len(p) + 1) if tuple(text[i : i + len(p)]) == p]


def plain_lines(rows, min_chars=40):
    """All runs of all lengths; rows {id: text}."""
    seqs = {d: t.split("\n") for d, t in rows.items() if t is not None}
    gone = {d: set() for d in seqs}
    for size in range(1, max(map(len, seqs.values()), default=0) + 1):
        first, some = {}, False
        for d in sorted(seqs):
            for i in range(len(seqs[d]) - size + 1):
                run = tuple(seqs[d][i : i + size])
                if run in first:
                    some = True
                    if sum(map(len, run)) >= min_chars:
                        gone[d] |= set(range(i, i + size))
                first.setdefault(run, (d, i))
        if not some:
            break
    return {d: "\n".join(x for i, x in enumerate(s) if i not in gone[d]) for d, s in seqs.items()}


def test_lines_of_any_length(spark, both_ways, monkeypatch):
    """Runs of few and many short lines, empty ones among them, in documents and across them."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    r = random.Random(8)
    parts = [["x" * 15] * 3, ["y" * 19, "z" * 19, "w" * 19], ["v" * 9] * 7, ["u" * 2] * 31, ["a" * 39, "", "", "", "b" * 39], ["p" * 20, "q" * 20, "r" * 5], ["", "", ""], ["c" * 60], ["d" * 39], [f"{k}" for k in range(50)]]
    rows = {}
    for d in range(40):
        some = [f"own {d} {k} {r.random()}" if r.random() < 0.3 else r.choice(parts) for k in range(r.randint(1, 9))]
        rows[d] = "\n".join(x for s in some for x in ([s] if isinstance(s, str) else s[r.randint(0, 1) : len(s) - r.randint(0, 1)]))
    want = plain_lines(rows)
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    assert {x["doc_id"]: x["text"] for x in lines.line_dedup(frame).collect()} == want
    assert sum(w != rows[d] for d, w in want.items()) > 25


def test_lines(docs, empty, both_ways):
    want = plain_lines(UNIQUE)
    got = lines.line_dedup(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] is not None:
            assert r["text"] == (want[r["doc_id"]] if UNIQUE[r["doc_id"]] is not None else None)
    assert lines.line_dedup(empty).collect() == []
    kept = lines.deduplicated(docs)
    assert kept.columns == docs.columns and all(r["_id"] == "x" for r in kept.collect())


def test_line_ranks_keep_the_order(spark):
    frame = spark.createDataFrame([(a, b) for a in range(9) for b in range(9)], "a long, b long").repartition(5)
    rows = lines.named(frame, "a", "b").orderBy("rank").collect()
    assert [(r["a"], r["b"]) for r in rows] == sorted((r["a"], r["b"]) for r in rows)


@pytest.fixture(scope="module")
def model():
    return queries.model_path()


def test_pieces_equal_the_library(model):
    import sentencepiece

    own, given = pieces.Pieces(pieces.model_pieces(model)), sentencepiece.SentencePieceProcessor(model_file=model)
    some = [t for t in UNIQUE.values() if t is not None] + ["  ", " a", "tab\tx\r\ny", "x" * 300 + " " + "ab" * 200, "    " * 300 + "z", "\u0000a", "▁ x", "étudiant " * 9, "a" * 3000]
    for t, x in zip(some, own.encode(some), strict=True):
        ids = np.frombuffer(x, np.int32).tolist()
        assert ids == given.encode(t)
        assert own.decode(ids) == t.replace("▁", " ")
    assert own.encode([None, ""]) == [None, b""]


def test_long_units_equal_the_library(model, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "INDEXED", 64)
    r = random.Random(2)
    own, given = pieces.Pieces(pieces.model_pieces(model)), sentencepiece.SentencePieceProcessor(model_file=model)
    some = ["x" * 700, "".join(r.choice("ABCDEFGHabcdefgh0123+/") for _ in range(900)), "ab" * 300 + " then " + "=" * 200, "日本語" * 90, "the" * 120, "an unbroken" + "ing" * 100, "1234567890" * 40]
    for t, x in zip(some, own.encode(some), strict=True):
        assert np.frombuffer(x, np.int32).tolist() == given.encode(t), t[:30]


def test_encoding_takes_little_memory(model):
    import tracemalloc

    r = random.Random(3)
    own = pieces.Pieces(pieces.model_pieces(model))
    some = [" ".join(f"{r.choice(WORDS)}{r.randrange(60)}" for _ in range(300)) for _ in range(500)]
    some += [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(300)) for _ in range(100)]
    tracemalloc.start()
    try:
        own.encode(some)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40 << 20, most >> 20


def test_digests_equal_the_library(docs, model):
    import sentencepiece

    given = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in pieces.encode_digest(docs, model).collect():
        if r["doc_id"] is not None and UNIQUE[r["doc_id"]] is not None:
            ids = given.encode(UNIQUE[r["doc_id"]])
            assert (r["n_ids"], r["ids_sha256"]) == (len(ids), brute.sha(np.array(ids, "<i4").tobytes()))


def test_pieces_frames(docs, empty, model):
    encoded = pieces.encode(docs, model)
    back = pieces.decode(encoded, model).collect()
    assert {r["doc_id"]: r["text"] for r in back if r["doc_id"] is not None} == UNIQUE
    assert pieces.encode_digest(docs, model).where("not restored").count() == 0
    assert pieces.encode(empty, model).collect() == []


def test_shards(docs, empty, both_ways):
    got = shards.shuffle_into_shards(docs, 7).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 16, brute.crc(t)) for d, t in ROWS)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 7
    assert shards.shuffle_into_shards(empty, 7).collect() == []


def test_write_shards(docs, tmp_path):
    shards.write_shards(docs, str(tmp_path / "s"), 3)
    back = docs.sparkSession.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(ROWS) and back.select("shard").distinct().count() == 3


def test_matrix_sums_and_law():
    assert all(sum(r) == n for r, n in zip(shards.communication_matrix([5, 0, 9, 6], [7, 7, 6], 3), [5, 0, 9, 6], strict=True))
    cells = np.array([shards.communication_matrix([40, 60], [50, 50], s)[0][0] for s in range(2000)])
    assert abs(cells.mean() - 20) < 0.3 and abs(cells.var() - 40 * 0.25 * 60 / 99) < 0.7
    assert 0 <= shards.hypergeometric(random.Random(1), 3 * 10**9, 10**10, 10**6) <= 10**6


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=8).round(2).tolist()) for i in range(450)] + [(500, [1.0] * 8), (501, [1.0] * 8), (600, None), (700, []), (800, [1.0, None] + [0.0] * 6), (900, [float("nan")] + [0.0] * 7), (1000, [float("inf")] * 8), (1100, [3.0]), (1101, [2.0]), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = sorted(map(tuple, topk.top_k(frame, block=2).collect()))
    assert got == sorted(brute.top_k([(r["vec_id"], r["embedding"]) for r in frame.collect() if r["vec_id"] is not None]))
    assert topk.top_k(frame.limit(0)).collect() == []


def test_top_k_of_repeated_ids(spark):
    """A query for each distinct vector; candidates with its id take no part, however often others repeat."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), *[(1, [3.0, 1.0])] * 3, (2, [1.0, 4.0])]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()))
    one, other = [(0, 1, 1, 3 << 20), (0, 2, 1, 3 << 20)], [(0, 1, 2, 4 << 20), (0, 2, 1, 1 << 20)]
    assert got == sorted(one + other)


def test_approximations_bound_all_products():
    r = np.random.default_rng(6)
    vectors = (r.normal(size=(500, 16)) * 1000).astype(np.int64)
    cells, low, width = topk.approximated(vectors)
    file = {"size": 16, "ids": np.arange(500).tobytes(), "cells": cells.tobytes(), "low": low.tobytes(), "width": width.tobytes()}
    middle, half, _ = topk.bounds(vectors[:40], np.full(40, -1), file)
    exact = vectors[:40] @ vectors.T
    assert (np.abs(exact - middle) <= half[:, None]).all()


def test_top_k_of_large_numbers(spark):
    rows = [(i, [float((-1) ** i * 2**20 + i), 2.0**20]) for i in range(150)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == sorted(brute.top_k(rows))


def test_quality(spark, docs, empty):
    r = random.Random(4)
    rows, ratings = [], []
    for i in range(900):
        kind = i % 3
        body = prose(60) if kind != 1 else " | ".join(r.choice(WORDS) + "$$$" for _ in range(60))
        rows.append((i, body + (" horrid" if kind == 0 else "")))
        ratings.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    ratings += [(0, None, 1), (None, 1, 1), (5, 1, None)]
    frame, rated = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ratings, "doc_id long, quality int, toxic int")
    model = quality.train(frame, rated.where("doc_id < 600 or doc_id is null"))
    scored = quality.score(frame.where("doc_id >= 600"), model).collect()
    right = [round(x["expected_grade"]) == x["doc_id"] % 3 for x in scored if x["doc_id"] % 3 == 2] + [x["p_at_least_2"] < 0.5 for x in scored if x["doc_id"] % 3 != 2]
    assert np.mean(right) > 0.95
    assert all(x["p_at_least_1"] >= x["p_at_least_2"] for x in scored)
    kept = quality.select(docs, model)
    assert kept.columns == docs.columns
    assert quality.select(empty, model).collect() == []
    assert quality.score(docs, quality.train(docs, rated.limit(0))).count() == len(ROWS)


def plain_features(text):
    """{slot: value} of one text, from the definition."""
    words = (text or "").encode().split()
    shape = lambda w: "".join(k for k, _ in itertools.groupby("a" if chr(b).islower() or b >= 128 else "A" if chr(b).isupper() else "0" if chr(b).isdigit() else chr(b) for b in w))
    slot = lambda f: xxhash.xxh64_intdigest(f) % quality.WIDTH
    size, solid = max(1, len((text or "").encode())), [b for b in (text or "").encode() if b not in b" \n\t"]
    capitals = sum(65 <= b <= 90 for b in solid) / size
    marks = sum(b < 128 and not chr(b).isalnum() for b in solid) / size
    bins = {"repeat": 1 - len(set(words)) / max(1, len(words)), "capital": capitals, "mark": marks}
    loud = {slot(b"s" + shape(w).encode("latin1")) for w in words} | {slot(f"b:{k}:{int(v * 10)}".encode()) for k, v in bins.items()} | {slot(f"length:{max(1, len(words)).bit_length()}".encode())}
    soft = {slot(b"w" + w.strip(b".,;:!?\"'()[]{}").lower()) for w in words} - loud
    return {**dict.fromkeys(soft, 1.0), **dict.fromkeys(loud, quality.LOUD / math.sqrt(len(loud)))}


def plain_fit(rows, grades, rounds=300, rate=0.05, ridge=2e-4, lasso=0.1):
    """(weights, thresholds) by the same steps, one document and weight at a time."""
    seen = Counter(s for r in rows for s in r)
    rows = [{s: v for s, v in r.items() if seen[s] >= max(3, len(rows) // 800)} for r in rows]
    n, sigmoid = len(rows), lambda x: 1 / (1 + math.exp(-max(-40, min(40, x))))
    odds = [math.log((sum(g < k for g in grades) / n + 1e-3) / (sum(g >= k for g in grades) / n + 1e-3)) for k in (1, 2)]
    state = {s: 0.0 for r in rows for s in r} | {"low": odds[0], "gap": math.log(math.exp(max(odds[1] - odds[0], 0.1)) - 1)}
    first, second = dict.fromkeys(state, 0.0), dict.fromkeys(state, 0.0)
    for step in range(1, rounds + 1):
        low, gap = state["low"], math.log1p(math.exp(state["gap"]))
        grad = {s: 0.0 if s in ("low", "gap") else ridge * w for s, w in state.items()}
        for r, g in zip(rows, grades, strict=True):
            score = sum(v * state[s] for s, v in r.items())
            upto = [0.0, sigmoid(low - score), sigmoid(low + gap - score), 1.0]
            slope = [u * (1 - u) for u in upto]
            p = max(upto[g + 1] - upto[g], 1e-12)
            for s, v in r.items():
                grad[s] += v * (slope[g + 1] - slope[g]) / p / n
            by = [(-slope[1] if g == 0 else slope[1] if g == 1 else 0) / p / n, (-slope[2] if g == 1 else slope[2] if g == 2 else 0) / p / n]
            grad["low"] += sum(by)
            grad["gap"] += by[1] * sigmoid(state["gap"])
        for s, d in grad.items():
            first[s], second[s] = 0.9 * first[s] + 0.1 * d, 0.999 * second[s] + 0.001 * d * d
            state[s] -= rate * (first[s] / (1 - 0.9**step)) / (math.sqrt(second[s] / (1 - 0.999**step)) + 1e-8)
            if s not in ("low", "gap"):
                state[s] = math.copysign(max(abs(state[s]) - rate * lasso, 0), state[s])
    return state, (state["low"], state["low"] + math.log1p(math.exp(state["gap"])))


def test_quality_equals_a_plain_refit(spark):
    r = random.Random(7)
    kinds = [lambda: " ".join(r.choice(WORDS[:12]) for _ in range(12)) + " horrid!", lambda: " | ".join(r.choice(WORDS[:12]) + "$$" for _ in range(12)), lambda: " ".join(r.choice(WORDS).capitalize() for _ in range(14)) + "."]
    rows = [(k, kinds[k % 3]()) for k in range(90)] + [(90, ""), (91, None), (92, "averyverylongword" * 3 + "-A1-A1-A1-A1-A1")]
    ratings = [(k, 0 if k % 3 == 1 else 1, 1 if k % 3 == 0 else 0) for k in range(93)]
    frame, rated = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ratings, "doc_id long, quality int, toxic int")
    features = [plain_features(t) for _, t in rows]
    weights, thresholds = plain_fit(features, [k % 3 for k, _ in rows])
    got = {x["doc_id"]: x for x in quality.score(frame, quality.train(frame, rated)).collect()}
    for (k, _), f in zip(rows, features, strict=True):
        score = sum(v * weights.get(s, 0.0) for s, v in f.items())
        tails = [1 / (1 + math.exp(t - score)) for t in thresholds]
        assert np.allclose([got[k]["p_at_least_1"], got[k]["p_at_least_2"], got[k]["expected_grade"]], [*tails, sum(tails)], atol=2e-3)


def test_operators_recover_nothing_from_local_folders(spark, docs):
    """Tables that cut the lineage stand in the shared folder."""
    files = common.written(docs.select("doc_id"), "probe").inputFiles()
    assert all(common.shared_dir(spark) in f for f in files)


def test_digest_of_kept_words_matches_sha(docs):
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")


LICENSED = [
    ("Licensed under the Apache License, Version 2.0.", [("Apache-2.0", 1)]),
    ("Prose. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nMore prose.", [("Apache-2.0", 1)]),
    ("Released under the MIT License. Released under the MIT License.", [("MIT", 2)]),
    ("This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", [("CC-BY-NC-4.0", 1), ("GPL-3.0", 1)]),
    ("Copyright (c) 2020 A. All rights reserved.", [("Proprietary", 1)]),
    ("SPDX-License-Identifier: BSD-3-Clause", [("BSD-3-Clause", 1)]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted:\nRedistributions of source code must retain the above copyright notice.\nRedistributions in binary form must reproduce the above copyright notice.", [("BSD-2-Clause", 1)]),
    ("A note on licences in general.", []), (None, []), ("", []), ("license " * 20000, []),
]


def test_licences(spark, empty):
    rows = [(i, t, "x") for i, (t, _) in enumerate(LICENSED)] + [(0, LICENSED[0][0], "y")]
    got = licences.licences(spark.createDataFrame(rows, "doc_id long, text string, licences string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(x) for x in r["licences"]] == LICENSED[r["doc_id"]][1], LICENSED[r["doc_id"]][0]
    assert licences.licences(empty).collect() == []


def test_known_sentences_hold_cue_words():
    for _, sentences in licences.known():
        for name, one in sentences:
            plain = re.sub(r"\(\?:|[()?*|\\]|\.\*", " ", one)
            assert re.search(licences.CUE.replace("[sc]", "."), re.sub(r"\[sc\]", "s", plain)), name


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."""
APACHE = """Copyright 2020 A. Body
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY."""
PUBLISHED = [(MIT, "MIT"), (BSD2 + BSD_END, "BSD-2-Clause"), (BSD2 + BSD3 + BSD_END, "BSD-3-Clause"), (ISC, "ISC"), (APACHE, "Apache-2.0"), (GPL, "GPL-3.0"), (GPL.replace(":", ";").replace("version 3", "version 2"), "GPL-2.0")]


def forms(text):
    """The text as it is, wrapped, and as comments."""
    fill = lambda width: "\n".join(textwrap.fill(line, width, initial_indent=line[: len(line) - len(line.lstrip())]) for line in text.split("\n"))
    return [text, fill(80), fill(38), fill(70).replace("\n", "\r\n"), *("\n".join(f"{lead} {line}".rstrip() for line in fill(72).split("\n")) for lead in ("#", "//", " *", "--")), f"A heading of some kind\nThe title\n\n{fill(80)}\n\nOther words follow.\nAnd more."]


def test_published_licences_wrapped_and_not(spark):
    rows = [(k, form, name) for k, (form, name) in enumerate((form, name) for text, name in PUBLISHED for form in forms(text))]
    got = {r["doc_id"]: [tuple(x) for x in r["licences"]] for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()}
    assert {k: got[k] for k, _, _ in rows} == {k: [(name, 1)] for k, _, name in rows}


def test_names_and_notices(spark):
    rows = {
        "Released under CC  BY 4.0.": "CC-BY-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 3.0 Unported License": "CC-BY-NC-3.0", "Some prose\nwithout marks\nReleased under the\nMIT License": "MIT",
        "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "# SPDX-License-Identifier: CC-BY-SA-4.0": "CC-BY-SA-4.0", "SPDX-License-Identifier: Unknown-1.0": None, "licensed under the Mozilla Public License v2.0": "MPL-2.0",
        "This file is in the public domain.": "Public-Domain", "Copyright (c) 2001\nAll rights reserved.": "Proprietary", "Released under the MIT License and others": None, "Licensed under the EUPL": None,
    }
    listed = list(rows)
    got = licences.licences(spark.createDataFrame(list(enumerate(listed)), "doc_id long, text string")).collect()
    assert {listed[r["doc_id"]]: (r["licences"][0]["licence"] if r["licences"] else None) for r in got} == rows
