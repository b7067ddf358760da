"""Disclosing words are counted and marked in whole documents."""

import math
import random
import re
from collections import Counter

import brute
import regex

from claimloom.llm import private


def test_far_words_are_counted_and_marked(spark):
    gap = " ".join(["und"] * 60)
    text = lambda k: f"Zebrafish {gap} mail{k} ann@zoo.example.org {gap} zebrafish {gap} zebrafish"
    rows = [(k, text("x" * k)) for k in range(3)] + [(None, text("z"))] + [(10 + k, f"und others write {k}") for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in private.private_spans(frame).collect():
        if r["doc_id"] is None or r["doc_id"] < 3:
            own = text("z") if r["doc_id"] is None else rows[r["doc_id"]][1]
            told = [own[s["start"] : s["end"]] for s in r["spans"] if s["kind"] == len(private.PATTERNS)]
            assert [t.lower() for t in told].count("zebrafish") == 3 and "und" not in told
        else:
            assert r["spans"] == []
    clean = [r["text"] for r in private.sanitise(frame).collect()]
    assert not any("zebrafish" in t.lower() or "ann@" in t for t in clean)


def plain_terms(docs, support=2, generalise=0.5):
    """{row number: places of disclosing words} by counting over all rows, one entity and word at a time."""
    distinct = list(dict.fromkeys(docs))
    held, words, places = [], [], []
    for _, t in distinct:
        t = t or ""
        spans = brute.base_spans(t)
        masked = list(t)
        for a, _, b in spans:
            masked[a:b] = " " * (b - a)
        found = [(m[0].lower(), m.start(), m.end()) for m in regex.finditer(r"\p{L}{3,}", "".join(masked))]
        held.append({f"{k}:" + (t[a:b].lower() if k == 0 else re.sub("[ ().-]", "", t[a:b])) for a, k, b in spans})
        words.append({w for w, *_ in found})
        places.append(found)
    # Words are counted over all rows, entities and what they share over rows that differ.
    of_term = Counter(w for d in docs for w in words[distinct.index(d)])
    total, out = len(docs), {k: set() for k in range(len(distinct))}
    for entity in set().union(*held):
        own = [k for k, h in enumerate(held) if entity in h]
        for w in set().union(*(words[k] for k in own)):
            both = sum(w in words[k] for k in own)
            if len(own) >= support and both >= support and math.log2(total / len(own)) > 0:
                share = math.log2(total * both / (len(own) * of_term[w])) / math.log2(total / len(own))
                if share >= generalise:
                    for k in own:
                        out[k] |= {(a, b) for x, a, b in places[k] if x == w}
    return {d: out[k] for k, d in enumerate(distinct)}


def test_terms_equal_plain_shares(spark):
    r = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "kappa", "omega") for b in ("", "ton", "Ünd", "ic")]
    entities = ["ann@a.example.org", "Bob@b.example.org", "10.0.0.1", "+1 555 0100 999", "4539 1488 0343 6467"]
    docs = []
    for k in range(120):
        mine = r.randrange(5)
        some = [r.choice(vocabulary[4 * mine : 4 * mine + 8]) for _ in range(r.randint(0, 9))] + ([entities[mine]] if r.random() < 0.4 else [])
        r.shuffle(some)
        docs.append((k, " ".join(some)))
    docs += [docs[3], docs[3], (None, docs[5][1]), (200, None), (201, "")]
    got = private.private_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(docs)
    want = plain_terms(docs)
    have = [(r["doc_id"], tuple(sorted((s["start"], s["end"]) for s in r["spans"] if s["kind"] == len(private.PATTERNS)))) for r in got]
    assert sorted(have, key=repr) == sorted(((d[0], tuple(sorted(want[d]))) for d in docs), key=repr)
    assert sum(map(bool, want.values())) > 10
