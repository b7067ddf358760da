"""Near copies against all pairs of distinct shingle sets."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from claimloom.llm import jaccard, simhash


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def groups(docs):
    sets, root = {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(docs), 2):
        both, all_ = sets[a] & sets[b], sets[a] | sets[b]
        if not all_ or (all_ and Fraction(len(both), len(all_)) >= Fraction(4, 5)):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


def corpus():
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    out = [None, "", " \n", "one", "One", "one two"]
    for n in range(4, 16):  # a word appended: similarity 4/5 from 8 words on
        base = [word() for _ in range(n)]
        out += [" ".join(base), " ".join([*base, word()]), " ".join([*base, word(), word()])]
    passage = [word() for _ in range(12)]
    for k in (1, 20, 40):  # the same passage, repeated, with bodies of their own
        out += [" ".join(passage * k + [word() for _ in range(60)]) for _ in range(3)]
    for _ in range(3):  # families around the threshold
        base = [word() for _ in range(120)]
        for _ in range(12):
            spots = set(r.sample(range(120), r.choice((1, 2, 3))))
            out.append(" ".join(word() if k in spots else w for k, w in enumerate(base)))
    return dict(enumerate(out))


@pytest.mark.parametrize("stars", [0, 1])
def test_groups_equal_all_pairs(spark, monkeypatch, stars):
    monkeypatch.setattr(jaccard, "STARS", stars)
    docs = corpus()
    want = groups(docs)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    kept = {x["doc_id"] for x in simhash.one_of_each(frame).collect()}
    assert kept == {d for d, g in want.items() if d == g}
    assert {x["doc_id"]: x["component_id"] for x in jaccard.near_copies(frame).collect()} == {d: g for d, g in want.items() if d != g}


def test_order_counts_the_shingles_of_all_documents(spark):
    many = 45_000  # more than twice 20,000
    docs = spark.range(0, many, 1, 4).selectExpr("encode(concat('a b c d e ', id), 'UTF-8') _text").unionByName(spark.createDataFrame([(None,), (b"",)], "_text binary"))
    want = np.zeros(1 << jaccard.COUNTED, np.int64)
    for k in range(many):
        for shingle in jaccard.shingle_set(b"a b c d e %d" % k, 5).tolist():
            want[shingle >> 64 - jaccard.COUNTED] += 1
    counts = jaccard.shingle_counts(docs, 5)
    assert counts.sum() == 2 * many and (counts == want).all()
    assert counts[int(jaccard.shingle_set(b"a b c d e", 5)[0]) >> 64 - jaccard.COUNTED] >= many
    assert not jaccard.shingle_counts(docs.limit(0), 5).any()
