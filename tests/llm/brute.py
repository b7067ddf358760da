"""Plain versions of the contracts, one document or pair at a time."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def fingerprint(text):
    words = SPACE_WORD.findall((text or "").translate(AZ).encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, budget=2):
    """{(doc_id, fingerprint): smallest doc_id} for [(doc_id, fingerprint)]."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    array = np.array(distinct, np.uint64)
    for i, p in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= budget):
            root[find(distinct[i + 1 + j])] = find(p)
    least = defaultdict(lambda: float("inf"))
    for d, p in prints:
        if d is not None:
            least[find(p)] = min(least[find(p)], d)
    return {(d, p): least[find(p)] for d, p in prints}


def base_spans(text):
    text = text or ""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return [(m.start(), k, m.end()) for k, (_, p, fine) in enumerate(kinds) for m in re.finditer(p, text) if fine(m[0])]


def substring_dedup(docs, window=50):
    """{doc_id: (n_words, n_removed, kept_sha256)} for {doc_id: text}."""
    words = {d: SPACE_WORD.findall((t or "").encode()) for d, t in docs.items()}
    first = {}
    for d in sorted(docs):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = True
        out[d] = len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def benchmark_hits(text, items, window=13):
    split = lambda t: ITEM_WORD.findall((t or "").translate(AZ))
    words = split(text)
    phrases = defaultdict(set)
    for name, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[i : i + window])].add(str(name))
    hit, found = np.zeros(len(words), bool), set()
    for size in {len(p) for p in phrases}:
        for i in range(len(words) - size + 1):
            if own := phrases.get(tuple(words[i : i + size])):
                hit[i : i + size] = True
                found |= own
    n = int(hit.sum())
    return len(words), n, len(found), sha(",".join(sorted(found))), n > 0 and 20 * n >= len(words)


def crc(text):
    return zlib.crc32((text or "").encode())


def top_k(rows, k=10, every=100):
    fine = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in fine if i % every == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(b) == len(a))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out
