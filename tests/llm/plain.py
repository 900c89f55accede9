"""Brute-force versions of the operators' contracts, and awkward rows."""

import hashlib
import math
from collections import Counter, defaultdict

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk int, fp long, size long, bucket int"


def awkward(spark, rows):
    """Documents (doc_id, text, lang, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 7, 7, 7, 7) for i, t, l, s in rows], DOCS)


def words(text):
    return (text or "").encode().split()


def substring(docs, window=35):
    seen = Counter(tuple(w[i : i + window]) for _, t in docs for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for doc_id, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def simhash(docs, radius=2):
    prints = []
    for doc_id, text in docs:
        w = (text or "").encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for doc_id, p in prints:
        if doc_id is not None:
            least[find(p)].append(doc_id)
    return sorted(((d, f"{p:016x}", min(least[find(p)], default=None)) for d, p in prints), key=repr)


def usable(vector):
    return vector is not None and len(vector) > 0 and all(x is not None and math.isfinite(x) for x in vector)
