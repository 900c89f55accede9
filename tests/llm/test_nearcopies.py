import random

import pytest

import corpus_pipeline
from chronolith.llm import nearcopies
from tests.llm import plain


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Groups of positions of texts linked by a similarity of 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[find(i)] = find(j)
    out = {}
    for i in range(len(texts)):
        out.setdefault(find(i), []).append(i)
    return sorted(out.values())


def planted():
    rnd = random.Random(4)
    words = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(3000)) for _ in range(n)]
    texts = []
    for n, edits in ((100, 1), (100, 2), (200, 3), (400, 5), (1000, 20), (60, 1), (300, 12)):
        own = words(n)
        texts.append(" ".join(own))
        for _ in range(5):
            other = list(own)
            for k in rnd.sample(range(n), edits):
                other[k] = f"edit{rnd.randrange(10**6)}"
            texts.append(" ".join(other))
    chain = words(200)
    for k in range(12):  # neighbours are similar, ends are not
        texts.append(" ".join(chain))
        chain[k * 15 : k * 15 + 8] = words(8)
    return texts + [" ".join(words(50)) for _ in range(20)]


def quoting():
    """Texts around one passage; those with few words of their own are similar, the others are not."""
    rnd = random.Random(5)
    word = lambda: str(rnd.randrange(10**7))
    passage = " ".join(word() for _ in range(70))
    return [" ".join([word() for _ in range(n % 11)] + [passage] + [word() for _ in range(n % 7)]) for n in range(80)]


@pytest.mark.parametrize("small", [1, 16])
def test_groups_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(nearcopies, "SMALL", small)
    texts = planted() + quoting() + ["", None, "one two", "One  two"]
    got = {}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in nearcopies.groups(df).collect():
        got.setdefault(r.root, []).append(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, brute(texts)))


def test_covering_tables_give_candidates(spark, monkeypatch):
    rnd, calls, verified = random.Random(8), [], nearcopies.verified
    texts = planted()
    for _ in range(4):
        own = [str(rnd.randrange(10**6)) for _ in range(3000)]
        texts += [" ".join(own), " ".join([*own, "x"]), " ".join(["y", *own])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, own: (calls.append(pairs.collect()), verified(pairs, own))[1])
    rows = nearcopies.signatures(df).select("node", "fp").distinct()
    prints, found = {r.node: r.fp for r in rows.collect()}, nearcopies.covered(rows).collect()
    root = {n: n for n in prints}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in found:
        root[find(a)] = find(b)
    close = [(a, b) for a in prints for b in prints if a < b and bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 2]
    assert close and all(find(a) == find(b) for a, b in close)
    nearcopies.groups(df).collect()
    assert {tuple(r) for r in found} <= {tuple(r) for r in calls[0]}


def edited(copies):
    """Copies of one text, each with words of its own in one to four places; some differ from another in one more alone."""
    rnd = random.Random(6)
    own, texts = [str(rnd.randrange(10**7)) for _ in range(150)], []
    for n in range(copies):
        other = list(own)
        for k in rnd.sample(range(0, 150, 6), 1 + n % 4):
            other[k] = f"edit{rnd.randrange(10**6)}"
        texts.append(" ".join(other))
        if n % 10 == 3:
            other[n % 100 + 3] = f"edit{rnd.randrange(10**6)}"
            texts.append(" ".join(other))
    return texts


def test_copies_edited_in_places_of_their_own_are_not_paired(spark, monkeypatch):
    texts, counts, rare_pairs = edited(160), [], nearcopies.rare_pairs
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def counted(members, own):
        out = rare_pairs(members, own)
        counts.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "rare_pairs", counted)
    got = {}
    for r in nearcopies.groups(df).collect():
        got.setdefault(r.root, []).append(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, brute(texts)))
    assert sum(counts) < len(texts)  # without pivots it grows with the square of the copies


def test_stage_removes_edited_copies(spark):
    texts = planted()
    df = plain.awkward(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept == sorted(min(g) for g in brute(texts))


def test_stage_keeps_a_row_of_each_group_whatever_the_ids(spark):
    rnd = random.Random(7)
    texts = [" ".join(str(rnd.randrange(10**6)) for _ in range(40)) for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (9, texts[2])]  # null ids
    rows += [(5, texts[3]), (6, texts[3]), (5, texts[4]), (7, texts[4]), (5, texts[5]), (5, texts[5] + " x")]  # one id, several texts
    rows += [(8, texts[6] + " z"), (8, texts[6] + " a"), (8, texts[6] + " z"), (None, None), (None, "")]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = plain.awkward(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3)
        kept = sorted((tuple(r)[:2] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()), key=repr)
        want = [(None, texts[0]), (None, texts[1]), (9, texts[2]), (5, texts[3]), (5, texts[4]), (5, texts[5]), (8, texts[6] + " a"), (None, None)]
        assert kept == sorted(want, key=repr)
