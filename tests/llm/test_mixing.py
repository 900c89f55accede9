import numpy as np
from pyspark.sql import functions as F

from chronolith.llm import mixing
from tests.llm import plain


def test_targets_are_capped_and_reshared():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, 250 / 3, 250 * 2 / 3]
    got = mixing.targets([10, 1000, 1000, 0], [3, 1, 2, 3])
    assert got[0] == 20 and got[3] == 0 and abs(sum(got) - 1.5 * 2010) < 1e-9
    assert mixing.targets([], []) == []


def test_draws_meet_what_is_owed(monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 1000)
    owed = np.array([100_000, 3, 0, 50_001])
    whole = list(mixing.drawn(owed, 1, 0, 151))
    assert [shard for shard, _, _ in whole] == list(range(151))
    assert (sum(counts for _, _, counts in whole) == owed).all() and all(counts.sum() == 1000 for _, _, counts in whole[:-1])
    done = np.zeros(4, np.int64)
    for _, before, counts in whole:
        assert (before == done).all() and (counts >= 0).all()
        done = done + counts
    shares = np.array([counts[0] / 1000 for _, _, counts in whole[:-1]])
    assert abs(shares.mean() - 2 / 3) < 0.01 and 0.005 < shares.std() < 0.05  # they vary as draws do
    some = [one for part in ((0, 7), (7, 60), (60, 151)) for one in mixing.drawn(owed, 1, *part)]  # whatever the tasks
    assert all((x[1] == y[1]).all() and (x[2] == y[2]).all() for x, y in zip(whole, some))
    large = np.array([10**15, 3, 10**14])
    ((_, before, counts),) = mixing.drawn(large, 1, 10**11, 10**11 + 1)
    assert counts.sum() == 1000 and before.sum() == 10**14 and list(mixing.drawn(owed * 0, 1, 0, 9)) == []


def test_permutations():
    for n in (1, 2, 3, 17, 1000, 1025):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), 1000, 5).tolist() != mixing.permuted(np.arange(1000), 1000, 6).tolist()


def check(df):
    rows = mixing.mix(df).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = (r.target, r.source_size)
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    goal = mixing.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])
    for s, g in zip(names, goal):
        assert target[s][1] == sizes[s] and abs(target[s][0] - g) < 1e-6
        assert abs(taken[s] - g) <= max(2 * mixing.BLOCK, 0.02 * g)
    return sorted((tuple(r) for r in rows), key=repr)


def brute(df):
    """What a plain walk over every word of the sources as laid out takes of each row."""
    rows, sources = mixing.laid(df)
    places = sorted((r.s, r.start, r["size"], r.doc_id) for r in rows.collect())
    taken = {(r.s, r.block): r.taken for r in mixing.slots(df.sparkSession, sources).collect()}
    at, out = {}, []
    for s, start, size, doc_id in places:
        assert start == at.get(s, 0)  # end to end, without gaps
        at[s] = start + size
        out.append((doc_id, size, sum(taken.get((s, w // mixing.BLOCK), 0) for w in range(start, start + size))))
    for s, blocks, owed in sources:
        assert sum(n for (i, _), n in taken.items() if i == s) == owed and all(0 <= k < blocks for i, k in taken if i == s)
    return sorted(out, key=repr)


def test_taken_against_a_plain_walk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(((r.doc_id, r["size"], r.taken) for r in mixing.mix(docs).collect()), key=repr) == brute(docs)


def test_hot_rows(spark):
    rows = [(1, "the same row " * 3, "en", "hot")] * 9000 + [(None, f"no id {i}", "en", "hot") for i in range(500)] + [(2, f"one id {i} " * 9, "de", None) for i in range(500)]
    df = plain.awkward(spark, rows)
    assert len(check(df)) == len(rows)
    assert sorted(((r.doc_id, r["size"], r.taken) for r in mixing.mix(df).collect()), key=repr) == brute(df)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = check(docs)
    assert len(got) == docs.count() and got == check(docs.repartition(7))
    want = {r.doc_id: len(plain.words(r.text)) for r in docs.collect()}
    assert {r[0]: r[2] for r in got} == want


def test_awkward_rows(spark):
    rows = [(i, "w " * (i % 90), "en", "hot") for i in range(600)] + [(1000 + i, "x y\tz\x0b" * 40, "de", f"s{i % 4}") for i in range(80)]
    rows += [(2000, None, None, None), (None, "only these words " * 200, None, None), (2001, "", "en", "void"), (7, "long " * 50_000, "en", "s1")] + [(5, "same row", "en", "hot")] * 3
    df = plain.awkward(spark, rows)
    assert len(check(df)) == len(rows)
    assert mixing.mix(df.limit(0)).collect() == []
    assert mixing.mix(df.filter("doc_id in (2000, 2001)")).select(F.sum("taken")).first()[0] == 0


def test_mixed_documents_have_the_words_taken(spark):
    rows = [(i, " ".join(f"{i}-{j}" for j in range(30 + 11 * i)), "en" if i % 2 else None, f"s{i % 3}") for i in range(40)]
    df = plain.awkward(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    got = {}
    for r in mixing.mixed_documents(df).collect():
        words = r.text.split()
        assert [w for w in rows[r.doc_id][1].split() if w in set(words)] == words
        assert (r.lang, r.source, r.n_chars) == (rows[r.doc_id][2], rows[r.doc_id][3], len(r.text))
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words)
    assert {d: n for d, n in taken.items() if n} == got
