import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chronolith.llm import ann
from tests.llm import plain


def brute(rows, k=5, every=50):
    data = [(i, np.array(v, float)) for i, v in rows if i is not None and plain.usable(v) and any(v)]
    out = {}
    for q, vector in data:
        if q % every == 0:
            near = [(i, v) for i, v in data if i != q and len(v) == len(vector)]
            if near:
                scores = ann.cosines(np.tile(vector, (len(near), 1)), np.array([v for _, v in near]))
                out.setdefault(q, []).extend(sorted((-s, i) for s, (i, _) in zip(scores.tolist(), near))[:k])
    return out


def found(df, k=5, **kw):
    out = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k, **kw).collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert 1 <= r["rank"] <= k
    return {q: sorted(rows) for q, rows in out.items()}


def recall(got, want):
    hits = sum((Counter(i for _, i in want[q]) & Counter(i for _, i in got.get(q, []))).total() for q in want)
    return hits / sum(map(len, want.values()))


def test_table_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    got, want = found(df), brute([tuple(r) for r in df.collect()])
    assert recall(got, want) >= 0.95 and all(len(got[q]) == 5 for q in want)
    for q in want:
        truth = {i: s for s, i in want[q]}
        assert all(abs(s - truth[i]) < 1e-12 for s, i in got[q] if i in truth)


def test_large_group_of_copies(spark):
    rng = np.random.default_rng(0)
    hot = rng.normal(size=16)
    rows = [(i, (rng.normal(size=16) if i % 3 else hot + 0.01 * rng.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(df)
    assert recall(got, brute(rows)) >= 0.9 and {len(v) for v in got.values()} == {5}


def test_awkward_rows(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(1, 120)]
    rows += [(200 + i, rows[49][1]) for i in range(20)] + [(300, None), (350, []), (400, [0.0] * 6), (450, [None] + [1.0] * 5), (500, [float("nan")] * 6), (550, [float("-inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got, want = found(df), brute(rows)
    assert set(got) == set(want) and recall(got, want) == 1
    assert [i for _, i in got[50]] == [200, 201, 202, 203, 204]  # ties go to the smaller id
    assert found(df.limit(0)) == {}
    assert {q: len(v) for q, v in found(df.filter("vec_id in (50, 51, 52)")).items()} == {50: 2}


def test_beam_is_no_worse_than_greedy():
    x = ann.unit(np.random.default_rng(1).normal(size=(500, 16)))
    books = ann.fit(x, 4, 32)
    error = {}
    for beam in (1, 8):
        codes, norms, aligned = ann.encode(x, books, beam)
        rebuilt = sum(books[b][codes[:, b]] for b in range(4))
        assert np.allclose(np.linalg.norm(rebuilt, axis=1), norms) and np.allclose((x * rebuilt).sum(1), norms * aligned)
        error[beam] = ((x - rebuilt) ** 2).sum()
    assert error[8] <= error[1]


def test_cosines_are_those_of_the_originals():
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(9, 7)), rng.normal(size=(9, 7))
    plain_ones = [float(a @ b / np.sqrt((a @ a) * (b @ b))) for a, b in zip(q, x)]
    assert np.allclose(ann.cosines(q, x), plain_ones, atol=1e-14)
    assert np.allclose(ann.cosines(q * 1e200, x * 1e-200), plain_ones, atol=1e-14)


def test_repeated_ids_copies_and_rare_dimensions(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8).tolist()
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 340)]
    rows += [(50, rng.normal(size=8).tolist()), (400, hot)] + [(400, hot)] * 12 + [(401, hot)] * 7 + [(i, hot) for i in range(402, 460)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(df), brute(rows)
    want = {q: sorted(v) for q, v in want.items()}
    assert got.keys() == want.keys() and {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    assert recall(got, want) >= 0.98 and got[300] == want[300] and got[400] == want[400]


def test_few_rows_are_reranked(spark, sf_dir):
    x = ann.unit(np.array([r[0] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("embedding").collect()]))
    books = ann.fit(x[: len(x) * 3 // 4])
    slack = ann.calibrated(x[len(x) * 3 // 4 :], books, 5)
    _, norms, aligned = ann.encode(x, books)
    assert 1 <= slack < 6 and aligned.mean() > 0.8
