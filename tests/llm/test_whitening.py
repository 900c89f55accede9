import math
import random

import numpy as np
import pytest

from chronolith.llm.whitening import fit, op11_whitening, usable, whiten
from tests.llm import plain


def brute(rows, components=8):
    """{dimension: (n, deviations by row, |coordinates|, shares)} by plain integers and one covariance."""
    data = [(i, [math.floor(1024 * x) + 100_000 for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dim in {len(v) for _, v in data}:
        own = [(i, v) for i, v in data if len(v) == dim]
        n, sums = len(own), [sum(v[d] for _, v in own) for d in range(dim)]
        centred = np.array([[(n * x - s) / n for x, s in zip(v, sums)] for _, v in own]).reshape(n, dim)
        values, axes = np.linalg.eigh(centred.T @ centred / n)
        for (i, v), c in zip(own, centred):
            deviation = sum((n * x - s) ** 2 for x, s in zip(v, sums))
            for k in range(min(components, dim)):
                e = values[dim - 1 - k]
                out.append((i, k + 1, n, deviation, abs(c @ axes[:, dim - 1 - k]) / math.sqrt(e) if e > values.sum() * 1e-13 else None, e / values.sum() if values.sum() > 0 else None))
    return out


def compare(got, want):
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4] or 0))
    got, want = order(got), order(want)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for g, w in zip(got, want):
        for a, b in zip(g[4:], w[4:]):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-4, abs=1e-7)), (g, w)


def exploded(df):
    return [(r.vec_id, k + 1, r.n, r.deviation, None if w is None else abs(w), s) for r in df.collect() for k, (w, s) in enumerate(zip(r.whitened, r.explained))]


def test_table_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = op11_whitening(spark, sf_dir).collect()
    compare([(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got], brute([(r.vec_id, r.embedding) for r in df.collect()]))
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9
    w = np.zeros((got[0].n, 8))
    place = {i: n for n, i in enumerate(sorted({r.vec_id for r in got}))}
    for r in got:
        w[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(w.T @ w / len(w) - np.eye(8)).max() < 1e-9


def test_awkward_rows(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) * (d + 1) for d in range(10)]) for i in range(60)]
    rows += [(7, rows[7][1])] * 30 + [(None, rows[3][1]), (70, None), (71, [1.0, None] * 5), (72, [float("nan")] * 10), (73, [math.inf] * 10), (74, []), (75, [1.0, 2.0]), (76, [1.0, 3.0]), (77, [1.0, 5.0]), (78, [4.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, n long, v long, whitened string")
    got = whiten(df)
    assert sum(r.vec_id == 74 and r.whitened == [] for r in got.collect()) == 1
    compare(exploded(got), brute([r for r in rows if r[1] is None or len(r[1]) > 0]))
    by = {r.vec_id: r for r in got.collect() if r.vec_id is not None}
    assert by[75].n == 3 and by[75].whitened[1] is None and by[75].explained == [pytest.approx(1), pytest.approx(0)]
    assert by[78].whitened == [None] and by[78].explained == [None] and by[78].identity_error is None
    assert whiten(df.limit(0)).collect() == [] and whiten(df.filter("vec_id = 70")).collect() == []
    assert [plain.usable(v) for _, v in rows[90:96]] == [True, False, False, False, False, False]


def test_large_entries_stay_exact(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) * size for size in (1, 1e6, 1e12, 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(i, k, n, min(d, (1 << 63) - 1), w, s) for i, k, n, d, w, s in brute(rows)]
    assert [r[:4] for r in sorted(exploded(whiten(df)))] == [r[:4] for r in sorted(want)]
    far = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0])], "vec_id long, embedding array<double>")
    model = fit(usable(far))[1]
    assert model.sums == (100_000,) and model.n == 3


def test_the_mean_costs_no_digits(spark):
    rows = [(i, [1e9 + (i % 2) / 1024, 1e9 - (i % 3) / 1024]) for i in range(600)]
    m = fit(usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)))[2]
    assert sorted(m.values.tolist()) == pytest.approx([0.25, 2 / 3], rel=1e-9) and m.identity_error < 1e-9
