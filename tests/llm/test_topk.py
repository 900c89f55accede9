import math
import random

import numpy as np
from pyspark.sql import functions as F

from chronolith.llm.topk import products, top_k
from tests.llm import plain


LOW, HIGH = -(1 << 63), (1 << 63) - 1


def brute(rows, k=20, every=20):
    fit = lambda n: max(LOW, min(HIGH, n))
    data = [(i, [fit(math.floor(64 * x)) for x in v]) for i, v in rows if i is not None and plain.usable(v)]
    out = []
    for q, vector in data:
        if q % every == 0:
            scored = sorted((-fit(sum(a * b for a, b in zip(vector, v))), i) for i, v in data if i != q and len(v) == len(vector))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(df, **kw):
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, **kw).collect())


def test_table_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    assert run(df) == brute([tuple(r) for r in df.collect()])


def test_awkward_rows(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(5)]) for i in range(1, 90)]
    hot = [0.5, 0.25, -0.5, 1.0, 0.125]
    rows += [(100 + i, hot) for i in range(200)]
    rows += [(400, None), (420, []), (440, [1.0, None, 2.0, 3.0, 4.0]), (460, [float("nan")] * 5), (480, [float("inf")] + [1.0] * 4), (None, hot), (500, [0.0] * 5), (520, [1.0, 2.0]), (521, [3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int, score long, block long")
    assert run(df) == brute(rows)
    assert run(df, slices=3) == brute(rows)
    few = df.filter("vec_id in (20, 21, 22)")
    assert run(few) == brute([r for r in rows if r[0] in (20, 21, 22)])
    assert run(df.limit(0)) == []


def test_components_of_every_size(spark):
    rnd = random.Random(6)
    for size, low in ((1e6, 1e6), (1e15, -1e15), (1e300, -1e300), (3e9, 1e9), (4e7, -4e7)):
        rows = [(i, [rnd.uniform(low, 3 * size) for _ in range(64)]) for i in range(1, 121)]
        rows += [(i, [rnd.uniform(-1, 1) for _ in range(64)]) for i in range(130, 150)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert run(df) == brute(rows), size


def test_products_are_exact_and_end_at_64_bits():
    rng = np.random.default_rng(3)
    for bits in (10, 26, 30, 40, 62):
        for dim in (1, 5, 700):
            a, b = (rng.integers(-(1 << bits), 1 << bits, (4, dim)) for _ in range(2))
            a[0], b[0] = LOW, HIGH
            want = [[max(LOW, min(HIGH, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
            assert products(a, b).astype(object).tolist() == want
    for total in (HIGH, HIGH + 1, HIGH + 2, LOW, LOW - 1, LOW + 1, 1 << 53, -(1 << 53) - 1):
        a, b = np.array([[1 << 40, 1, 1]]), np.array([[total >> 40, (total & (1 << 40) - 1) >> 1, (total & (1 << 40) - 1) - ((total & (1 << 40) - 1) >> 1)]])
        assert int(products(a, b)[0, 0]) == max(LOW, min(HIGH, total))


def test_repeated_ids_and_copies(spark):
    rnd = random.Random(7)
    vector = lambda: [rnd.uniform(-1, 1) for _ in range(4)]
    one, hot = vector(), vector()
    rows = [(i, vector()) for i in range(1, 40)] + [(20, vector()), (20, one), (20, one)]  # a queried id with four vectors
    rows += [(60, hot)] * 70 + [(i, hot) for i in range(61, 75)] + [(40, hot)] * 25 + [(7, hot)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(df) == brute(rows)
    assert run(df, k=3) == brute(rows, 3)


def test_sums_of_slices_beyond_doubles(spark):
    rnd = random.Random(8)
    for low, high in ((94_906_000, 94_906_400), (60_000_000, 95_000_000)):  # two slices, each below 2^53, their sum above
        rows = [(i, [rnd.randrange(low, high) / 64 for _ in range(2)]) for i in range(1, 101)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = run(df)
        assert got == brute(rows) and any(1 << 53 < r[3] < 1 << 54 and r[3] % 2 for r in got)
