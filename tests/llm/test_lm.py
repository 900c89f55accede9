import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from chronolith.llm import lm
from tests.llm import plain


def brute(rows):
    lists = [(d, [*(t or "").encode().lower().split(), None]) for d, t in rows]
    counts = Counter(w for d, ws in lists if d is None or zlib.crc32(str(d).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(((d, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for d, ws in lists), key=repr)


def base_of(rows):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr)


def test_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lm.score(docs).collect()
    assert base_of(rows) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    loss = lambda key: 10 ** (-sum(getattr(r, key) for r in held) / sum(r.n_tokens for r in held))
    assert loss("score") < 0.8 * loss("base_score")  # perplexity of documents held out, against the counts alone


def test_awkward_rows(spark):
    rows = [(i, "a b c a b d " * (i % 7), None, None) for i in range(60)]
    rows += [(None, "a Z é", None, None), (70, None, None, None), (71, "", None, None), (72, "never seen before", None, None), (73, "long text " * 20000, None, None), (3, "twice", None, None), (3, "twice", None, None)]
    df = plain.awkward(spark, rows)
    got = lm.score(df).collect()
    assert base_of(got) == brute([r[:2] for r in rows])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score(df.limit(0)).collect() == []
    assert len(lm.score(df.filter("doc_id in (70, 71)")).collect()) == 2


def setup(words=40, seed=0):
    counts = np.sort(np.random.default_rng(seed).integers(1, 50, words))[::-1].astype(float)
    borders = lm.classes(counts)
    p = {k: v.astype(np.float64) for k, v in lm.start(words, borders, 5, seed).items()}
    return p, borders


def test_gradients():
    p, borders = setup()
    rng = np.random.default_rng(1)
    inputs, words, h = rng.integers(2, 40, (4, 3)), rng.integers(0, 40, (4, 3)), rng.normal(size=(5, 3))
    inputs[2, 1] = lm.END  # a document starts here
    valid = np.ones((4, 3), bool)
    for mask in (None, valid):
        valid[3, 2] = False
        _, grads, _ = lm.window_gradients(p, borders, inputs, words, h, mask)
        for name, value in p.items():
            for at in rng.integers(0, value.size, 6):
                old, sides = value.flat[at], []
                for d in (1e-5, -1e-5):
                    value.flat[at] = old + d
                    sides.append(lm.window_gradients(p, borders, inputs, words, h, mask)[0])
                value.flat[at] = old
                assert abs((sides[0] - sides[1]) / 2e-5 - grads[name].flat[at]) < 1e-4


def test_probabilities_add_up_and_state_is_carried():
    p, borders = setup()
    h = np.random.default_rng(2).normal(size=(1, 5)).repeat(40, 0)
    assert abs(np.exp(lm.outputs(p, borders, h, np.arange(40))).sum() - 1) < 1e-9
    documents = [np.array([*np.random.default_rng(i).integers(2, 40, i * 13), lm.END]) for i in range(9)]
    got = lm.log_likelihoods(p, borders, documents, lanes=3)
    for d, total in zip(documents, got):
        h, before, own = np.zeros((5, 1)), lm.END, 0.0
        for w in d:
            h, *_ = lm.step(p["u"], (p["x"][before] + p["b"])[:, None], h)
            before = w
            own += lm.outputs(p, borders, h.T, np.array([w]))[0]
        assert abs(own - total) < 1e-4 * max(1, abs(own))


def test_windows_hold_every_token_once():
    documents = [np.array([*np.random.default_rng(i).integers(2, 40, i * 7 % 90), lm.END]) for i in range(40)]
    words, sizes, own = lm.dealt(documents, 5)
    got = [[] for _ in range(5)]
    for _, inputs, some, valid in lm.windows(words, sizes):
        for k in range(some.shape[1]):
            held = slice(None) if valid is None else valid[:, k]
            before = got[k][-1] if got[k] else lm.END
            assert inputs[:, k][held].tolist() == [before, *some[:, k][held].tolist()[:-1]]
            got[k] += some[:, k][held].tolist()
    for k, lane in enumerate(own):
        assert got[k] == np.concatenate([documents[i] for i in lane]).tolist()
    assert sorted(i for lane in own for i in lane) == list(range(40))


def test_every_part_of_a_document_trains(spark):
    words = [f"w{i % 50}" for i in range(600)]

    def learnt(words):
        df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").selectExpr("cast(null as long) doc_id", "text")
        params, _ = lm.fit(df, [(f"w{i}".encode(), 12) for i in range(50)], 600, 1, 1)
        return params["u"]

    before = learnt(words)
    for at in range(0, 600, 200):  # the same counts in another order, in one third at a time
        assert not np.array_equal(learnt(words[:at] + words[at : at + 200][::-1] + words[at + 200 :]), before)


def test_scores_do_not_depend_on_the_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: r.score for r in lm.score(docs.repartition(3)).collect()}
    other = {r.doc_id: r.score for r in lm.score(docs.repartition(7, "doc_id")).collect()}
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) <= 1e-9 * abs(one[k]) for k in one)


def test_the_mean_of_many_chunks_is_their_weighted_mean(spark):
    rng = np.random.default_rng(4)
    blobs = [(i, float(w), (rng.normal(size=3) * w)) for i, w in enumerate(rng.integers(1, 9, 300))]
    df = spark.createDataFrame([(i, w, x.tobytes()) for i, w, x in blobs], "chunk int, weight double, sum binary")
    want = sum(x for _, _, x in blobs) / sum(w for _, w, _ in blobs)
    assert np.allclose(lm.averaged(df, 300), want, atol=1e-12)


def test_texts_are_split_once():
    texts = [b"", None, b" A\x0bb\x0c c\r\nd\x1ce\xc2\x85f\xc2\xa0g \t ", b"\xff\xfe \xc3\x89 X\x00Y a", b"  "]
    codes, cuts, words = lm.numbered(pa.array(texts, pa.binary()))
    got = [codes[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
    assert [[words[c - 1] for c in own[:-1]] for own in got] == [(t or b"").lower().split() for t in texts]
    assert all(own[-1] == 0 and 0 not in own[:-1] for own in got) and len(set(words)) == len(words)


def test_buckets_answer_each_chunk(spark):
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 9))) for i in range(80)]
    coded = lm.coded(spark.createDataFrame(rows, "doc_id long, text string"), 5, 3).cache()
    found = lm.count_words(coded).collect()
    want = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1 for w in t.encode().split())
    asked = {(-1 - r.place, r.chunk): bytes(r.words).split(b"\n") for r in coded.filter("place < 0").collect()}
    numbers = lambda r: lm._unpacked(r.counts, np.int64).tolist()
    assert {w: n for r in found if r.chunk is None for w, n in zip(bytes(r.words).split(b"\n"), numbers(r))} == want
    assert {(r.bucket, r.chunk): numbers(r) for r in found if r.chunk is not None} == {k: [want[w] for w in ws] for k, ws in asked.items()}
    assert coded.filter("place >= 0").count() == len(rows)


def test_softmax_of_large_weights_and_many_tokens():
    p, borders = setup()
    words = np.random.default_rng(3).integers(0, 40, 2 * lm.BLOCK + 7)
    h = np.random.default_rng(4).normal(size=(len(words), 5))
    for scale in (1, 1000):  # beyond what exponentials hold
        q = {k: v * scale for k, v in p.items()}
        assert lm.small(np.column_stack((q["w"], q["wb"])), h) == (scale == 1)
        cls = np.searchsorted(borders, words, "right") - 1
        top, low = h @ q["c"].T + q["cb"], h @ q["w"].T + q["wb"]
        want = [top[i, c] - np.logaddexp.reduce(top[i]) + low[i, w] - np.logaddexp.reduce(low[i, borders[c] : borders[c + 1]]) for i, (w, c) in enumerate(zip(words, cls))]
        assert np.allclose(lm.outputs(q, borders, h, words), want, rtol=1e-9, atol=1e-9)


def test_moves_are_adams():
    rng = np.random.default_rng(6)
    p = {"x": rng.normal(size=(7, 3))}
    own, m, v, adam = p["x"].copy(), 0, 0, lm.Adam(p)
    for t in range(1, 6):
        g = rng.normal(size=(7, 3)) * 4
        adam.apply(p, {"x": g.copy()}, 2)
        g = np.clip(g * 2, -5, 5)
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        own = own - 0.01 * math.sqrt(1 - 0.98**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-6)
    assert np.allclose(p["x"], own, rtol=1e-12)


def test_rows_are_added_up_by_id():
    rng = np.random.default_rng(7)
    for size in (1, 40, 3000):
        ids, rows = np.minimum(rng.geometric(0.05, size), 60), rng.normal(size=(size, 4))
        own, sums = lm.sums_by(ids, rows, 61)
        want = np.zeros((61, 4))
        np.add.at(want, ids, rows)
        assert sorted(own) == sorted(set(ids.tolist())) and np.allclose(sums, want[own])
