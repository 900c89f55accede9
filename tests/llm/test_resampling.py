import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import resampling
from chronolith.llm.resampling import hashes, joined, op13_resampling, ranked, resample
from tests.llm import plain

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target):
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    rows = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, n])
    fit = sorted((r for r in rows if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(fit[: 5 * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def run(df, target):
    return sorted((tuple(r) for r in resample(df, target).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_table_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in op13_resampling(spark, sf_dir).collect()), key=repr)
    assert got == brute(docs, target)


def test_hashes_of_runs():
    rnd = random.Random(1)
    words = [bytes(rnd.randrange(97, 123) for _ in range(rnd.choice([1, 3, 9, 63, 64, 65, 300, 5000]))) for _ in range(60)]
    owner = np.sort(np.array([rnd.randrange(9) for _ in words]))
    got = sorted(zip(*map(np.ndarray.tolist, hashes(words, owner))))
    assert got == sorted((owner[i], zlib.crc32(b" ".join(words[i : i + n]))) for n in (1, 2, 3) for i in range(61 - n) if owner[i] == owner[i + n - 1])
    a, b = b"x" * 70_000, b"y" * 200_000
    assert joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))[0] == zlib.crc32(a + b)


def test_awkward_rows(spark, monkeypatch):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)] + ["Über", "x" * 90]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rnd.choice([0, 1, 2, 3, 19, 20, 21, 60])), "en", "a") for i in range(300)]
    rows += [(400, None, None, None), (401, "", "en", "a"), (None, text(30), "en", "a"), (402, text(60_000), "en", "a"), (403, "-- ,.", None, "a")]
    rows += [(500, rows[5][1], "en", "a")] * 40 + [(501, text(40), "en", "a")] * 3
    target = [text(40), None, "", text(3)]
    docs, wanted = plain.awkward(spark, rows), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long")
    pairs = [(i, t) for i, t, _, _ in rows]
    want = brute(pairs, target)
    assert run(docs, wanted) == want
    assert run(docs.limit(0), wanted) == [] and run(docs, wanted.limit(0)) == brute(pairs, [])
    monkeypatch.setattr(resampling, "MOST", 7)
    assert run(docs.repartition(9), wanted) == want


def test_long_texts_in_stretches():
    data = b" ".join(b"w%d" % (i * i % 97) for i in range(900)) + b" " + b"z" * 400 + b" end"
    words = data.split()
    whole = sorted(hashes(words, np.zeros(len(words), int))[1].tolist())
    for size in (1, 5, 64, 1000, 10_000):
        parts = [hashes(w, np.zeros(len(w), int), n)[1].tolist() for w, n in resampling.stretches(data, size)]
        assert sorted(x for p in parts for x in p) == whole


def test_ranks_over_ranges(spark):
    rows = [(i % 37, i) for i in range(500)] + [(5, 5)] * 300
    got = ranked(spark.createDataFrame(rows, "a long, b long").repartition(5), F.desc("a"), F.asc("b")).orderBy("rank").collect()
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1])) and [r["rank"] for r in got] == list(range(1, 801))


def test_a_chunk_that_changed_is_an_error(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words of a text here") for i in range(50)], "doc_id long, text string")
    other = resampling.postings(docs, 100, 1).withColumn("digest", F.col("digest") + (F.col("range") > 0).cast("long"))
    monkeypatch.setattr(resampling, "postings", lambda *_: other)
    with pytest.raises(Exception, match="write the documents to a table first"):
        resampling.weights(docs, docs, 100).collect()
