import random

from pyspark.sql import functions as F

from chronolith.llm.substring import dedup
from tests.llm import plain


def run(df, **kw):
    rows = dedup(df, **kw).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run(docs) == plain.substring([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_awkward_rows(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)] + ["é", " nbsp", "\x1c"]
    def text(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, loop = text(40), "a b c " * 30
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, text(50) + " " + passage), (4, passage + "\n" + text(3000)), (5, text(7) + "  " + passage[:-20]),
            (6, loop), (7, text(34)), (8, text(35)), (9, text(20)), (10, " ".join(["x"] * 35)), (11, " ".join(["y"] * 36))]
    rows += [rows[-4]] * 2 + [(20 + i, passage) for i in range(300)]
    df = plain.awkward(spark, [(i, t, None, None) for i, t in rows])
    for chunks in (1, 7):
        assert run(df, chunks=chunks) == plain.substring(rows)
    assert run(df.limit(0)) == []


def test_spans_are_maximal(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    df = plain.awkward(spark, [(1, "a b " + shared + " c", None, None), (2, shared, None, None)])
    assert {r.doc_id: r.repeats for r in dedup(df).collect()} == {1: [[2, 52]], 2: [[0, 50]]}


def test_words_with_equal_polynomials_stay_apart(spark):
    def twisted(n, a, b):  # such words have one polynomial modulo 2^64, whatever its base
        return "".join(b if bin(i).count("1") % 2 else a for i in range(n))

    one, other = twisted(2048, "a", "b"), twisted(2048, "b", "a")
    around = [f"w{i}" for i in range(40)]
    texts = [" ".join([*around[:20], w, *around[20:]]) for w in (one, other)]
    rows = [(1, texts[0]), (2, texts[1]), (3, one + " " + " ".join(around[:34])), (4, other + " " + " ".join(around[:34]))]
    df = plain.awkward(spark, [(i, t, None, None) for i, t in rows])
    got = run(df)
    assert got == plain.substring(rows) and got[0][2] == 0
