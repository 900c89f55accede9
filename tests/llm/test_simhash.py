import random

import pytest
from pyspark.sql import functions as F

from chronolith.llm import simhash
from tests.llm import plain


def run(df):
    rows = simhash.near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_every_pair_in_the_radius_collides():
    masks = simhash.masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not (1 << i | 1 << j) & m for m in masks)


def test_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run(docs) == plain.simhash([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_awkward_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, None), (4, ""), (9, " \n"), (3, "A"), (2, "a"), (None, "b c"), (7, "B c"), (None, "alone here"), (8, "É é"), (8, "É é"), (12, base)]
    rows += [(20 + i, base.replace(f"w{i * 37} ", "other ")) for i in range(10)]
    df = plain.awkward(spark, [(i, t, None, None) for i, t in rows])
    assert run(df) == plain.simhash(rows)
    assert run(df.limit(0)) == []


def test_links_of_close_fingerprints(spark):
    rnd = random.Random(1)
    start = [rnd.getrandbits(64) for _ in range(60)]
    prints = {p for s in start for p in (s, s ^ 1 << rnd.randrange(64), s ^ 1 << 63 ^ 1 << rnd.randrange(63), s ^ 7)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(p,) for p in signed.values()], "fp long")
    got = {r.node: r.label for r in simhash.components(simhash.links(df)).collect()}
    for a in prints:
        for b in prints:
            if a != b and bin(a ^ b).count("1") <= 2:
                assert got.get(signed[a], signed[a]) == got.get(signed[b], signed[b])
    assert len(set(got.values())) == 60


def test_long_chains_become_one_component(spark):
    df = spark.range(1, 301).selectExpr("id as src", "id - 1 as dst")
    assert {r.label for r in simhash.components(df).collect()} == {0}


def test_links_come_out_of_the_tables(spark, monkeypatch):
    assert [len(b) for b in simhash.balls()] == [1 + 64 - bin(m % (1 << 64)).count("1") for m in simhash.masks()]
    assert max(len(b) for b in simhash.balls()) == 29
    whole = simhash.masks()
    bits = [i for i in range(64) if whole[0] >> i & 1][:2]  # two bits that the first table keeps
    df = spark.createDataFrame([(5,), (5 ^ 1 << bits[0] ^ 1 << bits[1],)], "fp long")
    assert simhash.links(df).count() == 1
    monkeypatch.setattr(simhash, "masks", lambda: whole[:1])
    assert simhash.links(df).count() == 0  # without the tables that mask both bits out there is no pair


@pytest.mark.parametrize("task", [30, 100_000])
def test_components_of_long_and_short_edge_lists(spark, monkeypatch, task):
    monkeypatch.setattr(simhash, "TASK", task)
    rnd = random.Random(12)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rnd.randrange(-300, -200), rnd.randrange(-300, -200)) for _ in range(80)]
    rnd.shuffle(pairs)
    root = {n: n for p in pairs for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = simhash.components(spark.createDataFrame(pairs, "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == sorted((n, find(n)) for n in root if find(n) != n)


def test_rounds_over_few_edges_are_single_tasks(spark, monkeypatch):
    rounds, checkpointed = [], simhash.checkpointed
    monkeypatch.setattr(simhash, "checkpointed", lambda df: (rounds.append(checkpointed(df)), rounds[-1])[1])
    edges = spark.range(500).selectExpr("id src", "id div 7 dst").filter("src <> dst").repartition(9, "src")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        simhash.components(edges).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rounds) > 2 and all(r.rdd.getNumPartitions() == 1 for r in rounds[1:])  # one for each shuffle partition before
