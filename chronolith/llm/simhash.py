"""SimHash near-duplicates by covering locality-sensitive hashing.

Word shingles give 64-bit fingerprints. Bit i of a fingerprint carries the label m(i), one of the seven non-zero
vectors of GF(2)^3; table v (v = 1..7) keeps the bits with <m(i), v> = 1. For two differing bits i and j there is
always a v that is orthogonal to both labels, so both bits are masked out in table v: every pair within radius 2
collides in some table, without exception (a covering, not a probabilistic, scheme).

A collision in a table is what makes a pair. Within a table, fingerprints that share a masked key can only differ in the
bits that are masked out; two of them differ in at most two of those if and only if their balls of radius one over
these bits meet. So each emits the points of that ball (under its table), and the at most 29 distinct fingerprints that
meet in a point are joined to the smallest of them. Groups of any size thus cost a number of rows in proportion to
their members, and pairs are never listed. A fingerprint that is alone under a masked key emits nothing there; once
there are 10^10 of them few are alone.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import checkpointed, release

BITS = 64
RADIUS = 2
#: Edges that one task takes while components are found.
TASK = 100_000


def masks() -> list[int]:
    """The 2^(r+1)-1 masks of the covering for radius 2, as signed 64-bit integers."""
    out = []
    for v in range(1, 2 ** (RADIUS + 1)):
        mask = sum(1 << i for i in range(BITS) if bin((i % 7 + 1) & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def majority(hashes) -> int:
    """The bits that are set in over half of some unsigned hashes; none: 0."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > len(hashes)).tolist()))


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned SimHash of a text: bit set where over half the shingle hashes have it; no word: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())
        hashes = list(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in spans], repeat(42)))
    return majority(hashes)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the signed fingerprint of each row's whole text; null and empty texts have 0."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def balls() -> list[list[int]]:
    """For each table what turns a fingerprint into the points of its ball over the masked-out bits, itself first."""
    signed = [1 << i if i < 63 else -(1 << 63) for i in range(BITS)]
    return [[0, *(bit for i, bit in enumerate(signed) if not mask >> i & 1)] for mask in masks()]


def links(prints: DataFrame) -> DataFrame:
    """(src, dst): edges that connect all distinct fingerprints of ``fp`` within the radius, through no others."""
    distinct = prints.select("fp").distinct()
    keys = [F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(m).alias("key")) for v, m in enumerate(masks())]
    keyed = distinct.select("fp", F.inline(F.array(*keys)))
    shared = keyed.groupBy("v", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    colliding = keyed.join(shared.select("v", "key"), ["v", "key"], "left_semi")
    ball = F.element_at(F.lit(balls()), F.col("v") + 1)
    points = colliding.select("v", "fp", F.explode(F.transform(ball, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    met = points.groupBy("v", "point").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
    edges = met.select(F.explode("members").alias("src"), F.array_min("members").alias("dst"))
    return edges.filter("src <> dst").distinct()


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """df, which has ``rows`` rows, in tasks of about TASK rows, if it has more tasks than that. A short edge list thus isn't
    dealt to every shuffle partition in every round; a long one is."""
    return df.coalesce(max(1, -(-rows // TASK)))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of an edge list reaches.

    Alternates large-star and small-star steps until nothing changes; each round ends in a reliable checkpoint, and only a count and a
    hash of the edges come to the driver. A round over at most TASK edges is one task without a shuffle. Labels themselves, and nodes without an edge, have no row.
    """

    def both(pairs: DataFrame, *ways: tuple[str, str]) -> DataFrame:
        """A row (src, dst) for each of the ways to take a row of pairs."""
        return pairs.select(F.inline(F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in ways))))

    def star(pairs: DataFrame, larger: bool, few: bool) -> DataFrame:
        if larger:
            near = both(pairs, ("src", "dst"), ("dst", "src"))
        else:
            near = pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        if few:
            moved = near.withColumn("root", F.least(F.min("dst").over(Window.partitionBy("src")), "src"))
        else:  # a node may have more edges than one task should take
            moved = near.join(near.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("root")), "src")
        if larger:
            return moved.filter("dst > src").select(F.col("dst").alias("src"), F.col("root").alias("dst")).distinct()
        return both(moved, ("dst", "root"), ("src", "root")).filter("src <> dst").distinct()

    state, before = checkpointed(edges), None
    while True:
        now = tuple(state.agg(F.count("*"), F.sum(F.hash("src", "dst").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        few = now[0] <= TASK
        state, before = checkpointed(star(star(narrowed(state, now[0]), True, few), False, few)), now
        release(edges.sparkSession)
    return state.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label"))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most two differing bits, the row's own included.
    Texts are taken whole, one at a time. An empty table gives none. Null or empty texts share fingerprint 0; rows without a doc_id link others but give no component its id;
    repeated rows come out repeated; other columns are ignored.
    """
    prints = checkpointed(fingerprints(docs, width))
    labels = components(links(prints))
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = smallest.join(labels, smallest.fp == labels.node, "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("root")
    )
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(roots, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir) -> DataFrame:
    """The fingerprint of every document and the smallest doc_id that it is linked with."""
    from chronolith.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
