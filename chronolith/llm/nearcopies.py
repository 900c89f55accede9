"""Near copies by similarity: groups of texts that share 0.8 or more of their five-word shingles.

Candidates come first from op10's covering tables, here over fingerprints of the sets of five-word shingles: texts whose
fingerprints meet in a table, at two differing bits or fewer, are checked. That radius doesn't reach down to 0.8, where
fingerprints mostly differ in seven bits or more, so MinHash bands find the others: BANDS keys of ROWS minima each, so
that a pair of similarity s meets in some key with probability 1 - (1 - s^ROWS)^BANDS (at 0.8: 0.99995). Every link is
then checked on the shingles themselves.

Pairs of a key are not listed while they need not be: in the first rounds each text is checked against one other, the
pivot of one of its keys that is still in another group; then against the pivots of all its keys. Most of a large group
is joined by the first round. Members of a key that are in different groups even then are checked pair by pair if the
key has at most SMALL of them. Those of larger keys, such as unlike texts around one passage that all of them quote, or
copies of one text that are edited too much to be similar to each other, are paired by an exact prefix filter instead, on
what they differ in from the pivot of their key: what all of them share doesn't count, and edits of one text alone pair
it with no other.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import checkpointed, release, written
from chronolith.llm.simhash import components, links, majority, narrowed

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 25, 5
#: Rounds against one pivot of a text, and against those of all its keys.
ONE, ALL = 2, 1
#: Members of a key up to which its pairs are listed; larger keys go through the prefix filter.
SMALL = 16
_RNG = np.random.default_rng(11)
_FLIP = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)


def sliced(batches, size: int = 250):
    """The batches some rows at a time, so that few texts are held as Python's objects at once."""
    return (batch.slice(at, size) for batch in batches for at in range(0, batch.num_rows, size))


def shingles(text: bytes | None) -> set[bytes]:
    """Distinct runs of five words, A-Z lower-cased; a shorter text is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    return {b" ".join(words[i : i + WIDTH]) for i in range(max(1, len(words) - WIDTH + 1))} if words else set()


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both >= LEAST * (len(a) + len(b) - both)


def signature(text: bytes | None) -> tuple[int, int, np.ndarray]:
    """A hash of the set of shingles, its SimHash fingerprint, and a key for each band."""
    own = shingles(text)
    hashes = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(42)), np.uint64, len(own)))
    low = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(np.uint32)
        np.minimum(low, ((part ^ _FLIP) * _TIMES).min(1), out=low)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(low.reshape(BANDS, ROWS))]
    return xxhash.xxh64_intdigest(hashes.tobytes(), 7), majority(hashes), np.array(keys, np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, t, node, fp, bands) for each row: t is a hash of its text, node one of its set of shingles."""

    def run(batches):
        for batch in sliced(batches):
            nodes, prints, bands = [], [], []
            for text in batch.column(2).to_pylist():
                node, fp, keys = signature(text)
                nodes.append(node), prints.append(fp), bands.append(keys)
            flat = pa.array(np.concatenate(bands)) if bands else pa.array([], pa.int64())
            offsets = pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)), pa.ListArray.from_arrays(offsets, flat)],
                names=["doc_id", "t", "node", "fp", "bands"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, t long, node long, fp long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (src, dst) of nodes whose texts are similar."""

    def run(batches):
        last, own = None, set()
        for batch in sliced(batches):
            src, dst, keep = batch.column(0), batch.column(1), []
            for b, x, y in zip(dst.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if b != last:
                    last, own = b, shingles(y)
                keep.append(similar(shingles(x), own))
            yield pa.RecordBatch.from_arrays([src, dst], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    a = texts.select(F.col("node").alias("src"), F.col("text").alias("x"))
    b = texts.select(F.col("node").alias("dst"), F.col("text").alias("y"))
    both = pairs.join(a, "src").join(b, "dst").select("src", "dst", "x", "y")
    return both.mapInArrow(run, "src long, dst long")


def covered(nodes: DataFrame) -> DataFrame:
    """(src, dst): nodes (node, fp) whose fingerprints meet in a covering table, each with the smallest one of the point
    where they meet, and those of one fingerprint with its smallest node."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(least, "fp").filter("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst"))
    a = least.select(F.col("fp").alias("src"), F.col("least").alias("x"))
    b = least.select(F.col("fp").alias("dst"), F.col("least").alias("y"))
    return links(nodes).join(a, "src").join(b, "dst").select(F.col("x").alias("src"), F.col("y").alias("dst")).union(same)


def hashed(text: bytes | None) -> np.ndarray:
    """The shingles' hashes, each once, rising."""
    own = shingles(text)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(42)), np.uint64, len(own)))


def middles(state: DataFrame) -> DataFrame:
    """(key, pivot) of ``state`` (key, node, label): a pivot (node, label) is the member that meets most others, counted
    over all its keys. That is the middle of a group of copies, and mostly the same one under all keys of the group."""
    sizes = state.groupBy("key").agg(F.count("*").alias("members"))
    met = state.join(sizes, "key").groupBy("node").agg(F.sum("members").alias("met"))
    order = F.struct((-F.col("met")).alias("rank"), F.xxhash64("node").alias("h"), "node", "label")
    return state.join(met, "node").groupBy("key").agg(F.min(order).alias("p")).select("key", "p")


def differences(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label, n, ref, other, p, hashes) for each pivot that ``members`` (key, node, label) have under a key: the
    shingles that either the text or the pivot has, but not both; n and p are the sizes of their sets, other is the
    pivot's label."""

    def run(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in sliced(batches):
            sizes, others, lists = [], [], []
            for ref, x, y in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if ref not in seen:
                    if len(seen) >= 16:
                        seen.clear()
                    seen[ref] = hashed(y)
                own, pivot = hashed(x), seen[ref]
                sizes.append(len(own)), others.append(len(pivot))
                lists.append(np.setxor1d(own, pivot, assume_unique=True).view(np.int64).tolist())
            columns = [*(batch.column(k) for k in range(4)), pa.array(sizes, pa.int64()), pa.array(others, pa.int64()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "ref", "other", "n", "p", "hashes"])

    asked = members.join(middles(members), "key").select("node", "label", F.col("p.node").alias("ref"), F.col("p.label").alias("other"))
    pivots = texts.select(F.col("node").alias("ref"), F.col("text").alias("y"))
    rows = asked.distinct().join(texts, "node").join(pivots, "ref").select("node", "label", "ref", "other", "text", "y")
    return rows.mapInArrow(run, "node long, label long, ref long, other long, n long, p long, hashes array<long>")


def rare_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst): pairs of ``members`` (key, node, label) that connect all of two labels that are similar and share a key.

    Two sets of n and m shingles are similar if and only if at most (n + m) / 9 are in one alone. Seen from the pivot of
    their key, from which they differ in a and b shingles, that means that 18 times their common differences reach
    9 (a + b) - n - m. Where this asks for none, both are similar to the pivot itself, which is then their link. Other
    pairs meet by a prefix filter on the differences: the rarest ones of each, as many as any partner of another label can
    ask for. Copies of one text that are edited in places of their own thus have no common difference among the rarest,
    however much of the text they share. Two texts share no more differences than the prefixes do up to their last common
    one, and what either has after it; the first common one meets the bound by itself, so one that stands too late pairs
    nothing.
    """
    rows = checkpointed(differences(members, texts).withColumn("a", F.size("hashes").cast("long")))
    release(texts.sparkSession)
    near = F.expr("9 * a <= n + p")
    direct = rows.filter(near & F.expr("label <> other and node <> ref")).select(F.col("node").alias("src"), F.col("ref").alias("dst"))
    rows = rows.filter("node <> ref").withColumn("label", F.when(near, F.col("other")).otherwise(F.col("label")))
    pull = rows.groupBy("ref", "label").agg(F.min(F.expr("9 * a - n")).alias("pull"))
    least = pull.groupBy("ref").agg(F.min(F.struct("pull", "label")).alias("one"))
    second = pull.join(least, "ref").filter("label <> one.label").groupBy("ref").agg(F.first("one").alias("one"), F.min("pull").alias("next"))
    asks = F.greatest(F.expr("if(label = one.label, next, one.pull)"), F.expr("floor((18 * a - 7 * n) / 2)"))
    rows = rows.join(second, "ref").withColumn("most", F.floor((9 * F.col("a") + F.col("n") - asks) / 18) + 1)
    held = rows.select("ref", "node", "label", "n", "a", "most", F.explode("hashes").alias("s"))
    often = held.groupBy("ref", "s").agg(F.count("*").alias("often"))
    order = Window.partitionBy("ref", "node").orderBy("often", "s")
    prefix = held.join(often, ["ref", "s"]).withColumn("at", F.row_number().over(order)).filter("at <= most and often > 1")
    prefix = checkpointed(prefix.select("ref", "s", "node", "label", "n", "a", "at"))
    mixed = prefix.groupBy("ref", "s").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("ref", "s")
    left = prefix.join(mixed, ["ref", "s"], "left_semi")
    right = left.select("ref", "s", F.col("node").alias("dst"), F.col("label").alias("other"), F.col("n").alias("m"), F.col("a").alias("b"), F.col("at").alias("there"))
    size = "label < other and 5 * n >= 4 * m and 5 * m >= 4 * n"
    met = left.join(right, ["ref", "s"]).filter(f"{size} and 18 * (1 + least(a - at, b - there)) >= 9 * (a + b) - n - m").withColumnRenamed("node", "src")
    bound = F.count("*") + F.least(F.first("a") - F.max("at"), F.first("b") - F.max("there"))
    pairs = met.groupBy("ref", "src", "dst").agg(bound.alias("bound"), F.first(F.expr("9 * (a + b) - n - m")).alias("least"))
    return pairs.filter("18 * bound >= least").select("src", "dst").union(direct)


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, t, root) for every row of ``docs`` (doc_id, text): rows linked by similar texts have one root.

    Texts without a word are copies of each other; a root is a hash, not an id, so null and repeated ids group as any.
    """
    prints = checkpointed(signatures(docs))
    nodes = prints.groupBy("node").agg(F.min("t").alias("t"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    close = checkpointed(covered(nodes.select("node", "fp")))
    release(docs.sparkSession)
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
    met = checkpointed(keyed.join(shared.select("key"), "key").select("key", "node"))
    named = met.select("node").union(close.select("src")).union(close.select("dst")).distinct()
    wanted = prints.join(named, "node", "left_semi").groupBy("node").agg(F.min("t").alias("t"))
    rows = docs.select(F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    texts = written(rows.join(wanted, "t").groupBy("node").agg(F.min("text").alias("text")))
    release(docs.sparkSession)

    state, labels = met.withColumn("label", F.col("node")), None
    for n in range(ONE + ALL + 1):
        if n < ONE:
            order = F.struct(F.xxhash64("node", F.lit(n)).alias("h"), "node", "label")
            pivots = state.groupBy("key").agg(F.min(order).alias("p")).select("key", "p")
            pairs = state.join(pivots, "key").filter("label <> p.label").select(F.col("node").alias("src"), "p")
            pairs = pairs.groupBy("src").agg(F.min("p").alias("p")).select("src", F.col("p.node").alias("dst"))
        elif n < ONE + ALL:
            pairs = state.join(middles(state), "key").filter("label <> p.label").select(F.col("node").alias("src"), F.col("p.node").alias("dst"))
        else:
            mixed = state.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).filter("lo <> hi")
            left = checkpointed(state.join(mixed.select("key", "members"), "key"))
            few = left.filter(F.col("members") <= SMALL)
            right = few.select("key", F.col("node").alias("dst"), F.col("label").alias("other"))
            pairs = few.join(right, "key").filter("label < other").select(F.col("node").alias("src"), "dst")
            many = left.filter(F.col("members") > SMALL).select("key", "node", "label")
            if not many.isEmpty():
                pairs = pairs.union(rare_pairs(many, texts))
        if n == 0:
            pairs = pairs.union(close)
        new = checkpointed(verified(pairs.distinct(), texts))
        found = new.count()
        if not found:
            continue
        edges = narrowed(new, found)
        if labels is not None:  # what earlier edges connect is in the labels
            edges = edges.union(labels.select(F.col("node").alias("src"), F.col("label").alias("dst")))
        labels = checkpointed(components(edges))
        state = checkpointed(met.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
        release(docs.sparkSession)
    if labels is None:
        return prints.select("doc_id", "t", F.col("node").alias("root"))
    return prints.join(labels, "node", "left").select("doc_id", "t", F.coalesce("label", "node").alias("root"))
