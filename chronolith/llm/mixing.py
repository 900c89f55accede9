"""Mixing sources to target weights.

The words of a source, its documents laid end to end in a pseudorandom order, are packed into blocks of fixed length.
The mix is a run of slots, cut into output shards; each shard draws its number of slots of every source from a
multinomial over what the sources still owe, so that the whole mix meets the targets. The j-th slot of a source takes
block P(j mod n) of its n blocks, P being a pseudorandom permutation (a Feistel network, walked until it falls inside
the range) that differs for each pass over the source. Slots and documents meet by (source, block).

A shard's counts come from a tree that halves the range of shards: at each node the sources' counts are split by seeded
binomials, corrected to the halves' sizes, so that every task draws its own shards. The driver holds a few numbers for
each source, never shards, documents or blocks. Equal rows are laid out as one run of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import WORD, checkpointed

#: Words of a block, slots of an output shard, documents (about) that are laid end to end in one task, and copies of a
#: row that one task lists.
BLOCK, SHARD, LAID, COPIES = 64, 1 << 16, 2048, 4096
#: Most sources (a few numbers each in the driver and in every task), and up to which their table is broadcast.
MOST_SOURCES, SENT_SOURCES = 1_000_000, 100_000


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take of each source: ``share`` of all words by weight, at most ``most`` times a source's own; what
    lies above goes to the others by weight until none is above."""
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def halved(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of the ``left`` slots that come first are of each source: binomials, corrected to add up."""
    got = rng.binomial(counts, left / max(1, int(counts.sum())))
    while short := left - int(got.sum()):
        room = counts - got if short > 0 else got
        more = np.minimum(rng.multinomial(abs(short), room / room.sum()), room)
        got = got + np.sign(short) * more
    return got


def drawn(owed: np.ndarray, seed: int, first: int, last: int):
    """(shard, slots before it, slots in it) of each source for the shards in [first, last)."""
    total = int(owed.sum())

    def node(a, b, before, counts):
        if b <= first or last <= a:
            return
        if b - a == 1:
            yield a, before, counts
            return
        middle = (a + b) // 2
        own = halved(counts, min(total, middle * SHARD) - a * SHARD, np.random.default_rng((seed, a, b)))
        yield from node(a, middle, before, own)
        yield from node(middle, b, before + own, counts - own)

    if total:
        yield from node(0, -(-total // SHARD), np.zeros(len(owed), np.int64), owed)


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at each index."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, half_u = np.uint64((1 << half) - 1), np.uint64(half)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        y = x[todo]
        for turn in range(4):
            a, b = y >> half_u, y & mask
            f = (b + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD6E8FEB86659FD93) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(31)
            f *= np.uint64(0x94D049BB133111EB)
            y = b << half_u | a ^ (f >> np.uint64(29) & mask)
        x[todo] = y
        todo[todo] = y >= np.uint64(n)
    return x.astype(np.int64)


def laid(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 11, carry: tuple[str, ...] = ()):
    """Documents at their places in their sources, and the sources.

    Returns (rows, sources): rows are doc_id, source, t (a hash of the text), ``carry``, size, s (the source's number),
    source_size, target and start (words before it in the source); sources are (s, blocks, slots owed). Texts are read
    once, for their sizes, which go on through a checkpoint. Equal rows are laid out together and listed at the end.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    rows = docs.select("doc_id", "source", *carry, size, F.xxhash64("text").alias("t"))
    rows = checkpointed(rows.groupBy("doc_id", "source", *carry, "size", "t").agg(F.count("*").alias("copies")))
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.words for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    named = [(i, r.source, r.words, goal[i], max(1, -(-r.n // LAID))) for i, r in enumerate(totals)]
    known = spark.createDataFrame(named, "s int, name string, source_size long, target double, parts int")
    known = F.broadcast(known) if len(named) <= SENT_SOURCES else known
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # the order inside a source: by a hash cut into parts, so that no task lays out a whole large source
    rows = rows.withColumn("h", F.xxhash64("doc_id", "t", F.lit(seed))).withColumn("part", F.pmod("h", F.col("parts")).cast("int"))
    words = F.col("size") * F.col("copies")
    parts = rows.groupBy("s", "part").agg(F.sum(words).alias("own"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("s", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "part").orderBy("h", "doc_id", "t", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    rows = rows.join(parts, ["s", "part"]).withColumn("start", F.col("base") + F.col("inside"))
    few = rows.filter(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    runs = rows.filter(F.col("copies") > COPIES).withColumn("run", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES))))
    runs = runs.repartition(F.col("s"), F.col("start"), F.col("run"))  # a hot row's copies are listed by many tasks
    many = runs.withColumn("copy", F.explode(F.sequence("run", F.least(F.col("run") + COPIES, F.col("copies")) - 1))).drop("run")
    rows = few.unionByName(many).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    sources = []
    for i, n in enumerate(sizes):
        blocks = -(-n // block)
        sources.append((i, blocks, round(goal[i] * blocks / n) if n else 0))
    return rows.select("doc_id", "source", "t", *carry, "size", "s", "source_size", "target", "start"), sources


def slots(spark, sources, seed: int = 11) -> DataFrame:
    """(s, block, taken, shard): how often the mix takes each block that it takes, and the first shard it is in."""
    blocks, owed = (np.array([one[i] for one in sources], np.int64) for i in (1, 2))
    sent = spark.sparkContext.broadcast((blocks, owed))
    shards = -(-int(owed.sum()) // SHARD)

    def run(batches):
        blocks, owed = sent.value
        for batch in batches:
            own = batch.column(0).to_numpy()
            if not len(own):
                continue
            for shard, before, counts in drawn(owed, seed, int(own[0]), int(own[-1]) + 1):
                for s in np.flatnonzero(counts).tolist():
                    j = np.arange(before[s], before[s] + counts[s])
                    block, turns = np.empty_like(j), j // blocks[s]
                    for turn in np.unique(turns).tolist():
                        block[turns == turn] = permuted(j[turns == turn] % blocks[s], int(blocks[s]), seed * 1_000_003 + s * 101 + turn)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(j), s, np.int32)), pa.array(block), pa.array(np.full(len(j), shard, np.int32))],
                        names=["s", "block", "shard"],
                    )

    plan = spark.range(0, shards, 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism + shards // 64)))
    found = plan.mapInArrow(run, "s int, block long, shard int")
    return found.groupBy("s", "block").agg(F.count("*").alias("taken"), F.min("shard").alias("shard"))


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(s, start, block, low, high): the words [low, high) of each document that lie in each block."""
    full = rows.filter("size > 0").select("s", "start", "size")
    each = full.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    low = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    high = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start"))
    return each.select("s", "start", "block", low.alias("low"), high.alias("high"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    A null text has size 0 and is taken 0 times; a null source is the last source; repeated rows are laid out one
    after the other; a source without words has target 0; an empty table gives no rows. No document is taken more
    than twice (with the default ``most``), and runs with one seed agree.
    """
    rows, sources = laid(docs, **options)
    block = options.get("block", BLOCK)
    got = pieces(rows, block).join(slots(docs.sparkSession, sources, options.get("seed", 11)).hint("merge"), ["s", "block"])
    taken = got.groupBy("s", "start").agg(F.sum((F.col("high") - F.col("low")) * F.col("taken")).alias("taken"))
    full = rows.filter("size > 0").join(taken, ["s", "start"], "left")
    empty = rows.filter("size = 0").withColumn("taken", F.lit(None).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target"]
    out = full.select(*columns, "taken").unionByName(empty.select(*columns, "taken"))
    return out.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """The mix as documents: each document once for each pass that takes words of it, with the words taken.

    Columns doc_id, text, lang, source, n_chars. A document of which a pass takes all words keeps its text unchanged;
    otherwise its text is the taken words joined by one space. Documents of no words are not taken.
    """
    rows, sources = laid(docs, block=block, seed=seed, carry=("lang",))
    got = pieces(rows, block).join(slots(docs.sparkSession, sources, seed).hint("merge"), ["s", "block"])
    passes = got.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("taken").cast("int"))))
    spans = passes.groupBy("s", "start", "turn").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"), F.sum(F.col("high") - F.col("low")).alias("words"))
    own = rows.filter("size > 0").select("doc_id", "source", "t", "lang", "size", "s", "start")
    spans = own.join(spans, ["s", "start"])
    key = ["doc_id", "source", "lang"]
    texts = docs.select(*[F.col(c).alias(f"own_{c}") for c in key], F.xxhash64("text").alias("own_t"), "text")
    texts = texts.groupBy("own_t", *[f"own_{c}" for c in key]).agg(F.min("text").alias("text"))
    same = F.col("t") == F.col("own_t")
    for name in key:
        same &= F.col(name).eqNullSafe(F.col(f"own_{name}"))
    joined = spans.join(texts, same)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = F.array_join(F.flatten(F.transform("spans", lambda p: F.slice(words, (p["low"] + 1).cast("int"), (p["high"] - p["low"]).cast("int")))), " ")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(some)
    out = joined.select("doc_id", text.alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op8_mixing(spark, sf_dir) -> DataFrame:
    """How much of each document the mix takes."""
    from chronolith.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
