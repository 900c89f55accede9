"""Exact top-k inner products with a uniform threshold in three phases.

A vector is cut into slices (two by default), and a score is the sum of the slices' partial products. In every block
of vectors each query has one score list for each slice.

1. Gather: each block looks at its longest vectors and sends, for each query, the best totals among the first entries
   of their score lists. The k-th best of all of them is a total that k rows really reach, so it is a safe cutoff.
2. Collect: a row whose partial products all lie below cutoff / slices cannot reach the cutoff. Each block is told its
   queries' cutoffs and collects the entries of any list at or above that uniform threshold; they are sufficient.
   Vectors too short for any of them (a partial product is at most the product of the lengths) are left out unseen.
3. Resolve: collected entries get their exact totals, those below the cutoff go, and at most k of a block are sent on
   (the k best of all rows hold at most k of any block, ties to the smaller id included).

Equal vectors have equal scores, so blocks hold each distinct vector once, with as many of its ids as a result can
hold. Blocks have a bounded size, and queries travel to them in blocks by an equi-join on the blocks' numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import checkpointed, shuffle_partitions

#: Least number of blocks of a table; most bytes of a block; entries of a score matrix worked on at once.
LEAST, BYTES, ENTRIES = 16, 16 << 20, 1 << 21
#: Bits of a limb, and components of which products of limbs add up exactly in a double.
LIMB, EXACT = 22, 512
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def valid(vectors: DataFrame, scale: float | None = None) -> DataFrame:
    """(vec_id, v): rows with an id and a vector without null or non-finite components.

    v is array<double>, or with a scale array<bigint> of floor(scale * x), at the ends of the 64-bit range beyond it.
    Empty vectors take no part.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select("vec_id", x.alias("v")).filter(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    if scale is not None:
        rows = rows.withColumn("v", F.transform("v", lambda c: F.floor(F.lit(scale) * c).cast("bigint")))
    return rows


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each distinct vector with its smallest ids, at most 2 k of them and no id more than k times.

    Whatever id a query leaves out, its k best rows are still among them.
    """
    rows = rows.withColumn("h", F.xxhash64("v"))
    for own, most in ((("h", "v", "vec_id"), k), (("h", "v"), 2 * k)):
        number = F.row_number().over(Window.partitionBy(*own).orderBy("vec_id"))
        rows = rows.withColumn("n", number).filter(F.col("n") <= most).drop("n")
    return rows.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "ids")


def compact(x: np.ndarray) -> np.ndarray:
    """x in the narrowest type that holds it exactly."""
    if x.dtype.kind == "f":
        narrow = x.astype(np.float32)
        return narrow if (narrow == x).all() else x
    for kind in (np.int16, np.int32):
        if x.size and np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


BLOCK = "{0} long, dim int, ids binary, ends binary, kind string, matrix binary"


def packed(rows: DataFrame, name: str, least: int = LEAST) -> DataFrame:
    """(name, dim, ids, ends, kind, matrix): rows (v, ids) in blocks of one dimension and a bounded size; checkpointed.

    Block numbers are the partition and its running count; ids are int64, row n's end at ends[n] (int32).
    """
    rows = rows.select("v", "ids")
    size = rows.agg(F.sum((F.size("v") + F.size("ids")).cast("long"))).first()[0] or 0

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            nonlocal n
            vectors, ids = held.pop(dim)
            n += 1
            x = compact(np.array(vectors))
            columns = [part * 1_000_000 + n - 1], [dim], [np.concatenate(ids).astype(np.int64).tobytes()], [np.cumsum([len(i) for i in ids]).astype(np.int32).tobytes()], [x.dtype.str], [x.tobytes()]
            types = pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[name, "dim", "ids", "ends", "kind", "matrix"])

        for batch in batches:
            for v, ids in zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))):
                got = held.setdefault(len(v), ([], []))
                got[0].append(v), got[1].append(ids)
                if len(got[0]) * (len(v) + 1) * 8 >= BYTES:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    blocks = rows.repartition(max(least, -(-size * 8 // BYTES))).mapInArrow(run, BLOCK.format(name))
    return checkpointed(blocks)


def meet(data: DataFrame, asked: DataFrame) -> DataFrame:
    """A row for each block of vectors and block of queries of one dimension: their numbers first, then their contents.

    A stated set of queries against all rows, in blocks: the join is on the dimension and then on block numbers. Blocks
    of queries are dealt over as many salts as there are shuffle partitions, so that one dimension isn't one task.
    """
    salts = shuffle_partitions(data.sparkSession)
    each = data.select("block", "dim", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pairs = each.join(asked.select("asked", "dim", F.pmod(F.xxhash64("asked"), F.lit(salts)).cast("int").alias("salt")), ["dim", "salt"]).drop("salt")
    queries = asked.select("asked", *[F.col(c).alias(f"q_{c}") for c in asked.columns if c not in ("asked", "dim")])
    return pairs.join(queries, "asked").join(data.drop("dim"), "block")


class Block:
    """The vectors of a block and their ids."""

    def __init__(self, one: dict, prefix: str = ""):
        self.ids = np.frombuffer(one[f"{prefix}ids"], np.int64)
        self.ends = np.frombuffer(one[f"{prefix}ends"], np.int32)
        self.begins = np.concatenate(([0], self.ends[:-1])).astype(np.int32)
        self.x = np.frombuffer(one[f"{prefix}matrix"], one[f"{prefix}kind"]).reshape(len(self.ends), -1)
        self.low = self.ids[self.begins]
        self.alone = len(self.ids) == len(self.ends)
        if not self.alone:  # the first id of each vector other than its lowest one
            other = np.where(self.ids != np.repeat(self.low, self.ends - self.begins), self.ids, HIGH)
            self.next = np.minimum.reduceat(other, self.begins)
            self.single = self.ids[self.ends - 1] == self.low

    def besides(self, own: int) -> tuple[np.ndarray, np.ndarray]:
        """For a query's id: the lowest other id of each vector, and which vectors have one."""
        if self.alone:
            return self.low, self.low != own
        mine = self.low == own
        return np.where(mine, self.next, self.low), ~(mine & self.single)

    def rows(self, some: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of some vectors, without the query's own."""
        if self.alone:
            ids = self.ids[some]
        else:
            sizes = self.ends[some] - self.begins[some]
            ids = np.concatenate([self.ids[a:b] for a, b in zip(self.begins[some], self.ends[some])]) if len(some) else self.ids[:0]
            scores = np.repeat(scores, sizes)
        keep = np.flatnonzero(ids != own)
        keep = keep[best(scores[keep], ids[keep], k)]
        return ids[keep], scores[keep]


def limbs(a: np.ndarray) -> list[np.ndarray]:
    mask = np.int64((1 << LIMB) - 1)
    return [(a & mask).astype(np.float64), (a >> LIMB & mask).astype(np.float64), (a >> 2 * LIMB).astype(np.float64)]


def in_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    """True if no inner product of rows of a and b, nor any part of one, can pass 2^53: doubles hold it exactly."""
    largest = [max(-int(x.min(initial=0)), int(x.max(initial=0))) for x in (a, b)]
    return largest[0] * largest[1] * a.shape[1] < 1 << 53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact; sums beyond the 64-bit range are set to its end.

    In doubles (and so returned) if no sum can pass 2^53; else in three limbs of a component, whose products add up
    exactly in doubles and are carried in 64-bit integers.
    """
    if in_doubles(a, b):
        return a.astype(np.float64) @ b.astype(np.float64).T
    sums = [np.zeros((len(a), len(b)), np.int64) for _ in range(5)]
    for at in range(0, a.shape[1], EXACT):
        left, right = limbs(a[:, at : at + EXACT].astype(np.int64)), limbs(b[:, at : at + EXACT].astype(np.int64))
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                sums[i + j] += (x @ y.T).astype(np.int64)
    mask, top = np.int64((1 << LIMB) - 1), 63 - 2 * LIMB
    sums[1] += sums[0] >> LIMB
    sums[2] += sums[1] >> LIMB
    low = (sums[0] & mask) | (sums[1] & mask) << LIMB | (sums[2] & np.int64((1 << top) - 1)) << 2 * LIMB
    far = np.abs(sums[4]) >= 1 << 36  # decides alone
    high = (sums[2] >> top) + (sums[3] << 3 * LIMB - 63) + (np.where(far, 0, sums[4]) << 4 * LIMB - 63)
    high = np.where(far, np.sign(sums[4]) * 2, high)
    fits = low + np.where(high == -1, np.int64(LOW), np.int64(0))
    return np.where((high == 0) | (high == -1), fits, np.where(high > 0, np.int64(HIGH), np.int64(LOW)))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    order = np.lexsort((ids[some], -scores[some] if scores.dtype.kind == "f" else ~scores[some]))
    return some[order[:k]]


def top_k(vectors: DataFrame, queries, k: int = 20, scale: float = 64, slices: int = 2, head: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query with all other rows.

    ``queries`` is a condition on vec_id; every row that meets it is a query with a result of its own, also where rows
    repeat an id. No row with the query's vec_id is a candidate, nor is one of another dimension; with fewer
    candidates than k all are returned; ties go to the smaller vec_id; rows repeated with one vec_id count as often as
    they occur. Components and scores beyond the 64-bit range are set to its end and compared so. Null ids and invalid
    vectors take no part. The first phase looks at the longest 1 / ``head`` of a block's vectors.
    """
    rows = valid(vectors, scale)
    data = packed(distinct(rows, k), "block")
    asked = packed(rows.filter(queries).select("v", F.array("vec_id").alias("ids")), "asked", 1)

    def cut(dim):
        edges = np.linspace(0, dim, min(slices, dim) + 1).astype(int)
        return list(zip(edges[:-1], edges[1:]))

    def steps(pair):
        """The pair's block, and its queries some at a time: (numbers, ids, vectors)."""
        block, asked = Block(pair), Block(pair, "q_")
        most = max(1, ENTRIES // len(block.x))
        groups = [(np.arange(i, min(i + most, len(asked.x))), asked.ids[i : i + most], asked.x[i : i + most]) for i in range(0, len(asked.x), most)]
        return block, groups

    def batch(out, names):
        columns = [np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in (list(zip(*out)) or [[]] * len(names))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def gather(batches):
        for pairs in batches:
            for pair in pairs.to_pylist():
                block, groups = steps(pair)
                length = np.square(block.x.astype(np.float64)).sum(1)
                most = min(len(length), max(4 * k, len(length) // head))
                longest = np.sort(np.argpartition(length, len(length) - most)[len(length) - most :])
                for numbers, ids, q in groups:
                    out = []
                    lists = [products(q[:, a:b], block.x[longest, a:b]) for a, b in cut(pair["dim"])]
                    first = [np.argpartition(p, most - min(most, 2 * k), axis=1)[:, most - min(most, 2 * k) :] for p in lists]
                    for i, (number, own) in enumerate(zip(numbers, ids)):
                        some = longest[np.unique(np.concatenate([f[i] for f in first]))]
                        lowest, good = block.besides(own)
                        some = some[good[some]]
                        totals = products(q[i : i + 1], block.x[some])[0].astype(np.int64)
                        totals = totals[best(totals, lowest[some], k)]
                        out.append((np.full(len(totals), pair["asked"] << 20 | number), totals))
                    yield batch(out, ["q_no", "score"])

    def resolve(batches):
        for pairs in batches:
            for pair in pairs.to_pylist():
                block, groups = steps(pair)
                told = dict(zip(pair["c_no"] or [], pair["cutoffs"] or []))
                spans = cut(pair["dim"])
                lengths = [np.sqrt(np.square(block.x[:, a:b].astype(np.float64)).sum(1)) for a, b in spans]
                for numbers, ids, q in groups:
                    tau = np.array([told.get(pair["asked"] << 20 | int(n), LOW) for n in numbers], np.int64)
                    least = tau // len(spans) + (tau % len(spans) > 0)
                    near = np.ones(len(block.x), bool)
                    if (least > 0).all():
                        near[:] = False
                        for (a, b), length in zip(spans, lengths):
                            own = np.sqrt(np.square(q[:, a:b].astype(np.float64)).sum(1))
                            with np.errstate(divide="ignore"):
                                near |= length >= (least / own).min() * (1 - 1e-9)
                    near = np.flatnonzero(near)
                    lists = [products(q[:, a:b], block.x[near, a:b]) for a, b in spans]
                    collected = np.zeros((len(q), len(near)), bool)
                    for p in lists:
                        collected |= p >= least[:, None].astype(p.dtype)
                    small, out = in_doubles(q, block.x[near]), []
                    for i, (number, own) in enumerate(zip(numbers, ids)):
                        entries = np.flatnonzero(collected[i])
                        some = near[entries]
                        totals = (sum(p[i, entries] for p in lists) if small else products(q[i : i + 1], block.x[some])[0]).astype(np.int64)
                        lowest, good = block.besides(own)
                        keep = np.flatnonzero((totals >= tau[i]) & good[some])
                        keep = keep[best(totals[keep], lowest[some[keep]], k)]
                        found, scores = block.rows(some[keep], totals[keep], own, k)
                        out.append((np.full(len(found), pair["asked"] << 20 | number), np.full(len(found), own), found, scores))
                    yield batch(out, ["q_no", "query_id", "vec_id", "score"])

    met = meet(data, asked)
    first = met.mapInArrow(gather, "q_no long, score long")
    # a query that has k listed totals gets a cutoff: the k-th best; the others take every row of theirs
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("q_no").orderBy(F.desc("score"))))
    cutoffs = ranked.filter(F.col("rank") <= k).groupBy("q_no").agg(F.count("*").alias("n"), F.min("score").alias("cutoff")).filter(F.col("n") == k)
    told = cutoffs.groupBy(F.shiftright("q_no", 20).alias("asked")).agg(F.collect_list("q_no").alias("c_no"), F.collect_list("cutoff").alias("cutoffs"))
    second = met.join(checkpointed(told), "asked", "left").mapInArrow(resolve, "q_no long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_no").orderBy(F.desc("score"), "vec_id")
    return second.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir) -> DataFrame:
    """The 20 highest integer products of every 20th embedding with all others."""
    from chronolith.llm.common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
