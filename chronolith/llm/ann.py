"""Approximate nearest neighbours with additive quantisation.

A vector of length one is written as a sum of ``books`` full-dimensional codewords, one of each codebook. Codebooks are
fitted to residuals by k-means on a bounded sample; every row is encoded by a beam search over the books, and the norm
of its reconstruction is stored. Blocks of codes, never of vectors, meet the blocks of queries, which score all rows
from a table of their products with the codewords. Rows that can matter are reranked exactly, in two rounds:

1. each block names the few rows with the highest table scores; of those of all blocks the highest are reranked, and the
   k-th best exact cosine is the query's bar (a cosine that k rows reach);
2. each block names every row whose table score comes within ``slack`` standard deviations of the bar, and these are
   reranked. Beside the norm |x'| of its reconstruction a row keeps its cosine a with it: the score <q, x'> / |x'| * a
   estimates the cosine with the query, with deviation sqrt((1 - a^2) / dimension). The slack is calibrated on a part
   of the sample that the codebooks have not seen. There is no cap on candidates.

Named rows fetch their vectors by a join on their place. Equal vectors are one row with as many ids as a result can
hold, so that large groups of copies cost no more than one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import checkpointed
from chronolith.llm.topk import ENTRIES, Block, distinct, meet, packed, valid

#: Bounds of the fit: rows of the sample, fewest of a dimension that is quantised, rounds of k-means for a codebook.
SAMPLE, FEWEST, ROUNDS = 8192, 64, 8
#: Most bytes of the queries' vectors that are broadcast.
SENT = 32 << 20


def fit(sample: np.ndarray, books: int = 16, words: int = 128, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dimension) fitted one after another to what the earlier ones leave."""
    rng, rest, out = np.random.default_rng(seed), sample.astype(np.float32), []
    for _ in range(books):
        near = rng.permutation(len(rest)) % words  # centres start as means: single rows would keep themselves alone
        for turn in range(ROUNDS):
            if turn:
                near = np.argmax(rest @ centres.T - (centres**2).sum(1) / 2, axis=1)
            sums = np.zeros((words, rest.shape[1]), np.float32)
            np.add.at(sums, near, rest)
            centres = sums / np.maximum(np.bincount(near, minlength=words), 1)[:, None].astype(np.float32)
        near = np.argmax(rest @ centres.T - (centres**2).sum(1) / 2, axis=1)
        rest = rest - centres[near]
        out.append(centres)
    return np.stack(out)


def encode(x: np.ndarray, codebooks: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, books) of the best reconstruction that a beam search finds, the reconstructions' norms, and their
    cosines with the rows (of length one)."""
    x = x.astype(np.float32)
    n = len(x)
    codes, rest = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
    for book in codebooks:
        words = len(book)
        error = (rest**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * (rest @ book.T)
        flat = error.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        chosen = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        parent, word = chosen // words, chosen % words
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
        codes = np.concatenate((np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)), 2)
    first = np.argmin((rest**2).sum(2), axis=1)
    pick = np.arange(n)
    rebuilt = x - rest[pick, first]
    norms = np.maximum(np.sqrt((rebuilt**2).sum(1)), 1e-6)
    return codes[pick, first], norms, np.clip((x * rebuilt).sum(1) / norms, -1, 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]  # lengths of very large and very small components stay finite
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of rows of q with rows of x; each depends on its two vectors alone, so that copies tie."""
    q, x = q / np.abs(q).max(1)[:, None], x / np.abs(x).max(1)[:, None]
    return (x * q).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def estimates(q: np.ndarray, codebooks: np.ndarray, codes: np.ndarray, norms: np.ndarray, aligned: np.ndarray) -> np.ndarray:
    """Table scores (queries, rows): estimated cosines of the queries (of length one) with coded rows."""
    table = np.einsum("qd,bwd->bqw", q.astype(np.float32), codebooks)
    return sum(table[b][:, codes[:, b]] for b in range(codes.shape[1])) * (aligned / norms)


def deviations(aligned: np.ndarray, dim: int) -> np.ndarray:
    return np.sqrt(np.maximum(1 - aligned.astype(np.float64) ** 2, 1e-6) / dim)


def calibrated(sample: np.ndarray, codebooks: np.ndarray, k: int, share: float = 0.995, queries: int = 256) -> float:
    """The slack within which ``share`` of the queries' k nearest rows lie, among rows of length one."""
    codes, norms, aligned = encode(sample, codebooks)
    q = sample[:queries]
    exact = q @ sample.T
    exact[np.arange(len(q)), np.arange(len(q))] = -2
    near = np.argsort(-exact, axis=1)[:, :k]
    off = (exact - estimates(q, codebooks, codes, norms, aligned)) / deviations(aligned, sample.shape[1])
    return max(1.0, float(np.quantile(np.take_along_axis(off, near, 1), share)))


def index(data: DataFrame, books: dict[int, tuple[np.ndarray, float]]) -> DataFrame:
    """Blocks of codes (uint8), norms and cosines (float32) of blocks of vectors; no codes where none were fitted."""
    sent = data.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for one in batch.to_pylist():
                x = Block(one).x
                if one["dim"] in sent.value:
                    parts = [encode(unit(x[i : i + 2048]), sent.value[one["dim"]][0]) for i in range(0, len(x), 2048)]
                    coded = [np.concatenate(p) for p in zip(*parts)]
                else:
                    coded = [np.zeros((len(x), 0), np.uint8), np.ones(len(x)), np.zeros(len(x))]
                columns = [coded[0].tobytes()], [coded[1].astype(np.float32).tobytes()], [coded[2].astype(np.float32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([one["block"]]), pa.array([one["dim"]], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["block", "dim", "codes", "norms", "cosines"])

    return checkpointed(data.mapInArrow(run, "block long, dim int, codes binary, norms binary, cosines binary"))


def places(blocks: DataFrame, name: str) -> DataFrame:
    """(place, ids, x): the rows of blocks, x in their own type as bytes, with the type's name."""

    def run(batches):
        for batch in batches:
            for one in batch.to_pylist():
                block = Block(one)
                ends = np.concatenate(([0], block.ends)).astype(np.int32)
                for i in range(0, len(block.x), 4096):
                    n = len(block.x[i : i + 4096])
                    ids = pa.ListArray.from_arrays(pa.array(ends[i : i + n + 1] - ends[i]), pa.array(block.ids[ends[i] : ends[i + n]]))
                    vectors = pa.array([v.tobytes() for v in block.x[i : i + n]], pa.binary())
                    place = (one[name] << 24) + np.arange(i, i + n)
                    yield pa.RecordBatch.from_arrays([pa.array(place), ids, pa.array([one["kind"]] * n), vectors], names=[f"{name}_at", f"{name}_ids", f"{name}_kind", f"{name}_x"])

    return blocks.mapInArrow(run, f"{name}_at long, {name}_ids array<long>, {name}_kind string, {name}_x binary")


def exact(named: DataFrame, data: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked_at, query_id, vec_id, score): the rows at the places named, under their ids, but for the query's own."""
    size = asked.agg(F.sum(F.octet_length("matrix").cast("long"))).first()[0] or 0
    queries = places(asked, "asked")
    met = named.join(places(data, "block"), "block_at").join(F.broadcast(queries) if size <= SENT else queries, "asked_at")

    def vectors(kinds, values):
        return [np.frombuffer(v, k).astype(np.float64) for k, v in zip(kinds.to_pylist(), values.to_pylist())]

    def run(batches):
        for batch in batches:
            get = batch.column
            q, x = vectors(get("asked_kind"), get("asked_x")), vectors(get("block_kind"), get("block_x"))
            score = np.empty(len(q))
            sizes = np.array([len(v) for v in q])
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                score[own] = cosines(np.array([q[i] for i in own]), np.array([x[i] for i in own]))
            yield pa.RecordBatch.from_arrays([get("asked_at"), get("asked_ids"), get("block_ids"), pa.array(score)], names=["asked_at", "own", "ids", "score"])

    scored = met.mapInArrow(run, "asked_at long, own array<long>, ids array<long>, score double")
    rows = scored.select("asked_at", F.col("own")[0].alias("query_id"), F.explode("ids").alias("vec_id"), "score")
    return rows.filter("vec_id <> query_id")


def nearest(vectors: DataFrame, queries, k: int = 5, books: int = 16, words: int = 128, head: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found nearest to each query by cosine, in double precision.

    ``queries`` is a condition on vec_id; every row that meets it is a query with a result of its own, also where rows
    repeat an id. No row with the query's vec_id is a candidate, nor is one of another dimension; fewer candidates
    than k are all returned; ties go to the smaller vec_id. Vectors that are null, empty, zero or hold null or
    non-finite components and vectors without an id take no part. Dimensions with fewer than FEWEST rows in the sample
    are ranked exactly.
    """
    spark = vectors.sparkSession
    rows = valid(vectors).filter(F.exists("v", lambda c: c != 0))
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
        sample.setdefault(len(r.v), []).append(r.v)
    fitted = {}
    for dim, own in sample.items():
        if len(own) >= FEWEST:
            x = unit(np.array(own))
            half = len(x) * 3 // 4
            codebooks = fit(x[:half], books, min(words, half))
            fitted[dim] = codebooks, calibrated(np.unique(x[half:], axis=0), codebooks, k)
    data = packed(distinct(rows, k), "block")
    asked = packed(rows.filter(queries).select("v", F.array("vec_id").alias("ids")), "asked", 1)
    coded, sent = index(data, fitted), spark.sparkContext.broadcast(fitted)

    def scan(named):
        """Rows (asked_at, block_at, score) that ``named`` picks for each query of a pair from estimates, deviations
        and bar."""

        def run(batches):
            for pairs in batches:
                for pair in pairs.to_pylist():
                    asked, dim = Block(pair, "q_"), pair["dim"]
                    norms, aligned = np.frombuffer(pair["norms"], np.float32), np.frombuffer(pair["cosines"], np.float32)
                    codes, bars = np.frombuffer(pair["codes"], np.uint8).reshape(len(norms), -1), dict(zip(pair.get("b_at") or [], pair.get("bars") or []))
                    most = max(1, ENTRIES // max(1, len(norms)))
                    for i in range(0, len(asked.x), most):
                        at = (pair["asked"] << 24) + np.arange(i, min(i + most, len(asked.x)))
                        bar = np.array([bars.get(a, -2.0) for a in at.tolist()])
                        if dim in sent.value:
                            codebooks, slack = sent.value[dim]
                            scores = estimates(unit(asked.x[i : i + most]), codebooks, codes, norms, aligned)
                            width = slack * deviations(aligned, dim)
                        else:
                            scores, width = np.zeros((len(at), len(norms)), np.float32), np.full(len(norms), 9.0)
                        q, row = named(scores, width, bar)
                        yield pa.RecordBatch.from_arrays([pa.array(at[q]), pa.array((pair["block"] << 24) + row), pa.array(scores[q, row].astype(np.float32))], names=["asked_at", "block_at", "score"])

        return run

    def heads(scores, width, bar):
        most = min(scores.shape[1], head + k)
        top = np.argpartition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most :]
        return np.repeat(np.arange(len(scores)), most), top.ravel()

    def near(scores, width, bar):
        return np.nonzero(scores + width >= bar[:, None])

    kind = "asked_at long, block_at long, score float"
    met = meet(coded, asked)
    order = Window.partitionBy("asked_at").orderBy(F.desc("score"), "block_at")
    first = met.mapInArrow(scan(heads), kind).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= head + k)
    first = checkpointed(exact(first.select("asked_at", "block_at"), data, asked))
    ranked = Window.partitionBy("asked_at").orderBy(F.desc("score"), "vec_id")
    bars = first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k)
    told = bars.groupBy(F.shiftright("asked_at", 24).alias("asked")).agg(F.collect_list("asked_at").alias("b_at"), F.collect_list("score").alias("bars"))
    second = exact(met.join(checkpointed(told), "asked", "left").mapInArrow(scan(near), kind).select("asked_at", "block_at"), data, asked)
    return second.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir) -> DataFrame:
    """The 5 nearest found of every 50th embedding among all others."""
    from chronolith.llm.common import table

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
