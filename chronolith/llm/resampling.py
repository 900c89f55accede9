"""Importance resampling towards a target corpus, over bucket-partitioned inverted postings.

Features are hashed into buckets. How often each bucket occurs in either corpus is summed on the map side first, so
that a bucket as common as the words of every text costs one row a task. Then each task turns its documents, some at a
time (a chunk), into inverted postings (bucket, document, count), sorted and packed, and deals them out by range of
buckets; a range is split into as many groups as its size needs, each with the range's counts from both corpora beside
it. There a bucket's gain is computed locally and every posting emits its contribution, added up for the documents of
a chunk; a second, small exchange by chunk reduces them by document. Gumbel noise from a digest of the document's id
makes the highest scores a draw without replacement; ranks come from a sort by ranges and the ranges' sizes.

CRC-32 of a run of words is made from the words' own: appending bytes is linear, so a table for each length shifts
many values at once.
"""

from __future__ import annotations

import math
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import checkpointed, pack_sorted, unpack_sorted
from chronolith.llm.licenses import FOLD

#: Words of a chunk; longer texts (in bytes) are counted apart, in stretches; most documents of a chunk.
CHUNK, LONG, MOST = 500_000, 1 << 20, 1 << 16
#: Ranges of buckets; least number of groups of a range; features of a group (about two bytes each when packed).
RANGES, LEAST, GROUP = 40, 6, 1 << 23
#: Lengths that have a table of their own.
SHORT = 64


def _shifted(c: np.ndarray, table: np.ndarray, row) -> np.ndarray:
    return table[row, 0, c & 255] ^ table[row, 1, c >> 8 & 255] ^ table[row, 2, c >> 16 & 255] ^ table[row, 3, c >> 24]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables that append n zero bytes to a CRC-32: for n below SHORT, and for n = 2^i."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    values = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    direct = [values]
    for _ in range(SHORT):
        direct.append(direct[-1] >> 8 ^ one[direct[-1] & 255])
    powers = [direct[1]]
    for _ in range(31):
        powers.append(_shifted(powers[-1], powers[-1][None], 0))
    return np.array(direct[:SHORT]), np.array(powers)


def joined(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of strings put together: of the left ones, of the right ones, and the right ones' lengths."""
    direct, powers = _tables()
    out = _shifted(left, direct, np.minimum(sizes, SHORT - 1))
    for i in np.flatnonzero(sizes >= SHORT).tolist():
        c = left[i : i + 1]
        for bit in range(int(sizes[i]).bit_length()):
            if int(sizes[i]) >> bit & 1:
                c = _shifted(c, powers, bit)
        out[i] = c[0]
    return out ^ right


def hashes(words: list[bytes], owner: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(owner, CRC-32) of all runs of one to three words of one owner that end at word ``before`` or later."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    one = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    space, unit = np.uint32(zlib.crc32(b" ")), np.ones(len(words), np.int64)
    runs, owners = [one[before:]], [owner[before:]]
    begun = one
    for n in (1, 2):
        if len(words) <= n:
            break
        begun = joined(joined(begun[: len(words) - n], np.full(len(words) - n, space), unit[n:]), one[n:], sizes[n:])
        inside = owner[:-n] == owner[n:]
        inside[: max(0, before - n)] = False
        runs.append(begun[inside])
        owners.append(owner[:-n][inside])
    return np.concatenate(owners), np.concatenate(runs)


def stretches(data: bytes, size: int = LONG):
    """(words, of which from the stretch before) of a folded text, a bounded number of bytes at a time."""
    at, held = 0, []
    while at < len(data):
        end = data.find(b" ", min(at + size, len(data)))
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        yield held + words, len(held)
        held, at = (held + words)[-2:], end


def chunks(texts, buckets: int):
    """(rows, words of each, postings) of a sequence of texts, in order: postings are (bucket * rows + row, count), sorted."""
    held: list[list[bytes]] = []
    count = 0

    def out():
        nonlocal held, count
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        owner, crc = hashes([w for words in held for w in words], np.repeat(np.arange(len(held)), sizes))
        keys, n = np.unique((crc % buckets).astype(np.int64) * len(held) + owner, return_counts=True)
        found = len(held), sizes, keys, n
        held, count = [], 0
        return found

    for text in texts:
        data = (text or b"").translate(FOLD)
        if len(data) > LONG:
            if held:
                yield out()
            n, dense = 0, np.zeros(buckets, np.int64)
            for words, before in stretches(data):
                n += len(words) - before
                dense += np.bincount(hashes(words, np.zeros(len(words), np.int64), before)[1] % buckets, minlength=buckets)
            yield 1, np.array([n]), np.flatnonzero(dense), dense[dense > 0]
            continue
        words = data.split()
        if held and (count + len(words) > CHUNK or len(held) >= MOST):
            yield out()
        held.append(words)
        count += len(words)
    if held:
        yield out()


def _binary(texts: DataFrame, *columns: str) -> DataFrame:
    return texts.select(*columns, F.col("text").cast("binary").alias("text"))


def totals(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends a row for each of its buckets."""

    def run(batches):
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            for rows, _, keys, n in chunks((t.as_py() for t in batch.column(0)), buckets):
                np.add.at(found, keys // rows, n)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], names=["bucket", "n"])

    return _binary(texts).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


POSTINGS = "range int, salt int, chunk long, digest long, size int, postings binary, counts binary, ids array<long>, words array<long>"
PARTS = "chunk long, digest long, size int, weights binary, ids array<long>, words array<long>"
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _packed(values: np.ndarray) -> bytes:
    """Integers in the narrowest signed type that holds them; the reader knows their number."""
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if not len(values) or np.iinfo(k).min <= values.min() and values.max() <= np.iinfo(k).max)
    return values.astype(kind).tobytes()


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // max(count, 1) or 1}").astype(np.int64)


def postings(docs: DataFrame, buckets: int, salts: int) -> DataFrame:
    """Packed postings of each chunk and range of buckets; the row of range 0 also names the chunk's documents.

    A chunk is numbered by its task's partition and a running number. A task that runs again must get its rows in the
    same order, as from a table; a digest of the documents goes with every row, and rows of one number that disagree
    are an error, never a wrong weight.
    """
    width = -(-buckets // RANGES)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, at = batch.column(0), 0
            for size, words, keys, n in chunks((t.as_py() for t in batch.column(1)), buckets):
                own = ids.slice(at, size).to_pylist()
                at += size
                digest = zlib.crc32(words.tobytes(), zlib.crc32(repr(own).encode()))
                ends = np.searchsorted(keys, np.arange(1, RANGES + 1) * width * size)
                out, begin = [], 0
                for r, end in enumerate(ends.tolist()):
                    if end > begin or r == 0:
                        found = (keys[begin:end] - r * width * size).astype(np.uint32)
                        out.append((r, number % 1_000_003 % salts, number, digest, size, pack_sorted(found), _packed(n[begin:end]), own if r == 0 else None, words.tolist() if r == 0 else None))
                    begin = end
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _arrow(POSTINGS))], schema=_arrow(POSTINGS))

    return _binary(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, POSTINGS)


def weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_features, n_words, weight) for each row of docs: the sum of its features' gains.

    A bucket's gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))): its features in the target (t) and
    in docs (s), and those of all buckets (T, S).
    """
    width = -(-buckets // RANGES)
    known = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    s, t = totals(docs, buckets).withColumnRenamed("n", "s"), totals(target, buckets).withColumnRenamed("n", "t")
    both = checkpointed(known.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0))
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    salts = max(LEAST, -(-all_s // (RANGES * GROUP)))
    of = F.collect_list(F.struct("bucket", "s", "t"))
    beside = both.groupBy(F.floor(F.col("bucket") / width).cast("int").alias("range")).agg(F.sort_array(of).alias("buckets"))
    beside = beside.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def contribute(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _arrow(PARTS).empty_table()
        (counted,) = right.column("buckets").to_pylist()
        gain = np.array([math.floor(1000 * math.log((b["t"] + 1) * (all_s + buckets) / ((b["s"] + 1) * (all_t + buckets)))) for b in counted], np.int64)
        out = []
        for one in left.to_pylist():
            keys, size = unpack_sorted(one["postings"], np.uint32).astype(np.int64), one["size"]
            value = gain[keys // size] * _unpacked(one["counts"], len(keys)) if len(keys) else np.zeros(0, np.int64)
            found = np.zeros(size, np.int64)
            np.add.at(found, keys % size, value)
            out.append((one["chunk"], one["digest"], size, _packed(found), one["ids"], one["words"]))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _arrow(PARTS))], schema=_arrow(PARTS))

    def reduce(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        named = [r for r in rows if r["ids"] is not None]
        if len(named) != 1 or len({r["digest"] for r in rows}) != 1:
            raise ValueError("a task that ran again got other rows; write the documents to a table first")
        size, words = named[0]["size"], np.array(named[0]["words"], np.int64)
        weight = sum(_unpacked(r["weights"], size) for r in rows)
        features = sum(np.maximum(words - n, 0) for n in range(3))
        return pa.table([pa.array(named[0]["ids"], pa.int64()), pa.array(features), pa.array(words), pa.array(weight)], names=["doc_id", "n_features", "n_words", "weight"])

    listed = postings(docs, buckets, salts)
    parts = listed.groupBy("range", "salt").cogroup(beside.groupBy("range", "salt")).applyInArrow(contribute, PARTS)
    return parts.groupBy("chunk").applyInArrow(reduce, "doc_id long, n_features long, n_words long, weight long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with their place (rank, from 1) in an order over all of them: a sort by ranges, whose sizes are then added up.

    Ranges are told apart by random numbers too, so equal rows spread over several; among them any order will do.
    """
    sorted_rows = rows.withColumn("_tie", F.rand(42)).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    at = checkpointed(sorted_rows.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    at = at.select(*rows.columns, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_n"))
    sizes = at.groupBy("_part").agg(F.count("*").alias("_size"))
    earlier = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("_part", F.coalesce(earlier, F.lit(0)).alias("_begin"))  # a row for each partition of the sort
    return at.join(F.broadcast(begins), "_part").withColumn("rank", F.col("_begin") + F.col("_n") + 1).drop("_part", "_n", "_begin")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: str = "42") -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) for each row of docs.

    Features are runs of one to three words, repeats counted. score is the weight plus Gumbel noise from the id's digest;
    of the N rows with enough words the floor(percent N / 100) highest scores are drawn, ties to the smaller id, and
    have ranks from 1; the others' rank is null.

    Null and empty texts have no features, weight 0, and are not drawn. A row without an id has no score and is not
    drawn, but counts in the corpus. Repeated rows are rows of their own (their order among equals is any). Very long
    texts are counted in stretches. Other columns are ignored; an empty table gives no rows, an empty target leaves
    the gains to the corpus alone.
    """
    found = weights(docs, target, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = checkpointed(found.withColumn("score", F.col("weight") + noise))
    fit = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    draw = scored.filter(fit).count() * percent // 100
    drawn = ranked(scored.filter(fit), F.desc("score"), F.asc("doc_id"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def op13_resampling(spark, sf_dir) -> DataFrame:
    """Every document's weight towards the benchmark's texts, its score, and its rank among the 5 % drawn."""
    from chronolith.llm.common import table

    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
