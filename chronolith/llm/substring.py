"""Exact substring dedup with fixed-block anchors.

A window of 35 words always covers one whole block of 18 words that starts at a multiple of 18 in its document
(35 >= 2 * 18 - 1). So the blocks of all documents are the index (non-overlapping, one entry for every 18 words), and
every rolling window of 18 words probes it. A block that is met from at least one other place is an anchor. Each hit
is then extended over the words around it to all 35-word windows that contain it; the windows that occur more than
once, joined where they overlap, are the maximal exact repeats.

How it runs: documents are dealt into chunks of about CHUNK bytes. A chunk sends every bucket of the hash space one
blob with its distinct window hashes (each with two flags: "more than once in this chunk" and "starts a block"), the
bucket adds up the chunks and answers each with the subset that are anchors, and the answer meets the chunk's documents
again in a cogroup. The extension repeats this exchange for the 35-word windows near anchors. A passage with any number
of copies costs one entry for each chunk it is in; no pair of places is ever listed. Chunks and buckets follow the size
of the input, so that neither grows with it.

A false match of the first exchange (rolling hashes, 32 bits beside the bucket) only adds candidates. In the second,
windows match if their rolling hashes of 64 bits and BLAKE2b digests of 64 bits over the words themselves are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import chunked, chunks_for, pack_sorted, text_bytes, unpack_sorted

#: Bytes of text hashed at once, of a chunk, and of the text behind a bucket of hashes.
SLAB, CHUNK, BUCKET = 1 << 20, 16 << 20, 16 << 20
U = np.uint64
_BYTE, _WORD18, _WORD35 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n."""
    got = _POWERS.get(int(base))
    if got is None or len(got[0]) <= n:
        size = max(SLAB // 4, 1 << n.bit_length()) + 1
        inverse = U(pow(int(base), -1, 1 << 64))
        got = _POWERS[int(base)] = tuple(
            np.cumprod(np.concatenate((np.ones(1, U), np.full(size, b, U))), dtype=U) for b in (base, inverse)
        )
    return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def _rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of values[start:end], the same wherever the values stand."""
    up, down = _powers(base, len(values))
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts])


class Slab:
    """The words of some documents: their documents, places and hashes."""

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        blank = (joined == 32) | ((joined >= 9) & (joined <= 13))
        edges = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        starts, ends = edges[::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.cumsum(sizes + 1) - sizes - 1
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.hash = _rolled(joined.astype(U) + U(1), starts, ends, _BYTE) + (ends - starts).astype(U)
        self.texts, self.ends = texts, np.cumsum(ends - starts + 1) - 1  # where words end, joined by one space
        self.starts = self.ends - (ends - starts)

    def windows(self, size: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of this size inside one document, and the windows' hashes."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :])
        return at, _rolled(self.hash, at, at + size, base)

    def digests(self, at: np.ndarray, size: int) -> np.ndarray:
        """Digests of the words of the windows of this size at some first words, which ascend."""
        out, docs = [], self.doc[at]
        cuts = np.flatnonzero(np.diff(docs, prepend=-1)).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(at)]):
            own, base = b" ".join(self.texts[docs[i]].split()), self.starts[self.first[docs[i]]]
            begins, ends = self.starts[at[i:j]] - base, self.ends[at[i:j] + size - 1] - base
            out += [hashlib.blake2b(own[x:y], digest_size=8).digest() for x, y in zip(begins.tolist(), ends.tolist())]
        return np.frombuffer(b"".join(out), U)


def slabs(texts: list[bytes | None]):
    """The texts' positions in groups of about SLAB bytes, and their Slab."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t or b"")
        if size >= SLAB:
            yield group, Slab([texts[j] or b"" for j in group])
            group, size = [], 0
    if group:
        yield group, Slab([texts[j] or b"" for j in group])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(buckets)) >> U(32)


def _short(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits in one number."""
    return _bucket(hashes, buckets) << U(32) | hashes & U(0xFFFFFFFF)


def _distinct(keys: np.ndarray, rest: np.ndarray | None, flags: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Ascending distinct pairs of keys and rest; flag 1: more than once, flag 2: any with flags set."""
    order = np.argsort(keys) if rest is None else np.lexsort((rest, keys))
    keys, rest = keys[order], None if rest is None else rest[order]
    first = _firsts(keys, rest)
    marks = (np.diff(np.append(first, len(keys))) > 1).astype(np.uint8)
    if flags is not None:
        marks |= np.maximum.reduceat(flags[order], first).astype(np.uint8) << 1
    return keys[first], None if rest is None else rest[first], marks


def _firsts(keys: np.ndarray, rest: np.ndarray | None) -> np.ndarray:
    new = keys[1:] != keys[:-1]
    if rest is not None:
        new |= rest[1:] != rest[:-1]
    return np.flatnonzero(np.concatenate(([True], new)))


def _blobs(chunk: int, keys: np.ndarray, rest: np.ndarray | None, marks: np.ndarray, bucket_of: np.ndarray, dtype) -> pa.Table:
    """A row for each bucket: the ascending keys, what goes with them, and their flags. bucket_of ascends."""
    cuts = np.flatnonzero(np.diff(bucket_of, prepend=U(1 << 62)))
    ends = np.append(cuts[1:], len(keys))
    pairs = list(zip(cuts.tolist(), ends.tolist()))
    return pa.table(
        {
            "bucket": pa.array(bucket_of[cuts].astype(np.int32)),
            "chunk": pa.array([chunk] * len(pairs), pa.int32()),
            "keys": pa.array([pack_sorted(keys[a:b].astype(dtype)) for a, b in pairs], pa.binary()),
            "rest": pa.array([b"" if rest is None else rest[a:b].tobytes() for a, b in pairs], pa.binary()),
            "marks": pa.array([marks[a:b].tobytes() for a, b in pairs], pa.binary()),
        }
    )


BLOBS = "bucket int, chunk int, keys binary, rest binary, marks binary"
ANSWER = "chunk int, bucket int, keys binary, rest binary"


def _no_blobs() -> pa.Table:
    return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "rest": pa.array([], pa.binary()), "marks": pa.array([], pa.binary())})


def _answers(dtype, anchored: bool):
    """What a bucket does: keys seen more than once (and, if anchored, as a block), sent back to each chunk."""

    def run(rows: pa.Table) -> pa.Table:
        bucket, chunks = rows["bucket"][0].as_py(), rows["chunk"].to_pylist()
        parts = [unpack_sorted(x, dtype) for x in rows["keys"].to_pylist()]
        extra = [np.frombuffer(x, U) for x in rows["rest"].to_pylist()]
        marks = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["marks"].to_pylist()])
        values, rest = np.concatenate(parts), None if anchored else np.concatenate(extra)
        order = np.argsort(values, kind="stable") if anchored else np.lexsort((rest, values))
        values, rest, marks = values[order], None if anchored else rest[order], marks[order]
        first = _firsts(values, rest)
        good = np.add.reduceat(1 + (marks & 1).astype(np.int64), first) > 1
        if anchored:
            good &= np.maximum.reduceat(marks, first) > 1
        hit = np.empty(len(values), bool)
        hit[order] = np.repeat(good, np.diff(np.append(first, len(values))))
        out, ends = [], np.cumsum([len(p) for p in parts])
        for chunk, part, more, own in zip(chunks, parts, extra, np.split(hit, ends[:-1])):
            if own.any():
                out.append((chunk, bucket, pack_sorted(part[own]), b"" if anchored else more[own].tobytes()))
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.table({"chunk": pa.array(columns[0], pa.int32()), "bucket": pa.array(columns[1], pa.int32()), "keys": pa.array(columns[2], pa.binary()), "rest": pa.array(columns[3], pa.binary())})

    return run


def _told(answer: pa.Table, dtype) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, keys, what goes with them), by bucket."""
    rows = zip(*(answer[c].to_pylist() for c in ("bucket", "keys", "rest")))
    return [(b, unpack_sorted(k, dtype), np.frombuffer(r, U)) for b, k, r in sorted(rows)]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _pairs_among(keys: np.ndarray, rest: np.ndarray, known: np.ndarray, known_rest: np.ndarray) -> np.ndarray:
    """Which pairs of keys and rest are known; keys must all be among the known ones, which ascend as pairs."""
    low, high = np.searchsorted(known, keys), np.searchsorted(known, keys, "right")
    good = known_rest[low] == rest
    for i in np.flatnonzero(~good & (high - low > 1)).tolist():
        good[i] = rest[i] in known_rest[low[i] : high[i]]
    return good


def dedup(docs: DataFrame, window: int = 35, chunks: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, repeats) for every row of ``docs``.

    A word is removed if a window of ``window`` words that covers it starts anywhere else too, in the same document
    or another; all windows are judged on the input. ``kept`` is the words that stay, joined by one space; ``repeats``
    lists the removed stretches as [first word, one past the last word]. Null texts count as empty; repeated rows are
    documents of their own; other columns are ignored. ``chunks`` overrides the number that follows from the size.
    """
    block, size = (window + 1) // 2, text_bytes(docs)
    buckets = max(8, -(-size // BUCKET))
    rows = chunked(docs, chunks or chunks_for(size, CHUNK))

    def scan(part: pa.Table) -> pa.Table:
        keys, flags = [np.zeros(0, U)], [np.zeros(0, bool)]
        for _, slab in slabs(part["text"].to_pylist()):
            at, hashes = slab.windows(block, _WORD18)
            keys.append(_short(hashes, buckets))
            flags.append((at - slab.first[slab.doc[at]]) % block == 0)
        keys, flags = np.concatenate(keys), np.concatenate(flags)
        if not len(keys):
            return _no_blobs()
        keys, _, marks = _distinct(keys, None, flags)
        return _blobs(part["chunk"][0].as_py(), keys & U(0xFFFFFFFF), None, marks, keys >> U(32), np.uint32)

    def near(slab: Slab, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and digests of the windows that contain an anchor."""
        at, hashes = slab.windows(block, _WORD18)
        hit = np.zeros(len(slab.hash) + 1, np.int32)
        hit[at[_among(_short(hashes, buckets), anchors)]] = 1
        before = np.concatenate(([0], np.cumsum(hit)))
        at, hashes = slab.windows(window, _WORD35)
        good = before[at + window - block + 1] > before[at]
        return hashes[good], slab.digests(at[good], window)

    def extend(part: pa.Table, answer: pa.Table) -> pa.Table:
        told = _told(answer, np.uint32) if part.num_rows else []
        if not told:
            return _no_blobs()
        anchors = np.concatenate([U(b) << U(32) | keys.astype(U) for b, keys, _ in told])
        found = [near(s, anchors) for _, s in slabs(part["text"].to_pylist())]
        keys, rest = (np.concatenate(x) for x in zip(*found))
        if not len(keys):
            return _no_blobs()
        keys, rest, marks = _distinct(keys, rest, None)
        return _blobs(part["chunk"][0].as_py(), keys, rest, marks, _bucket(keys, buckets), U)

    def remove(part: pa.Table, answer: pa.Table) -> pa.Table:
        texts = part["text"].to_pylist()
        told = _told(answer, U)  # buckets ascend with the hash
        repeated, rest = (np.concatenate([np.zeros(0, U), *(t[i] for t in told)]) for i in (1, 2))
        words, removed, kept, spans = [0] * len(texts), [0] * len(texts), [""] * len(texts), [[] for _ in texts]
        for group, slab in slabs(texts):
            gone = np.zeros(len(slab.hash) + 1, np.int32)
            if len(repeated):
                at, hashes = slab.windows(window, _WORD35)
                some = _among(hashes, repeated)
                at, hashes = at[some], hashes[some]
                at = at[_pairs_among(hashes, slab.digests(at, window), repeated, rest)]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            for k, i in enumerate(group):
                a, b = slab.first[k], slab.first[k + 1]
                mine, own = gone[a:b], (texts[i] or b"").split()
                words[i], removed[i] = len(own), int(mine.sum())
                if removed[i]:
                    edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    spans[i] = edges.tolist()
                    starts = [0, *edges[:, 1].tolist()]
                    own = [w for x, y in zip(starts, [*edges[:, 0].tolist(), len(own)]) for w in own[x:y]]
                kept[i] = b" ".join(own).decode("utf-8", "replace")
        return pa.table(
            {
                "doc_id": part["doc_id"],
                "n_words": pa.array(words, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.string()),
                "repeats": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            }
        )

    by_chunk = rows.groupBy("chunk")
    probes = by_chunk.applyInArrow(scan, BLOBS)
    anchors = probes.groupBy("bucket").applyInArrow(_answers(np.uint32, True), ANSWER)
    candidates = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(extend, BLOBS)
    repeats = candidates.groupBy("bucket").applyInArrow(_answers(np.uint64, False), ANSWER)
    result = "doc_id long, n_words long, n_removed long, kept string, repeats array<array<long>>"
    return by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(remove, result)


def op4_substring(spark, sf_dir) -> DataFrame:
    """All documents without the 35-word passages that occur more than once."""
    from chronolith.llm.common import table

    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
