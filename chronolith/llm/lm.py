"""Language-model scoring with a gated recurrent network in NumPy.

The model is a GRU over words with a class-factored softmax: log P(word) = log P(class) + log P(word | class), classes
being bands of equal mass by frequency. Words outside its vocabulary share one unknown word, divided further by their
counts. Training is truncated backpropagation: windows of all training documents, whole, run side by side, the state is
carried from window to window, gradients stop at the border.

Documents are dealt by a hash of their content into chunks of about CHUNK bytes, whose number follows the input's size,
and stand in each chunk in an order of their own, so the model does not depend on how the input is split. The chunks of
a round train from its common start, one epoch over all tokens in ROUNDS rounds, and their parameters are averaged,
weighted by tokens, up a tree of bounded fan-in.

Scoring carries the state over the windows of a document, so the log-likelihood is that of the whole document. Texts are
split once: a chunk's documents go on as codes of its distinct words. Word counts come from all training documents: chunks
send their words with their counts to buckets of words, which add them up and answer each chunk.
"""

from __future__ import annotations

import heapq
import math
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import chunked, chunks_for, fold, ordered, text_bytes, written

#: Sizes of the model (fixed, whatever the input): words with the unknown one and the end, units of the state.
WORDS, UNITS = 2048, 24
UNKNOWN, END = 0, 1
#: Training: tokens of a window; documents side by side; rounds of averaging; blobs added up at once.
WINDOW, LANES, ROUNDS, FAN = 32, 128, 2, 16
#: So that arrays stay in a core's cache: tokens of a block of the classes' softmax, steps back at once, parameters moved
#: at once.
BLOCK, BACK, MOVED = 512, 4, 1 << 14
#: Bytes of text of a chunk, and of the text behind a bucket of words.
CHUNK, BUCKET = 16 << 20, 64 << 20


def classes(counts: np.ndarray) -> np.ndarray:
    """First word of each class (and one past the last), for words by falling count: bands of equal root mass."""
    mass = np.cumsum(np.sqrt(counts + 1.0))
    label = np.minimum((mass / mass[-1] * math.sqrt(len(counts))).astype(int), int(math.sqrt(len(counts))) - 1)
    return np.concatenate(([0], np.flatnonzero(np.diff(label)) + 1, [len(counts)]))


def start(words: int, borders: np.ndarray, units: int = UNITS, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    zeros = lambda *shape: np.zeros(shape, np.float32)
    n = len(borders) - 1
    return {"x": draw(words, 3 * units), "u": draw(3 * units, units), "b": zeros(3 * units), "c": draw(n, units), "cb": zeros(n), "w": draw(words, units), "wb": zeros(words)}


def step(u, a, h, into=None):
    """One GRU step of states h (units, lanes) on inputs a (3 units, lanes): the next states, the gates (one less the
    first, and the second), the proposal and u @ h; into holds arrays for them."""
    n = len(h)
    out, gates, new, g = into or (np.empty(shape, u.dtype) for shape in (h.shape, (2 * n, h.shape[1]), h.shape, (3 * n, h.shape[1])))
    np.dot(u, h, out=g)
    np.add(a[: 2 * n], g[: 2 * n], out=gates)
    np.negative(gates[n:], out=gates[n:])
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[n:], g[2 * n :], out=new)
    new += a[2 * n :]
    np.tanh(new, out=new)
    np.subtract(new, h, out=out)
    out *= gates[:n]
    out += h
    return out, gates, new, g


def small(p, h) -> bool:
    """Whether p @ h.T stays where float32 holds its exponentials and the sums of some thousand of them."""
    return max(1.0, float(h.max()), -float(h.min())) * float(np.abs(p).sum(1).max()) < 75


def chosen(x, at, total, lift, differentiate):
    """The elements of x at flat places, one a column, less what lift takes off a column; x becomes its exponential and
    total the sums of its columns. With differentiate, x is then the gradient of the negative log softmax there."""
    if lift:
        x -= x.max(0)
    flat = x.reshape(-1)
    picked = flat.take(at)
    np.exp(x, out=x)
    np.add.reduce(x, 0, out=total)
    if differentiate:
        x /= total
        flat[at] -= 1
    return picked


def outputs(p, borders, h, words, grads=None):
    """Natural log probability of each word after each state, h (tokens, units); with grads, also adds the loss's
    gradients and returns that of the states. A last unit that is 1 meets the biases."""
    size, n = h.shape
    if not size:
        return np.zeros(0, h.dtype) if grads is None else (np.zeros(0, h.dtype), np.zeros_like(h))
    one = np.empty((size, n + 1), h.dtype)
    one[:, :n], one[:, n] = h, 1
    top, low = np.column_stack((p["c"], p["cb"])), np.column_stack((p["w"], p["wb"]))
    cls = np.repeat(np.arange(len(borders) - 1, dtype=np.int16), np.diff(borders))[words]
    places, total, lift, differentiate = np.arange(size), np.empty(size, h.dtype), not small(top, one), grads is not None
    out, dh = np.empty(size, h.dtype), np.empty(h.shape if differentiate else 0, h.dtype)
    for i in range(0, size, BLOCK):
        some = one[i : i + BLOCK]
        d = np.dot(top, some.T)
        out[i : i + BLOCK] = chosen(d, cls[i : i + BLOCK] * np.int64(len(some)) + places[: len(some)], total[i : i + BLOCK], lift, differentiate)
        if differentiate:
            more = d @ some
            grads["c"] += more[:, :n]
            grads["cb"] += more[:, n]
            np.dot(d.T, p["c"], out=dh[i : i + BLOCK])
    out -= np.log(total)
    order = np.argsort(cls, kind="stable")
    own, own_cls = one.take(order, 0), cls[order]
    cuts = np.searchsorted(own_cls, np.arange(len(borders)))
    # place of each word in its class's block of (words, tokens)
    at = (words[order] - borders[own_cls]) * np.diff(cuts)[own_cls] + places - cuts[own_cls]
    logs, lift = np.zeros(size, h.dtype), not small(low, one)
    total[:] = 1
    if differentiate:
        own_dh, more = np.zeros_like(h), np.zeros_like(low)
    for k in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(borders) > 1)).tolist():
        i, j, a, b = cuts[k], cuts[k + 1], borders[k], borders[k + 1]
        d = np.dot(low[a:b], own[i:j].T)
        logs[i:j] = chosen(d, at[i:j], total[i:j], lift, differentiate)
        if differentiate:
            np.dot(d, own[i:j], out=more[a:b])
            np.dot(d.T, p["w"][a:b], out=own_dh[i:j])
    logs -= np.log(total)
    back = np.empty_like(order)
    back[order] = places
    out += logs.take(back)
    if grads is None:
        return out
    grads["w"] += more[:, :n]
    grads["wb"] += more[:, n]
    dh += own_dh.take(back, 0)
    return out, dh


def flat(states):
    """(time, units, lanes) as (time * lanes, units)."""
    return np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, states.shape[1])


def forward(p, inputs, h, keep=True):
    """States (time, units, lanes) after each input of a window (time, lanes), those before, and what each step kept
    (the last step alone, unless all are kept).

    A document starts, from the zero state, behind every END.
    """
    (steps, lanes), n, every, kind = inputs.shape, len(h), inputs.shape[0] if keep else 1, p["u"].dtype
    states, befores, gates, new, kept = (np.empty((k, m * n, lanes), kind) for k, m in ((steps, 1), (every, 1), (every, 2), (every, 1), (every, 1)))
    a, g, bias, fresh = np.empty((3 * n, lanes), kind), np.empty((3 * n, lanes), kind), p["b"][:, None], inputs == END
    some = fresh.any(1).tolist()
    for t in range(steps):
        i = t % every
        befores[i] = h
        if some[t]:
            befores[i][:, fresh[t]] = 0
        h = states[t]
        np.add(p["x"].take(inputs[t], 0).T, bias, out=a)
        step(p["u"], a, befores[i], (h, gates[i], new[i], g))
        if keep:
            kept[i] = g[2 * n :]
    return states, befores, (gates, new, kept)


def sums_by(ids, rows, words, few=16):
    """The ids below words that occur and the sums of their rows: ids of many rows one by one, others side by side."""
    order = np.argsort(ids.astype(np.int16 if words < 1 << 15 else np.int32), kind="stable")
    own = ids[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    n = np.diff(first, append=len(own))
    turn = np.argsort(-n, kind="stable")
    first, n = first[turn], n[turn]
    sums, many = rows.take(order[first], 0), int((n > few).sum())
    for k in range(many):
        np.add.reduce(rows.take(order[first[k] : first[k] + n[k]], 0), 0, out=sums[k])
    for j in range(1, few):
        more = int(np.searchsorted(-n, -j))
        if more <= many:
            break
        sums[many:more] += rows.take(order[first[many:more] + j], 0)
    return own[first], sums


def window_gradients(p, borders, inputs, words, h, valid=None):
    """Loss, gradients and last states of one window: inputs and words are (time, lanes), states (units, lanes).

    Places that are not valid hold no token.
    """
    (steps, lanes), n = inputs.shape, len(h)
    states, befores, (gates, new, g) = forward(p, inputs, h)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    after = flat(states)
    if valid is None:
        logp, back = outputs(p, borders, after, words.ravel(), grads)
    else:
        at, back = np.flatnonzero(valid.ravel()), np.zeros_like(after)
        logp, back[at] = outputs(p, borders, after[at], words.ravel()[at], grads)
    back = np.ascontiguousarray(back.reshape(steps, lanes, n).transpose(0, 2, 1))
    down, fresh = np.ascontiguousarray(p["u"].T), inputs == END
    dh, some, rows = np.zeros((n, lanes), h.dtype), fresh.any(1).tolist(), np.empty((steps, lanes, 3 * n), h.dtype)
    held = np.empty((BACK, 5, n, lanes), h.dtype)
    for b in range(steps, 0, -BACK):
        a = max(0, b - BACK)
        # what a state's gradient is multiplied by for: both gates' inputs, the proposal's part of u @ h, the state before
        # (without u), the proposal's input
        by, keeps, r = held[: b - a], gates[a:b, :n], gates[a:b, n:]
        up = by.reshape(b - a, 5 * n, lanes)
        np.subtract(1, keeps, out=by[:, 3])
        np.subtract(befores[a:b], new[a:b], out=by[:, 0])
        by[:, 0] *= by[:, 3]
        by[:, 0] *= keeps
        np.multiply(new[a:b], new[a:b], out=by[:, 4])
        np.subtract(1, by[:, 4], out=by[:, 4])
        by[:, 4] *= keeps
        np.multiply(by[:, 4], r, out=by[:, 2])
        np.subtract(1, r, out=by[:, 1])
        by[:, 1] *= by[:, 2]
        by[:, 1] *= g[a:b]
        for t in range(b - 1, a - 1, -1):
            back[t] += dh
            by[t - a] *= back[t]
            np.dot(down, up[t - a, : 3 * n], out=dh)
            dh += by[t - a, 3]
            if some[t]:
                dh[:, fresh[t]] = 0
        grads["u"] += np.matmul(up[:, : 3 * n], befores[a:b].transpose(0, 2, 1)).sum(0)
        rows[a:b, :, : 2 * n] = up[:, : 2 * n].transpose(0, 2, 1)
        rows[a:b, :, 2 * n :] = by[:, 4].transpose(0, 2, 1)
    own, sums = sums_by(inputs.ravel(), rows.reshape(-1, 3 * n), len(p["x"]))
    grads["x"][own] = sums
    grads["b"] += sums.sum(0)
    return -float(logp.sum()), grads, states[-1]


class Adam:
    def __init__(self, p, rate=0.01):
        self.m, self.v, self.t, self.rate = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0, rate

    def apply(self, p, grads, scale):
        """Moves the parameters; overwrites grads. The means are kept as sums: ten times m, fifty times v."""
        self.t += 1
        rate = self.rate * 0.1 / math.sqrt(0.02) * math.sqrt(1 - 0.98**self.t) / (1 - 0.9**self.t)
        for k in grads:
            whole = [x.reshape(-1) for x in (p[k], grads[k], self.m[k], self.v[k])]
            for at in range(0, len(whole[0]), MOVED):
                x, g, m, v = (y[at : at + MOVED] for y in whole)
                g *= scale
                if max(g.max(), -g.min()) > 5:
                    np.clip(g, -5, 5, out=g)
                m *= 0.9
                m += g
                g *= g
                v *= 0.98
                v += g
                np.sqrt(v, out=g)
                g += 1e-6 / math.sqrt(0.02)
                np.divide(m, g, out=g)
                g *= rate
                x -= g


def dealt(documents: list[np.ndarray], lanes: int = LANES) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Whole documents (ids that end in END) laid end to end in lanes, each in the shortest lane when its turn comes:
    the ids (time, lanes), the lanes' lengths, which fall, and the numbers of each lane's documents."""
    lanes = max(1, min(lanes, len(documents)))
    heap, own = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i, d in enumerate(documents):
        size, k = heap[0]
        own[k].append(i)
        heapq.heapreplace(heap, (size + len(d), k))
    own.sort(key=lambda o: -sum(len(documents[i]) for i in o))
    sizes = np.array([sum(len(documents[i]) for i in o) for o in own], np.int64)
    words = np.full((lanes, sizes[0]), END, np.int32)
    for k, o in enumerate(own):
        if o:
            words[k, : sizes[k]] = np.concatenate([documents[i] for i in o])
    return np.ascontiguousarray(words.T), sizes, own


def windows(words: np.ndarray, sizes: np.ndarray, steps: int = WINDOW):
    """(first time, inputs, words, valid) of each window over the lanes that still have tokens; every token comes once.
    The input of a token is the one before it, END at the start; valid is None where all places hold tokens."""
    for a in range(0, len(words), steps):
        b, m = min(len(words), a + steps), int((sizes > a).sum())
        if not m:
            return
        before = words[a - 1 : a, :m] if a else np.full((1, m), END, np.int32)
        valid = None if sizes[m - 1] >= b else np.arange(a, b)[:, None] < sizes[:m]
        yield a, np.concatenate((before, words[a : b - 1, :m])), words[a:b, :m], valid


def train(p, borders, documents: list[np.ndarray], optimiser: Adam) -> int:
    """One pass over whole documents (ids that end in END), the longest first; returns the number of tokens.

    Windows of few lanes, at the end, add up to a quarter of a full one before they move the parameters.
    """
    if not documents:
        return 0
    words, sizes, _ = dealt(sorted(documents, key=lambda d: -(len(d) // 512)))
    h, held, n, done = np.zeros((p["u"].shape[1], words.shape[1]), np.float32), None, 0, 0
    for _, inputs, own, valid in windows(words, sizes):
        _, grads, h = window_gradients(p, borders, inputs, own, h[:, : own.shape[1]], valid)
        held = grads if held is None else {k: held[k] + g for k, g in grads.items()}
        some = own.size if valid is None else int(valid.sum())
        n, done = n + some, done + some
        if n >= LANES * WINDOW // 4:
            optimiser.apply(p, held, 1 / n)
            held, n = None, 0
    if n:
        optimiser.apply(p, held, 1 / n)
    return done


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of the words of binary texts, A-Z lower-cased, with 0 behind each text for its end; where each text's codes
    begin (and one past the last); the distinct words, the first with code 1. A null text has the end alone."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null(b"").view(pa.string())))
    words = split.values
    real = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty word there
    found = words.filter(pa.array(real)).view(pa.binary()).dictionary_encode()
    ends = np.concatenate(([0], np.cumsum(real)))[split.offsets.to_numpy()]
    codes = np.insert(found.indices.to_numpy() + np.int32(1), ends[1:], np.int32(0))
    return codes, ends + np.arange(len(ends)), found.dictionary.to_pylist()


def log_likelihoods(p, borders, documents: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """Natural log-likelihood of each document (ids that end in END), the state carried from its first token to its last."""
    total = np.zeros(len(documents))
    if not documents:
        return total
    turn = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    words, sizes, own = dealt([documents[i] for i in turn], lanes)
    h, logs = np.zeros((p["u"].shape[1], words.shape[1]), np.float32), np.zeros(words.shape)
    held, n = [], 0
    for a, inputs, some, _ in windows(words, sizes):
        states, _, _ = forward(p, inputs, h[:, : some.shape[1]], keep=False)
        h = states[-1]
        held.append((logs[a : a + len(some), : some.shape[1]], some, flat(states)))
        n += some.size
        if n >= LANES * WINDOW or a + WINDOW >= len(words):  # windows of few lanes, at the end, meet the softmax together
            found = outputs(p, borders, np.concatenate([x for *_, x in held]), np.concatenate([x.ravel() for _, x, _ in held]))
            for (at, x, _), got in zip(held, np.split(found, np.cumsum([x.size for _, x, _ in held])[:-1])):
                at[:] = got.reshape(x.shape)
            held, n = [], 0
    for k, o in enumerate(own):
        mine = [turn[i] for i in o]
        first = np.cumsum([0, *(len(documents[i]) for i in mine)])[:-1]
        total[mine] = np.add.reduceat(logs[: sizes[k], k], first)
    return total


# Coded chunks: texts are split into words once, and go on as numbers of their chunk's words.

CODED = "chunk int, place int, doc_id long, trains boolean, words binary, codes binary, counts binary"
COUNTS = "bucket int, chunk int, words binary, counts binary"


def _packed(x: np.ndarray) -> bytes:
    """Integers as byte planes, which files compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unpacked(data: bytes, dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _by_bucket(words: list[bytes], buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions of its words) for each bucket that has words."""
    label = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
    order = np.argsort(label.astype(np.int16 if buckets < 1 << 15 else np.int32), kind="stable")
    cuts = np.searchsorted(label[order], np.arange(buckets + 1))
    return [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def coded(docs: DataFrame, chunks: int, buckets: int = 1) -> DataFrame:
    """CODED: the documents of each chunk by place, as codes of their tokens, with 0 for the end; and at place -1 - b the
    chunk's distinct words of bucket b with their codes and their counts in the chunk's documents that train."""
    rows = chunked(docs, chunks)

    def code(part: pa.Table) -> pa.Table:
        part = ordered(part)
        trains = [d is None or zlib.crc32(str(d).encode()) % 5 != 1 for d in part["doc_id"].to_pylist()]
        codes, cuts, words = numbered(pa.concat_arrays(part["text"].chunks))
        pa.default_memory_pool().release_unused()
        counts = np.bincount(codes[np.repeat(trains, np.diff(cuts))], minlength=len(words) + 1)
        codes = np.split(codes, cuts[1:-1])
        got, n = _by_bucket(words, buckets), len(codes)
        return pa.table(
            {
                "chunk": pa.array([part["chunk"][0].as_py()] * (n + len(got)), pa.int32()),
                "place": pa.array([*range(n), *(-1 - b for b, _ in got)], pa.int32()),
                "doc_id": pa.array([*part["doc_id"].to_pylist(), *[None] * len(got)], pa.int64()),
                "trains": pa.array([*trains, *[None] * len(got)], pa.bool_()),
                "words": pa.array([*[None] * n, *(b"\n".join(map(words.__getitem__, at.tolist())) for _, at in got)], pa.binary()),
                "codes": pa.array([*map(_packed, codes), *(_packed((at + 1).astype(np.int32)) for _, at in got)], pa.binary()),
                "counts": pa.array([*[None] * n, *(_packed(counts[at + 1]) for _, at in got)], pa.binary()),
            }
        )

    return rows.groupBy("chunk").applyInArrow(code, CODED)


def _of_chunk(part: pa.Table, value) -> tuple[pa.Table, np.ndarray]:
    """The documents of a coded chunk by their place, and for each code what value gives for the words (0 for the end)."""
    part = part.sort_by("place")
    places = part["place"].to_numpy()
    least = int(np.searchsorted(places, 0))
    rows = [(-1 - k, words.split(b"\n"), _unpacked(codes, np.int32)) for k, words, codes in zip(places[:least].tolist(), part["words"][:least].to_pylist(), part["codes"][:least].to_pylist())]
    out = np.zeros(1 + sum(len(at) for _, _, at in rows), np.int64)
    for bucket, words, at in rows:
        out[at] = value(bucket, words)
    return part.slice(least), out


def count_words(rows: DataFrame) -> DataFrame:
    """COUNTS of coded chunks. Rows without a chunk hold the distinct words of a bucket with their counts in all documents
    that train; others hold, for a chunk's words of a bucket in their order there, those same counts."""
    asked = rows.filter("place < 0").select((-1 - F.col("place")).alias("bucket"), "chunk", "words", "counts")

    def add(part: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        for ws, ns in zip(part["words"], part["counts"]):
            for w, n in zip(ws.as_py().split(b"\n"), _unpacked(ns.as_py(), np.int64).tolist()):
                if n:
                    counts[w] = counts.get(w, 0) + n
        told = [_packed(np.fromiter(map(counts.get, (words := ws.as_py().split(b"\n")), repeat(0)), np.int64, len(words))) for ws in part["words"]]
        chunk, words = part["chunk"].to_pylist(), [None] * len(told)
        if counts:
            ws = sorted(counts)
            chunk, words = [*chunk, None], [*words, b"\n".join(ws)]
            told.append(_packed(np.array([counts[w] for w in ws], np.int64)))
        return pa.table({"bucket": pa.array([part["bucket"][0].as_py()] * len(told), pa.int32()), "chunk": pa.array(chunk, pa.int32()), "words": pa.array(words, pa.binary()), "counts": pa.array(told, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(add, COUNTS)


def vocabulary(counts: DataFrame, size: int) -> tuple[list[tuple[bytes, int]], int, int]:
    """The commonest words with their counts, the number of all tokens and of distinct ones, without the end."""
    counts = counts.filter("chunk is null").select("words", "counts")

    def bins(ns):
        return (np.log2(ns) * 8).astype(np.int64)

    def spread(batches):
        for batch in batches:
            for ns in batch.column(1).to_pylist():
                ns = _unpacked(ns, np.int64)
                label, n = np.unique(bins(ns), return_counts=True)
                sums = np.bincount(np.searchsorted(label, bins(ns)), ns).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(n), pa.array(sums)], names=["bin", "n", "all"])

    # how many words have counts of each size, for a count that only about ``size`` words reach
    rows = counts.mapInArrow(spread, "bin long, n long, all long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("all").alias("all")).collect()
    least, reached = 0, 0
    for r in sorted(rows, key=lambda r: -r.bin):
        least, reached = r.bin, reached + r.n
        if reached >= size:
            break

    def common(batches):
        for batch in batches:
            for ws, ns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ns = _unpacked(ns, np.int64)
                some = np.flatnonzero(bins(ns) >= least)
                if len(some):
                    ws = ws.split(b"\n")
                    yield pa.RecordBatch.from_arrays([pa.array([ws[i] for i in some], pa.binary()), pa.array(ns[some])], names=["word", "n"])

    top = counts.mapInArrow(common, "word binary, n long").orderBy(F.desc("n"), "word").limit(size).collect()
    return [(bytes(r.word), r.n) for r in top], sum(r["all"] for r in rows), sum(r.n for r in rows)


def averaged(trained: DataFrame, blobs: int) -> np.ndarray | None:
    """The mean of the parameters in (chunk, weight, sum), added up in the order of chunks, FAN blobs at a time."""

    def add(part: pa.Table) -> pa.Table:
        part = part.sort_by("chunk")
        total = sum(np.frombuffer(x, np.float64) for x in part["sum"].to_pylist())
        return pa.table({"chunk": part["up"].slice(0, 1), "weight": pa.array([math.fsum(part["weight"].to_pylist())]), "sum": pa.array([total.tobytes()], pa.binary())})

    while blobs > 1:
        trained = trained.withColumn("up", (F.col("chunk") / FAN).cast("int")).groupBy("up").applyInArrow(add, "chunk int, weight double, sum binary")
        blobs = -(-blobs // FAN)
    got = trained.collect()
    return np.frombuffer(got[0].sum, np.float64) / got[0].weight if got else None


def fit(docs: DataFrame, known: list[tuple[bytes, int]], n_tokens: int, n_ends: int, chunks: int) -> tuple[dict, np.ndarray]:
    """Parameters and class borders, trained once on every token of every training document."""
    return fit_coded(coded(docs, chunks), known, n_tokens, n_ends, chunks)


def fit_coded(rows: DataFrame, known: list[tuple[bytes, int]], n_tokens: int, n_ends: int, chunks: int) -> tuple[dict, np.ndarray]:
    """fit, of coded chunks."""
    common = np.array([n for _, n in known], np.float64)
    counts = np.concatenate(([max(1.0, n_tokens - common.sum()), max(1.0, n_ends)], common))
    borders = classes(counts)
    sc = rows.sparkSession.sparkContext
    params = start(len(counts), borders)
    params["cb"] = np.log(np.add.reduceat(counts, borders[:-1]) / counts.sum()).astype(np.float32)
    params["wb"] = np.log(counts / np.add.reduceat(counts, borders[:-1])[np.searchsorted(borders, np.arange(len(counts)), "right") - 1]).astype(np.float32)
    vocab = sc.broadcast({w: i + 2 for i, (w, _) in enumerate(known)})
    rows = rows.filter("place < 0 or trains")

    def trainer(sent):
        def run(part: pa.Table) -> pa.Table:
            p, look, chunk = {k: v.copy() for k, v in sent.value.items()}, vocab.value, part["chunk"][0].as_py()
            part, model = _of_chunk(part, lambda _, words: np.fromiter(map(look.get, words, repeat(UNKNOWN)), np.int32, len(words)))
            model[0] = END
            model = model.astype(np.int32)
            documents = [model[_unpacked(codes, np.int32)] for codes in part["codes"].to_pylist()]
            done = train(p, borders, documents, Adam(p))
            whole = np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float64) * done
            return pa.table({"chunk": pa.array([chunk], pa.int32()), "weight": pa.array([float(done)]), "sum": pa.array([whole.tobytes()], pa.binary())})

        return run

    for turn in range(ROUNDS):
        own = rows.filter(F.col("chunk") % ROUNDS == turn).groupBy("chunk")
        trained = own.applyInArrow(trainer(sc.broadcast(params)), "chunk int, weight double, sum binary").filter("weight > 0")
        mean = averaged(trained, chunks)
        if mean is not None:
            parts = np.split(mean, np.cumsum([params[k].size for k in sorted(params)])[:-1])
            params = {k: x.astype(np.float32).reshape(params[k].shape) for k, x in zip(sorted(params), parts)}
    return params, borders


def score(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are the words of the whole text, A-Z lower-cased, and one end. Documents with crc32(doc_id as text) mod 5
    = 1 are held out of all learning. base_score adds log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens; score is
    the model's log10 probability of the whole text with its end. A null text counts as empty (the end alone);
    a null id trains. The model, and so every score, depends on the rows alone, not on how they are split. With nothing to learn from, the model is its start. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = text_bytes(docs)
    chunks, buckets = chunks_for(size, CHUNK), max(8, -(-size // BUCKET))
    rows = written(coded(docs, chunks, buckets))
    counts = written(count_words(rows))
    n_ends = docs.filter(F.coalesce(fold(), F.lit(-1)) != 1).count()
    known, n_words, n_distinct = vocabulary(counts, words - 2)
    params, borders = fit_coded(rows, known, n_words, n_ends, chunks)
    n_all, v_all = n_words + n_ends, n_distinct + (n_ends > 0)
    rare_n, rare_v = n_words - sum(n for _, n in known), n_distinct - len(known)
    sent = spark.sparkContext.broadcast((params, borders, {w: i + 2 for i, (w, _) in enumerate(known)}))

    def finish(part: pa.Table, told: pa.Table) -> pa.Table:
        p, cuts, ids = sent.value
        unit = math.log10(n_all + 0.5 * (v_all + 1))
        spread = math.log10(rare_n + 0.5 * (rare_v + 1))
        by_bucket = dict(zip(told["bucket"].to_pylist(), told["counts"].to_pylist()))
        _, counts = _of_chunk(part, lambda bucket, _: _unpacked(by_bucket[bucket], np.int64))
        part, model = _of_chunk(part, lambda _, words: np.fromiter(map(ids.get, words, repeat(UNKNOWN)), np.int32, len(words)))
        counts[0], model[0] = n_ends, END
        model, seen, logs = model.astype(np.int32), (counts > 0).astype(np.int64), np.log10(counts + 0.5)
        strange = np.where(model == UNKNOWN, logs - spread, 0.0)
        codes = [_unpacked(x, np.int32) for x in part["codes"].to_pylist()]
        n = np.array([len(c) for c in codes], np.int64)
        total = log_likelihoods(p, cuts, [model[c] for c in codes]) / math.log(10)
        known_n, base, rare = (np.array([x[c].sum() for c in codes]) for x in (seen, logs, strange))
        return pa.table(
            {"doc_id": part["doc_id"], "n_tokens": n, "n_known": known_n, "train_tokens": np.full(len(n), n_all), "base_score": base - n * unit, "score": total + rare}
        )

    result = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(counts.filter("chunk is not null").select("chunk", "bucket", "counts").groupBy("chunk")).applyInArrow(finish, result)


def op9_lm(spark, sf_dir) -> DataFrame:
    """All documents with score; held_out is false for a null id, which trains."""
    from chronolith.llm.common import table

    found = score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
