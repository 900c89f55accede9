"""Byte-level BPE over a rank file, in linear time per piece.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over all reachable tokens finds the longest
token at every position of a piece in one pass. Encoding goes left to right with those longest tokens and backtracks
to shorter ones: a token may follow another only if the merges could not have joined across their boundary. That test
depends on the two tokens alone and is memoised; a position once abandoned is never tried again, so the work is
linear, and the result is the merge procedure's own.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import worker_model

#: Pieces longer than this are encoded without being remembered.
LONGEST_KEPT = 64
#: Entries of a worker's memory before it is emptied.
MOST_KEPT = 200_000


class Tokenizer:
    """Encoder and decoder over the text of a rank file: lines of a base64 token and its rank."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.tokens = {t: w for w, t in self.ids.items()}
        if any(self.tokens.get(t) is None or len(self.tokens[t]) != 1 for t in range(256)):
            raise ValueError("ranks 0 to 255 must be the single bytes")
        self.pieces = regex.compile(pattern)
        self.left, self.right, self.pairs = {}, {}, {}
        self.shorter: dict[int, int | None] = {}
        self.known: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t in sorted(self.tokens):
            self._add(t, self.tokens[t])
        self.known.clear()
        self.automaton.make_automaton()
        self.sizes = [len(self.tokens.get(t, b"")) for t in range(max(self.tokens) + 1)]
        self.memory = _Memory(self)

    def _add(self, token: int, word: bytes) -> None:
        if len(word) > 1:
            for cut in range(1, len(word)):
                a, b = self.ids.get(word[:cut], token), self.ids.get(word[cut:], token)
                if a < token and b < token and self.meets(a, b):
                    self.left[token], self.right[token], self.pairs[a << 24 | b] = a, b, token
                    break
            else:
                return  # no sequence of merges makes it: it can only be a whole piece
        self.automaton.add_word(word.decode("latin-1"), token)

    def meets(self, a: int, b: int) -> bool:
        """True if tokens a and b can stand side by side in the result of the merges."""
        limit = 1 << 62
        while True:
            whole = self.pairs.get(a << 24 | b)
            if whole is not None and whole < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:  # a was made later: look at the boundary before that
                limit, a = a, self.right.get(a, a)
                if a == limit:
                    return False
            else:  # equal ranks are merged from the left, so b was made later
                limit, b = b + 1, self.left.get(b, b)
                if b + 1 == limit:
                    return False

    def fits(self, a: int, b: int) -> bool:
        key = a << 24 | b
        got = self.known.get(key)
        if got is None:
            if len(self.known) > MOST_KEPT:
                self.known.clear()
            got = self.known[key] = self.meets(a, b)
        return got

    def prefix(self, token: int) -> int | None:
        """The longest reachable token that is a proper prefix of the token."""
        if token not in self.shorter:
            word = self.tokens[token]
            found = (self.ids.get(word[:n]) for n in range(len(word) - 1, 0, -1))
            self.shorter[token] = next((t for t in found if t is not None and (t < 256 or t in self.left)), None)
        return self.shorter[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        size, sizes, known = len(piece), self.sizes, self.known
        longest = [0] * size
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - sizes[token]] = token
        dead = None
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            while token is not None:
                end = at + sizes[token]
                if dead is None or not dead[end]:
                    if last < 0:
                        break
                    fits = known.get(last << 24 | token)
                    if fits or fits is None and self.fits(last, token):
                        break
                token = self.prefix(token)
            if token is None:
                dead = dead or bytearray(size + 1)
                dead[at] = 1
                at -= sizes[last]
                token = self.prefix(out.pop())
                last = out[-1] if out else -1
            else:
                out.append(token)
                if end == size:
                    return out
                at, last, token = end, token, longest[end]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memory.__getitem__, self.pieces.findall(text))), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Memory(dict):
    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> bytes:
        got = np.array(self.tokenizer.encode_piece(piece.encode()), np.int32).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) > MOST_KEPT:
                self.clear()
            self[piece] = got
        return got


def loaded(rank_file: bytes, pattern: str) -> Tokenizer:
    """The tokenizer, built once in each Python worker."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    return worker_model(("bpe", key), lambda: Tokenizer(rank_file, pattern))


def encode_decode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary): the token ids of each whole text and the bytes they decode to.

    A null text counts as empty and gives no ids. The rank file (of fixed size) is read on the driver and sent to
    the workers once. Rows stay where they are: there is no shuffle.
    """
    with open(rank_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        tokenizer = loaded(ranks.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                ids = [tokenizer.encode(t or "") for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                decoded = [tokenizer.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark, sf_dir) -> DataFrame:
    """Numbers and digests of every document's token ids, and of what they decode to."""
    import public_tokenizers

    from chronolith.llm.common import table

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))
