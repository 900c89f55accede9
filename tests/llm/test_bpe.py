import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from chronolith.llm import bpe
from tests.llm import plain

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(reference, rows):
    out = []
    for doc_id, text in rows:
        ids = reference.encode_ordinary(text or "")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        out.append((doc_id, len(ids), digest(",".join(map(str, ids)).encode()), digest((text or "").encode())))
    return sorted(out, key=repr)


def test_table_against_library(spark, sf_dir, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in bpe.digests(bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN)).collect()), key=repr)
    assert got == expected(reference, [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_awkward_rows(spark, reference):
    rnd = random.Random(1)
    parts = ["a", "é", " ", "\n", "12", "'s", "日本", "🙂", "\x1c", "\x85", " ", "the", "###", "​", "<|endoftext|>"]
    rows = [(None, None), (1, ""), (2, "x" * 20000), (3, "ab" * 9999), (4, " " * 5000), (4, " " * 5000)]
    rows += [(i, "".join(rnd.choices(parts, k=40))) for i in range(300)]
    df = plain.awkward(spark, [(i, t, None, None) for i, t in rows])
    encoded = bpe.encode_decode(df, PATH, public_tokenizers.PATTERN)
    assert sorted((tuple(r) for r in bpe.digests(encoded).collect()), key=repr) == expected(reference, rows)
    assert bpe.encode_decode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_every_reachable_token_encodes_to_itself():
    tokenizer = bpe.Tokenizer(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    for token in random.Random(0).sample(sorted(tokenizer.tokens), 2000):
        assert tokenizer.encode_piece(tokenizer.tokens[token]) == [token]
