import public_tokenizers
import tiktoken
import base64
import re

import corpus_pipeline
from chronolith.llm import pii
from tests.llm import plain


def firsts(rows):
    """One row of each group of texts that share 0.8 of their five-word shingles: the first by id (null last) and value."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r.text or "").lower().split()) else set() for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(tuple(r))
    order = lambda r: (r[0] is None, r[0] or 0, *((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r[1:]))
    return sorted((min(g, key=order) for g in groups.values()), key=repr)


def test_no_document_is_lost_to_its_id(spark):
    import random

    rnd = random.Random(4)
    text = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    near = text(100).split()
    edited = " ".join([*near[:50], "changed", *near[51:]])
    rows = [(None, text(60), "en", "a"), (None, text(60), "en", "a"), (None, text(60), None, "a"), (7, text(60), "en", "a"), (7, text(60), "de", None), (8, text(60), "en", "a")]
    assert len(keep(spark, rows)) == 6
    rows += [rows[0], rows[3], (9, rows[3][1], "fr", "b"), (None, " ".join(near), "en", "a"), (12, edited, "en", "a"), (11, edited, "en", "z"), (11, edited, "en", "b"), (11, " ".join(near), "en", "c"), (20, None, None, None), (19, "", "en", None)]
    got = keep(spark, rows)
    assert len(got) == 8
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        assert keep(spark, rows) == got


def keep(spark, rows):
    docs = plain.awkward(spark, rows)
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == firsts(docs.select(*corpus_pipeline.COLUMNS).collect())
    return got


def test_stages_against_brute_force(spark, tmp_path):
    import random

    rnd = random.Random(0)
    text = lambda n: " ".join(rnd.choice(("the", "house", "of", "old", "sea", "man", "by", "and")) + str(rnd.randrange(500)) for _ in range(n))
    rows = [(i, text(200), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, rows[0][1], "en", "s1"), (101, rows[0][1], "en", "s2"), (102, "12 34", "en", "s0"), (103, None, None, None), (104, "write to a.b@example.com " + text(100), None, None), (5, rows[5][1], "en", "s2")]
    df = plain.awkward(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append(docs.collect())
        if n < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    first = sorted(r.doc_id for r in kept[0])
    assert first == sorted(i for i, t, _, _ in rows if t and re.search("[a-z]", t))
    assert sorted(map(tuple, kept[1]), key=repr) == firsts(kept[0])
    assert {r.doc_id for r in kept[2]} == {r.doc_id for r in kept[1]}
    assert all(not pii.base(r.text) for r in kept[2]) and any("[EMAIL]" in r.text for r in kept[2])
    words = {r.doc_id: r.text.split() for r in kept[2]}
    for r in kept[3]:
        assert set(r.text.split()) <= set(words[r.doc_id])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, library.encode_ordinary(r.text)) for r in kept[3]) == sorted((r.doc_id, list(r.ids)) for r in kept[4])
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(kept[4])


def test_without_labels_texts_with_letters_stay(spark):
    rows = [(1, "some words", None, None), (2, "12 34", None, None), (3, None, None, None)]
    got = corpus_pipeline.language(spark, plain.awkward(spark, rows), "").collect()
    assert [(r.doc_id, r.lang) for r in got] == [(1, None)]


def test_empty_table(spark, tmp_path):
    plain.awkward(spark, [(1, "x", "en", "s")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
