import zlib

from chronolith.llm import langid
from tests.llm import plain


def longest_matches(text, sample):
    """Phrases of a greedy parse, by plain search."""
    phrases, at = 1, 0
    for i in range(len(text)):
        if text[at : i + 1] not in sample:
            phrases, at = phrases + 1, i
            if text[i] not in sample:
                at = i + 1
    return phrases


def test_phrases_against_plain_search():
    samples = {"a": "the cat sat on the mat and the dog", "b": "le chat est sur la natte avec le chien"}
    model = langid.Model(samples)
    texts = ["the mat sat", "le chien le chat", "zzzz", "", "on la qqq cat"]
    got = model.phrases(texts)
    for n, t in enumerate(texts):
        if t:
            assert got[n].tolist() == [longest_matches(t, samples[x]) for x in ("a", "b")]
    assert model.phrases([texts[0] * 500])[0, 0] > 0


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_ignores_labels_of_its_row_and_source(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 'xx', lang) as lang", "'s' as source")
    key = lambda df: sorted(map(tuple, langid.identify(df).collect()))
    assert key(docs) == key(other)


def test_awkward_rows(spark):
    rows = [(i, "the house of the old man by the sea " * 20, "en", None) for i in range(1, 9)]
    rows += [(i, "das haus des alten mannes an der see " * 20, "de", None) for i in range(11, 19)]
    extra = [(30, None, "en", None), (31, "", "de", None), (32, "12 34 !?", None, None), (None, "the old house", None, None), (34, "der alte mann " * 30000, None, None), (34, "der alte mann", "de", None), (34, "der alte mann", "de", None)]
    df = plain.awkward(spark, rows + extra).withColumnRenamed("fp", "score")
    got = {}
    for r in langid.identify(df).collect():
        got.setdefault(r.doc_id, []).append(r.lang_pred)
    assert [got[i] for i in (30, 31, 32)] == [["und"]] * 3
    assert got[34] == ["de"] * 3 and got[None] == ["en"]
    assert langid.identify(df.limit(0)).collect() == []
    nothing = df.withColumn("lang", df.lang.substr(100, 1)).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und", None}


def test_labels_against_plain_search(spark):
    import math
    import random

    rnd = random.Random(8)
    words = {"en": "the house of old man sea by and was".split(), "de": "das haus des alten mannes see und war".split(), "fr": "la maison du vieil homme mer et le".split()}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randrange(1, 400))), lang, None) for i, lang in enumerate(list(words) * 20)]
    df = plain.awkward(spark, rows + [(500, "haus sea maison", None, None)] + [(7, rows[7][1], rows[7][2], None)] * 30)
    samples = langid.samples(df)
    for r in langid.identify(df).collect():
        text = next((t for i, t, *_ in rows if i == r.doc_id), "haus sea maison")
        cost = {}
        for lang, sample in samples.items():
            phrases = sum(longest_matches(text[i : i + langid.SEGMENT], sample) for i in range(0, len(text), langid.SEGMENT))
            cost[lang] = phrases * math.log2(len(sample)) / len(text)
        assert r.lang_pred == min(sorted(cost), key=cost.get)
        assert abs(r.score - (1 - sorted(cost.values())[0] / sorted(cost.values())[1])) < 1e-9


def test_the_sample_is_bounded_and_of_whole_texts(spark):
    long = "".join(chr(0x4E00 + i) for i in range(20_000))  # every character once
    rows = [(1, long, "zh", None)] + [(2, "one hot row", "en", None)] * 5000 + [(10 + i, f"text {i}", "en", None) for i in range(200)] + [(None, "no id", "xx", None)]
    got = langid.samples(plain.awkward(spark, rows))
    assert set(got) <= {"zh", "en", "xx"} and len(got["en"].split("\n")) == langid.SEGMENTS
    parts = got["zh"].split("\n")
    places = sorted(long.index(p[0]) for p in parts)
    assert all(p in long for p in parts) and len(parts) > 20 and places[-1] > 15_000  # not a prefix


def test_several_scripts_against_plain_search():
    import random

    rnd = random.Random(2)
    scripts = {"ar": (0x620, 40), "el": (0x3B1, 24), "en": (0x61, 26), "ja": (0x3041, 80), "ru": (0x430, 32), "xx": (0x20000, 300), "zh": (0x4E00, 2500)}
    text = lambda at, n, k: "".join(chr(at + int(n * rnd.random() ** 2)) + " " * (rnd.random() < 0.1) for _ in range(k))
    samples = {lang: text(*of, 3000).lower() for lang, of in scripts.items()}
    model = langid.Model(samples)
    texts, want = [], []
    for lang, of in scripts.items():
        for k in (4, 30, 200):
            at = rnd.randrange(2000)
            texts += [samples[lang][at : at + k], text(*of, k)]
            want += [lang] * 2
    texts.append("".join(t[:15] for t in texts))
    got = model.phrases(texts)
    for n, t in enumerate(texts):
        assert got[n].tolist() == [longest_matches(t.lower(), samples[x]) for x in model.languages]
    assert model.predict(texts[:-1])[0] == want


def test_repeated_rows_leave_the_sample_alone(spark):
    import random

    rnd = random.Random(3)
    words = lambda n, letters: " ".join("".join(rnd.choices(letters, k=5)) for _ in range(n))
    rows = [(1, words(30_000, "abcdef"), "aa", None)] + [(10 + i, words(20, "abcdef"), "aa", None) for i in range(200)]
    rows += [(400 + i, words(40, "ghijkl"), "bb", None) for i in range(50)]
    once = langid.samples(plain.awkward(spark, rows))
    assert once == langid.samples(plain.awkward(spark, rows + rows[:1] * 300 + [(1000 + i, rows[0][1], "aa", None) for i in range(50)]))
    assert len(once["aa"]) > 15_000 and set(once) == {"aa", "bb"}
    hot = plain.awkward(spark, [(1, rows[0][1], "aa", None)]).selectExpr("*", "explode(sequence(1, 400)) as copy").drop("copy")
    short = plain.awkward(spark, rows[1:])
    assert len(langid.samples(hot.unionByName(short.crossJoin(spark.range(10)).drop("id")))["aa"]) > 15_000
