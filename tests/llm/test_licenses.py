import random
import re

from chronolith.llm.licenses import NOTICES, PHRASES, Notice, Scanner, op12_licenses, scan
from tests.llm import plain

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def base(text):
    words = WORDS.findall(lower(text))
    out = []
    for label, phrase in PHRASES:
        own = phrase.split()
        out += [(label, i) for i in range(len(words)) if words[i : i + len(own)] == own]
    return len(words), sorted(out, key=lambda b: (b[1], b[0]))


def labels(text):
    """Labels of all notices that the whole text matches, without seeds."""
    joined = " ".join(WORDS.findall(lower(text))).encode().decode("latin-1")
    return {label for label, words in NOTICES if Notice(label, words).pattern.search(joined)}


def edited(rnd, words, edits):
    """A notice with some characters outside the brackets changed, dropped or doubled."""
    parts = re.split(r"([\[\]])", words)
    text = [(c, n % 4 == 0) for n, p in enumerate(parts) if p not in "[]" for c in p]
    for _ in range(edits):
        i = rnd.choice([i for i, (c, free) in enumerate(text) if free and c != " "] or [0])
        kind = rnd.randrange(3)
        text[i : i + 1] = [] if kind == 0 else [("q", True)] if kind == 1 else [text[i], ("q", True)]
    return "".join(c for c, _ in text)


def test_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op12_licenses(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in docs:
        n, places = base(r.text)
        g, own = got[r.doc_id], sorted({label for label, _ in places})
        assert (g.n_words, g.n_base, g.base_labels) == (n, len(places), ",".join(own))
        assert (g.first_word, g.last_word) == ((places[0][1], places[-1][1]) if places else (None, None))
        assert g.labels == ",".join(sorted(set(own) | labels(r.text)))
        assert 0 <= g.score <= 1 and (g.score > 0) == bool(g.labels)
    assert any("cc-by-nc" in r.labels for r in got.values())


def test_every_edited_notice_is_found():
    rnd, scanner, filler = random.Random(4), Scanner(), "the old tower über water was seen from afar".split()
    for _ in range(400):
        label, words = rnd.choice(NOTICES)
        notice = Notice(label, words)
        text = f"{' '.join(rnd.choices(filler, k=9))} {edited(rnd, words, rnd.randrange(notice.edits + 1))} {' '.join(rnd.choices(filler, k=9))}"
        text = " ".join(text.split())
        got = {m[0] for m in scanner.matches(text.encode().decode("latin-1"))}
        assert got == labels(text), text
        assert not scanner.matches(" ".join(rnd.choices(filler, k=60)).encode().decode("latin-1"))


def test_spans_point_into_the_text():
    text = "Ünïts — RELEASED under  teh MIT licence!\n(Licensed under CC BY-NC 4.0.)"
    n, places, spans = Scanner().scan(text.encode())
    assert n == 14 and not places
    assert [(s[0], text[s[1] : s[2]], s[3], s[4]) for s in spans] == [("mit", "RELEASED under  teh MIT licence", 2, 5), ("cc-by-nc", "Licensed under CC BY-NC 4.0", 7, 7)]
    assert spans[1][5] == 0 and 1 <= spans[0][5] <= 3


def test_what_tells_licenses_apart_is_not_edited():
    assert {m[0] for m in Scanner().matches("released under the mix license and licensed under cc by nd 4 0")} == set()
    assert {m[0] for m in Scanner().matches("the gnu lesser general public licence")} == {"lgpl"}


def test_awkward_rows(spark):
    many = "filler words here " * 40_000 + "Apache License " * 500 + "released under the MIT license " * 500
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "mit license mit-license MIT  License", None, "a"), (3, "mit license mit-license MIT  License", None, "a"), (None, "General.Public,License", "en", None), (4, many, "en", "a"), (5, "\x00 mitlicense öapache license", "en", "a")]
    got = sorted(((r.doc_id, r.n_words, [tuple(b) for b in r.base], len(r.spans)) for r in scan(plain.awkward(spark, rows)).collect()), key=repr)
    want = sorted(((i, *base(t), 500 if i == 4 else 0) for i, t, _, _ in rows), key=repr)
    assert got == want
    assert scan(plain.awkward(spark, rows).limit(0)).collect() == []
