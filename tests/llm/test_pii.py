import random
import re

import numpy as np

from chronolith.llm import pii
from tests.llm import plain

#: The contract's patterns, as they stand.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def stated(text):
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()  # noqa: B023
            if good:
                out.append((kind, *m.span()))
    return out


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_base_against_stated_patterns(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert pii.base(r.text or "") == stated(r.text)
    rnd = random.Random(4)
    for _ in range(20000):
        text = "".join(rnd.choices(["a", "@", ".", "-", "1", "25", "4", " ", "+", "(", ")", "@b.c", "é", "%", "1.2.3.4", "4111111111111111"], k=rnd.randint(0, 25)))
        assert pii.base(text) == stated(text), text


def test_trees_learn_and_thresholds_hold():
    trees, thresholds = pii.model()
    x, y = pii.examples(3000, 99)
    score = trees.predict(x)
    chosen = score >= np.array([thresholds[int(k)] for k in x[:, 0]])
    assert y[chosen].mean() > 0.9 and chosen[y == 1].mean() > 0.85
    for k in range(len(pii.KINDS)):
        own = x[:, 0] == k
        assert y[own & chosen].mean() > 0.85, pii.KINDS[k]
    assert 0.2 < y.mean() < 0.8 and ((score > 0.1) & (score < 0.9)).sum() > 20  # the examples are not separable


def test_calibration_is_isotonic_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    score = rng.random(500).round(2)
    truth = (rng.random(500) < score).astype(float)
    least, level = pii.calibration(score, truth)
    assert (np.diff(level) > 0).all() and (np.diff(least) > 0).all()
    fitted = level[np.searchsorted(least, score, "right") - 1]
    assert abs(fitted.mean() - truth.mean()) < 1e-9
    assert ((fitted - truth) ** 2).sum() <= ((score - truth) ** 2).sum() + 1e-9


def test_added_spans_against_a_plain_version(spark, sf_dir):
    trees, thresholds = pii.model()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10**6 + i, t) for i, (t, _) in enumerate(pii.written(600, 5))]
    got, n = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(plain.awkward(spark, [(i, t, None, None) for i, t in docs])).collect()}, 0
    for doc_id, text in docs:
        spans = stated(text)
        some = [c for c in pii.loose(text or "") if all(c[2] <= a or b <= c[1] for _, a, b in spans)]
        scores = [float(trees.predict(np.array([pii.features(text, *c)]))[0]) for c in some]
        for score, c in sorted(zip(scores, some), key=lambda p: (-p[0], p[1][1], -p[1][2], p[1][0])):
            if score >= thresholds[pii.KINDS.index(c[0])] and all(c[2] <= a or b <= c[1] for _, a, b in spans):
                spans.append(c)
                n += 1
        assert got[doc_id] == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    assert n > 100


def test_secrets_of_the_table(spark):
    """Precision and recall on the table's secrets, which their form shows: token = "...", password=..., AKIA..."""
    found, known, right = 0, 0, 0
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.filter("text is not null").collect()}
    truth = {i: {m.span(1) for m in re.finditer(r"(?i)token = \"([0-9a-f]{40})\"|password=([0-9a-f]+)|\b(AKIA[0-9A-Z]{16})\b", t)} for i, t in texts.items()}
    for r in pii.find(docs).collect():
        own = {(s.start, s.end) for s in r.spans if s.kind == "secret"}
        found, known, right = found + len(own), known + len(truth.get(r.doc_id, ())), right + len(own & truth.get(r.doc_id, set()))
    assert found > 0 and right >= 0.95 * found and right >= 0.95 * known


def test_loose_forms_and_clean_numbers(spark):
    texts = ["mail: john.doe at example dot com today", "please call (212) 555-0187 now", "paid 12.50 on 2024-01-15, order 9807915762804490", None, "", "x" * 100_000 + "@", "1" * 100_000]
    df = plain.awkward(spark, [(i, t, None, None) for i, t in enumerate(texts)] + [(1, texts[1], None, None), (None, "+1 (017) 555-7713", None, None)])
    got = {}
    for r in pii.find(df).collect():
        got.setdefault(r.doc_id, []).append([tuple(s) for s in r.spans])
    assert got[0] == [[("email", 6, 33)]] and got[1] == [[("phone", 12, 26)]] * 2
    assert got[2] == got[3] == got[4] == got[5] == got[6] == [[]] and got[None] == [[("phone", 0, 17)]]
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "mail: [EMAIL] today" and clean[2] == texts[2] and clean[3] is None
    assert pii.find(df.limit(0)).collect() == []


def test_added_spans_overlap_nothing_kept(spark, sf_dir):
    for r in pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        kept, full = {tuple(s) for s in r.base}, {tuple(s) for s in r.spans}
        assert kept <= full
        for _, a, b in full - kept:
            assert not any(a < y and x < b for k, x, y in full if (k, x, y) != (_, a, b))
