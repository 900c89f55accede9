"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans: strict patterns (e-mail addresses, IP addresses, card and telephone
numbers) and loose ones (addresses spelt with "at" and "dot", numbers grouped in other ways, numbers that fail a check
of the strict patterns, values behind a colon or an equals sign, and long runs that mix letters and digits: passwords,
tokens and keys, of the kind "secret"). Boosted trees over features of a span's format and its context give each a
score; isotonic regression on examples kept out of the fit turns scores into precisions, and a threshold for each kind
selects redactions. Spans that pass the strict patterns' own checks are always kept; selected ones are added where they
overlap nothing kept, best score first.

The trees are fitted on a seeded set of written texts of fixed size, so that every run and every input has the same
model; no row of the input is learnt from. The texts hold personal data in loose forms among things that look alike
(dates, versions, hashes, order numbers, settings), and the generators' candidates in them, right, wrong or partly
right, are the examples.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AT = re.compile(r"@| @ | at | ?[\[({]at[\])}] ?", re.I)
SPELT = re.compile(r"[A-Za-z0-9-]+(?:(?: dot | ?[\[({]dot[\])}] ?|\.)[A-Za-z0-9-]+)+", re.I)
LOOSE = (
    ("phone", re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[ ._-]{1,2}[0-9]{3,6}){2,4}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}(?![0-9A-Za-z.])")),
)
SIGN = re.compile(r"[:=]")
VALUE = re.compile(r"[ \t]{0,2}[\"']?([A-Za-z0-9_+/.~%$!@#^&*-]{6,}=*)")
RUN = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}=*")
CUES = {
    "email": re.compile(r"mail|contact|write|address|reach"),
    "ip": re.compile(r"\bip\b|host|server|addr|login"),
    "card": re.compile(r"card|visa|credit|payment|\bpay\b"),
    "phone": re.compile(r"phone|\bcall|\btel\b|mobile|\bfax|whatsapp|\bring\b"),
    "secret": re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential"),
}
OTHER = re.compile(r"\b(?:no|nr|id|v|version|isbn|date|total|order|commit|sha\d*|md5|uuid|build|hash|rev|revision|page|size|width|lang|charset|url|href|src|license)\b[^a-z]*$|[$€#/]\s*$")
DIGITS, LETTERS = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
GROUPS, MARKS, HEX = re.compile(r"[0-9]+"), re.compile(r"[^0-9A-Za-z]"), re.compile(r"[0-9a-f]+")
TLD, DATE = re.compile(r"(?:com|org|net|edu|io|de|fr|es)$"), re.compile(r"(?:19|20)\d\d[-/.]|\d\d[-/.]\d\d[-/.](?:19|20)\d\d")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """Leftmost matches of local@domain: only the run of local characters before an @ can begin one."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def ip_ok(text: str) -> bool:
    return all(len(part := p.lstrip("0")) <= 3 and int(part or "0") <= 255 for p in text.split("."))


def base(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the strict patterns that pass their checks, by kind and start, in code points."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGITS.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if ip_ok(m.group())]
        out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def loose(text: str) -> list[tuple[str, int, int]]:
    """Overlapping candidates of the loose patterns, each once."""
    out, done = [], 0
    for m in AT.finditer(text):
        begin = m.start()
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = SPELT.match(text, m.end()) if begin < m.start() and text[begin] not in ".%+-" else None
        if found:
            out.append(("email", begin, found.end()))
            done = found.end()
    if DIGITS.search(text):
        for kind, pattern in LOOSE:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
        for m in RUN.finditer(text):
            if DIGITS.search(text, m.start(), m.end()) and LETTERS.search(text, m.start(), m.end()):
                out.append(("secret", *m.span()))
    done = 0
    for m in SIGN.finditer(text):
        found = VALUE.match(text, m.end()) if m.end() >= done else None
        if found:
            out.append(("secret", *found.span(1)))
            done = found.end()
    return list(dict.fromkeys(out))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and its context: 32 characters before it and 8 behind."""
    span, digits = text[start:end], digits_of(text[start:end])
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 8].lower()
    groups, marks, letters = GROUPS.findall(span), MARKS.findall(span), LETTERS.findall(span)
    size, lower = max(1, len(span)), span.lower()
    counts = Counter(span).values()
    entropy = -sum(n / size * math.log2(n / size) for n in counts)
    cue = CUES[kind]
    flags = (
        span.startswith("+"), 13 <= len(digits) <= 19 and luhn(digits), len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        cue.search(before), cue.search(before[-12:]), OTHER.search(before), before[-1:].isalnum(), after[:1].isalnum(), "." in span or "dot" in lower,
        "@" in span or AT.search(span), TLD.search(lower), DATE.match(span), "(" in span, before[-1:] in ("'", '"'), "=" in before[-4:], ":" in before[-3:],
        "://" in before or before.endswith("/"), span.isupper(), HEX.fullmatch(lower), "/" in span, "_" in span,
    )
    return [
        float(KINDS.index(kind)), float(len(span)), float(len(digits)), float(len(letters)), float(len(groups)), float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)), float(len(marks)), float(len(set(marks))), float(len(counts)), entropy, len(digits) / size,
        sum(c.isupper() for c in span) / size, float(sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))) / size, *(float(bool(f)) for f in flags),
    ]


def written(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Written texts with the personal data in them: (text, spans), n items in all, half of them not personal."""
    rnd, out = random.Random(seed), []
    parts = "ba re ton is la the or en mi du sch ung ción eau th ing er os que ß é".split()
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    of = lambda letters, low, high: "".join(rnd.choice(letters) for _ in range(rnd.randint(low, high)))
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    mixed = upper + upper.lower() + "0123456789"
    plain = lambda: "".join(c for c in word() if c.isascii()) or "name"
    top = lambda: rnd.choice(("com", "org", "net", "de", "fr", "es", "io"))

    def number(good):
        body = rnd.choice("3456") + num(14)
        right = next(d for d in "0123456789" if luhn(body + d))
        return body + (right if good else rnd.choice([d for d in "0123456789" if d != right]))

    def personal(kind):
        if kind == "email":
            return rnd.choice(("mail ", "contact: ", "write to ", "", "")), f"{plain()}{rnd.choice(('.', '_', ''))}{plain()}{rnd.choice((' at ', '[at]', ' (at) ', ' @ '))}{plain()}{rnd.choice((' dot ', '[dot]', '.'))}{top()}"
        if kind == "phone":
            return rnd.choice(("phone ", "call ", "tel: ", "mobile ", "", "")), rnd.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}"))
        if kind == "card":
            digits, mark = number(rnd.random() < 0.95), rnd.choice(("  ", ".", "_"))
            return rnd.choice(("card ", "visa ", "paid with ", "", "")), mark.join(digits[i : i + 4] for i in range(0, 16, 4))
        if kind == "ip":
            return rnd.choice(("host ", "ip ", "server ", "from ", "")), rnd.choice(("[.]", "(.)", " . ")).join(str(rnd.randint(0, 255)) for _ in range(4))
        name = rnd.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access-key", "auth", "AUTH_TOKEN", "private_key"))
        value = rnd.choice((of(hexa, 10, 24), of(hexa, 32, 64), of(mixed, 10, 44), of(mixed, 8, 16) + rnd.choice("!$%&*"), of(mixed, 12, 30) + "=="))
        if rnd.random() < 0.05:
            return "", of(hexa, 32, 40)  # nothing tells it from a checksum
        free = rnd.choice((of(upper[:26], 4, 4) + of(upper, 14, 18), plain()[:3] + "_" + of(mixed, 20, 40)))
        return rnd.choice(((name + rnd.choice(("=", " = ", ": ", ":")), value), (name + rnd.choice((' = "', '="', ": '")), value), (rnd.choice(("", "", "key ")), free), ("bearer ", of(mixed, 24, 44))))

    def other():
        return rnd.choice((
            lambda: ("", f"{plain()} at {plain()}.{plain()}"), lambda: (rnd.choice(("look ", "meet ", "")), f"at {plain()} dot {plain()}"),
            lambda: (rnd.choice(("date ", "on ", "")), rnd.choice((f"20{num(2)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}"))),
            lambda: (rnd.choice(("total $", "", "size ")), rnd.choice((f"{num(3)} {num(3)} {num(3)}", f"{num(2)}-{num(2)}-{num(2)}", f"{num(3)}/{num(3)}/{num(3)}"))),
            lambda: (rnd.choice(("order ", "no. ", "", "id ")), number(rnd.random() < 0.02)), lambda: (rnd.choice(("isbn ", "ISBN: ", "")), f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}"),
            lambda: (rnd.choice(("", "id ", "card ")), rnd.choice((".", "_", "  ")).join(number(False)[i : i + 4] for i in range(0, 16, 4))),
            lambda: (rnd.choice(("version ", "v", "build ", "")), ".".join(str(rnd.randint(200, 999)) for _ in range(4))), lambda: ("", ". ".join(num(1) for _ in range(4))),
            lambda: (rnd.choice(("commit ", "sha1: ", "rev = ", "hash ", "")), of(hexa, 40, 40)), lambda: (rnd.choice(("md5 ", "md5=")), of(hexa, 32, 32)),
            lambda: (rnd.choice(("uuid ", "id: ", "id=")), "-".join((of(hexa, 8, 8), of(hexa, 4, 4), of(hexa, 4, 4), of(hexa, 12, 12)))),
            lambda: ("https://", f"{plain()}.{top()}/{plain()}/{of(mixed, 8, 24)}"), lambda: (rnd.choice(("width=", "size: ", "total = ")), num(rnd.randint(6, 9)) + rnd.choice(("", "px"))),
            lambda: (rnd.choice(("lang=", "charset=", "mode = ", "name: ", "license: ")), rnd.choice(("en_US.UTF-8", "utf-8-sig", "apache-2.0", plain() + plain() + plain()))),
            lambda: ("", of(hexa, 32, 40)), lambda: (rnd.choice(("part ", "ref ", "")), f"{num(3)}-{num(3)}-{num(4)}"), lambda: ("", f"look at {plain()} dot {top()}"),
            lambda: (rnd.choice(("section ", "")), " . ".join(str(rnd.randint(0, 99)) for _ in range(4))), lambda: ("", plain() + "-" + plain() + "-" + plain() + num(rnd.randint(1, 4))), lambda: (word() + ": ", word() + plain() + plain()), lambda: ("", "_".join(plain() for _ in range(4)) + num(1)),
        ))()

    while n > 0:
        text, spans = "", []
        for _ in range(rnd.randint(2, 6)):
            text += " ".join(word() for _ in range(rnd.randint(1, 8))) + rnd.choice((" ", ", ", ". ", "\n"))
            kind = rnd.choice(KINDS) if rnd.random() < 0.5 else None
            cue, span = personal(kind) if kind else other()
            if kind:
                spans.append((kind, len(text) + len(cue), len(text) + len(cue) + len(span)))
            text += cue + span + rnd.choice((" ", ". ", ", ", "\n", '" '))
            n -= 1
        out.append((text, spans))
    return out


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all candidates in n written items that overlap no strict span: 1 where the span and the
    personal data of its kind share four fifths of what they cover together."""
    x, y = [], []
    for text, spans in written(n, seed):
        kept = base(text)
        for kind, a, b in loose(text):
            if any(a < d and c < b for _, c, d in kept):
                continue
            x.append(features(text, kind, a, b))
            y.append(any(k == kind and min(b, d) - max(a, c) >= 0.8 * (max(b, d) - min(a, c)) for k, c, d in spans))
    return np.array(x), np.array(y, float)


class Trees:
    """Gradient-boosted regression trees on the logistic loss, of fixed depth, with thresholds at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.3):
        self.depth, self.bias = depth, float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 19))) for j in range(x.shape[1])]
        margin = np.full(len(y), self.bias)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            inner = (1 << depth) - 1
            feature, cut, leaf = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(1 << depth)
            node = np.zeros(len(y), int)
            for k in range(inner):
                own = np.flatnonzero(node == k)
                gain, total_g, total_h = 1e-6, g[own].sum(), h[own].sum()
                for j, values in enumerate(cuts):
                    below = x[own, j][:, None] <= values
                    gl, hl = g[own] @ below, h[own] @ below
                    value = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    if len(value) and value.max() > gain:
                        gain, feature[k], cut[k] = value.max(), j, values[value.argmax()]
                node[own] = 2 * k + 1 + (x[own, feature[k]] > cut[k])
            for k in range(1 << depth):
                own = node == inner + k
                leaf[k] = rate * g[own].sum() / (h[own].sum() + 1)
            self.trees.append((feature, cut, leaf))
            margin = margin + leaf[node - inner]

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def calibration(score: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of truth on score: the scores from which on each precision holds, and the precisions."""
    least, at = np.unique(score, return_inverse=True)
    pools: list[list[float]] = []  # sum of truth, number, least score
    for s, t, n in zip(least.tolist(), np.bincount(at, truth).tolist(), np.bincount(at).tolist()):
        pools.append([t, n, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1][0] += last[0]
            pools[-1][1] += last[1]
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


@functools.cache
def model(n: int = 9000, seed: int = 17, precision: float = 0.9) -> tuple[Trees, tuple[float, ...]]:
    """Trees, and each kind's threshold: the least score whose calibrated precision, on a third of the examples that
    is kept out of the fit, reaches ``precision``."""
    x, y = examples(n, seed)
    cut = 2 * len(y) // 3
    trees = Trees(x[:cut], y[:cut])
    score, truth, kind = trees.predict(x[cut:]), y[cut:], x[cut:, 0]
    thresholds = []
    for k in range(len(KINDS)):
        least, level = calibration(score[kind == k], truth[kind == k]) if (kind == k).any() else (np.zeros(0), np.zeros(0))
        good = least[level >= precision]
        thresholds.append(float(good[0]) if len(good) else 1.01)
    return trees, tuple(thresholds)


def added(text: str, kept: list[tuple[str, int, int]], fitted) -> list[tuple[str, int, int]]:
    """Loose candidates that the model selects and that overlap nothing kept or selected before."""
    some = [c for c in loose(text) if not any(c[1] < b and a < c[2] for _, a, b in kept)] if len(kept) < 64 else _apart(loose(text), kept)
    if not some:
        return []
    trees, thresholds = fitted
    scores = trees.predict(np.array([features(text, *c) for c in some]))
    ranked = sorted((-s, c[1], -c[2], c) for s, c in zip(scores.tolist(), some) if s >= thresholds[KINDS.index(c[0])])
    out: list[tuple[str, int, int]] = []
    taken = np.zeros(len(text) if ranked else 0, bool)
    for _, a, b, c in ranked:
        if not taken[a : c[2]].any():
            taken[a : c[2]] = True
            out.append(c)
    return out


def _apart(some, kept):
    covered = np.zeros(max([c[2] for c in [*some, *kept]], default=0) + 1, np.int32)
    for _, a, b in kept:
        covered[a:b] = 1
    sums = np.concatenate(([0], np.cumsum(covered)))
    return [c for c in some if sums[c[2]] == sums[c[1]]]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs``: arrays of (kind, start, end) in code points, end exclusive.

    ``base`` has the strict spans, ``spans`` these and the selected ones, both by kind (e-mail, IP, card, phone, secret)
    and start. A null text counts as empty; repeated rows are searched each; other columns are ignored. There is no shuffle.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model())
    kind = "array<struct<kind:string, start:int, end:int>>"

    def nested(lists):
        flat = [s for own in lists for s in own]
        struct = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.int32())], names=["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)), struct)

    def run(batches):
        for batch in batches:
            strict, full = [], []
            for text in batch.column(1).to_pylist():
                own = base(text or "")
                strict.append(own)
                more = added(text, own, fitted.value) if text else []
                full.append(sorted(own + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else own)
            yield pa.RecordBatch.from_arrays([batch.column(0), nested(strict), nested(full)], names=["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by its kind in brackets; its other columns as they are.

    Overlapping spans are replaced together, under the kind of the first. Null texts stay null, empty ones empty, repeated
    rows repeated; texts are taken whole, some rows at a time; an empty table gives none.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model())

    def clean(text):
        own = base(text)
        own = own + added(text, own, fitted.value)
        out, done = [], 0
        for k, a, b in sorted(own, key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"[{k.upper()}]"]
            done = max(done, b)
        return "".join(out) + text[done:]

    def run(batches):
        for part in (b.slice(i, 250) for b in batches for i in range(0, b.num_rows, 250)):
            at = part.schema.get_field_index("text")
            texts = pa.array([None if t is None else clean(t) for t in part.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(part.columns)], schema=pa.schema([f if i != at else pa.field("text", pa.string()) for i, f in enumerate(part.schema)]))

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark, sf_dir) -> DataFrame:
    """The strict spans of all documents, counted and digested, and all spans with those that the model adds."""
    from chronolith.llm.common import table

    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
