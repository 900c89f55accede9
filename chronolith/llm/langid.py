"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text accepts exactly the substrings of that
sample. Parsing a text with it cuts the text greedily into longest matches; a text in the sample's language needs few
phrases. The language with the smallest phrases * log2(sample length) / text length, an estimate of the cross entropy
in bits a character, wins.

The automata become dense tables of transitions in which a miss leads to the state after the character alone and
carries the count of one phrase (characters beyond a language's ALPHABET - 1 commonest have sparse transitions, so that
every character of a sample can match), so that NumPy parses thousands of segments of a batch side by side. Texts are parsed
whole, in segments of SEGMENT characters (a phrase ends at the end of a segment, for every language alike).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.llm.common import fold, worker_model

#: Bounds of the fit: segments of labelled text sampled for each language, their characters, languages (the commonest).
SEGMENTS, OF_ONE, LANGUAGES = 60, 400, 256
SEGMENT, ALPHABET = 512, 96
LETTER = re.compile(r"[^\W\d_]")


def automaton(codes: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix automaton of codes: a flat table for codes under ``size``, and transitions by the other, rarer ones.

    The table has at [state * size + code] twice the next state's offset, plus one for a miss. Rarer codes have sorted
    keys (state * size * all codes + code), the value for each, and for each code the value where no key is found.
    """
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        if not c:
            last = 0  # an unknown character ends the substring
            continue
        known = step[last].get(c)
        if known is not None and length[known] == length[last] + 1:
            last = known
            continue
        if known is not None:
            twin = len(step)
            step.append(dict(step[known])), link.append(link[known]), length.append(length[last] + 1)
            link[known] = twin
            p = last
            while p >= 0 and step[p].get(c) == known:
                step[p][c] = twin
                p = link[p]
            last = twin
            continue
        now = len(step)
        step.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1)
                link[q] = link[now] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = now
    span = max(size, max(codes, default=0) + 1)
    restart = np.ones(span, np.int32)
    for c, s in step[0].items():
        restart[c] = 2 * s * size + 1
    table = np.tile(restart[:size], (len(step), 1))
    rare = []
    for s, moves in enumerate(step):
        for c, to in moves.items():
            if c < size:
                table[s, c] = 2 * to * size
            else:
                rare.append((s * size * span + c, 2 * to * size))
    keys, values = np.array(sorted(rare), np.int64).reshape(-1, 2).T
    return table.ravel(), np.ascontiguousarray(keys), values.astype(np.int32), restart


class Model:
    """samples: {language: text}, of bounded size."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        counts = Counter(c for lang in self.languages for c in samples[lang].lower())
        known = sorted(counts)
        self.codes = np.zeros(0x110000, np.int32)  # of all languages; 0 for a character in no sample
        self.codes[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.own, self.automata = [], []  # each language numbers all characters of its sample, the commonest first
        for lang in self.languages:
            codes = self.code(samples[lang].lower())
            often = Counter(codes.tolist())
            own = np.zeros(len(known) + 1, np.int32)
            own[sorted(often, key=lambda c: (-often[c], c))] = np.arange(1, len(often) + 1)
            self.own.append(own)
            self.automata.append(automaton(own[codes].tolist(), ALPHABET))
        self.bits = np.array([np.log2(max(2, len(samples[lang]))) for lang in self.languages])

    def code(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text by each language's automaton; an array (texts, languages)."""
        codes = [self.code(t.lower()) for t in texts]
        pieces = [(n, c[i : i + SEGMENT]) for n, c in enumerate(codes) for i in range(0, len(c), SEGMENT)]
        pieces.sort(key=lambda p: -len(p[1]))
        out = np.zeros((len(texts), len(self.languages)))
        if not pieces:
            return out
        sizes = np.array([len(p) for _, p in pieces])
        grid = np.zeros((SEGMENT, len(pieces)), np.int32)
        full = int((sizes == SEGMENT).sum())
        if full:
            grid[:, :full] = np.concatenate([p for _, p in pieces[:full]]).reshape(full, SEGMENT).T
        for k in range(full, len(pieces)):
            grid[: sizes[k], k] = pieces[k][1]
        live = np.searchsorted(-sizes, -np.arange(SEGMENT), "left")
        owner = np.array([n for n, _ in pieces])
        for n, (table, keys, values, restart) in enumerate(self.automata):
            state, count = np.zeros(len(pieces), np.int32), np.ones(len(pieces), np.int32)
            for row, m in zip(self.own[n][grid], live.tolist()):
                if not m:
                    break
                row = row[:m]
                if len(keys):
                    at = np.flatnonzero(row >= ALPHABET)
                    rare, row[at] = row[at], 0
                got = table[state[:m] + row]
                if len(keys) and len(at):
                    key = state[at].astype(np.int64) * len(restart) + rare
                    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    got[at] = np.where(keys[place] == key, values[place], restart[rare])
                count[:m] += got & 1
                state[:m] = got >> 1
            out[:, n] = np.bincount(owner, count, len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray]:
        """Languages and scores; ``und`` and 0 for a null text or one without a letter, None and 0 if none is known."""
        plain = [t or "" for t in texts]
        letters = np.array([bool(LETTER.search(t)) for t in plain], bool)
        if not self.languages:
            return [None if ok else "und" for ok in letters], np.zeros(len(texts))
        rates = self.phrases(plain) * self.bits / np.maximum(1, [len(t.lower()) for t in plain])[:, None]
        first = rates.argmin(axis=1) if len(texts) else np.zeros(0, int)
        ordered = np.sort(rates, axis=1)
        second = ordered[:, 1] if rates.shape[1] > 1 else np.full(len(texts), np.inf)
        score = np.where(letters, 1 - ordered[:, 0] / np.maximum(second, 1e-9), 0.0)
        return [self.languages[k] if ok else "und" for k, ok in zip(first.tolist(), letters)], np.clip(score, 0, 1)


def loaded(samples: dict[str, str]) -> Model:
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    return worker_model(("langid", key), lambda: Model(samples))


def samples(docs: DataFrame) -> dict[str, str]:
    """A bounded sample of text for each label, from the documents outside fold 0.

    Labelled texts are cut into segments of OF_ONE characters, all of them, and those with the smallest hashes of their
    text and number are the sample; copies of a text give a segment once, whatever their ids, so repeating rows doesn't
    change a label's sample. Rows with a null id train.
    """
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & (F.coalesce(fold(), F.lit(1)) != 0))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("t"), F.ceil(F.length("text") / OF_ONE).cast("int").alias("n"))
    texts = rows.groupBy("lang", "t").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    found = texts.groupBy("lang").agg(F.sum("rows").alias("rows"), F.sum("n").alias("segments"))
    labels = found.orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()
    if not labels:
        return {}
    # hashes below a label's cut are about four samples, so that only so many rows of it meet
    cuts = [(r.lang, int((1 << 62) * min(1.0, 4 * SEGMENTS / r.segments))) for r in labels]
    known = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    hash_of = lambda i: F.shiftrightunsigned(F.xxhash64("t", i), 2)
    some = rows.join(known, "lang").withColumn("at", F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: hash_of(i) < F.col("cut")))
    parts = F.transform("at", lambda i: F.struct(hash_of(i).alias("h"), F.substring("text", i * OF_ONE + 1, F.lit(OF_ONE)).alias("part")))
    each = some.filter(F.size("at") > 0).select("lang", F.inline(parts)).groupBy("lang", "h").agg(F.min("part").alias("part"))
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= SEGMENTS)
    out: dict[str, list[str]] = {}
    for r in sorted(first.collect(), key=lambda r: (r.lang, r.k)):
        out.setdefault(r.lang, []).append(r.part)
    return {lang: "\n".join(own) for lang, own in out.items()}


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``; lang and source only serve to fit.

    Fitted on a bounded sample of text with a label from documents whose crc32(doc_id) mod 5 is not 0. A text that is
    null or has no letter is ``und`` with score 0; if nothing is labelled, other texts are null with score 0. The score is one less the
    ratio of the best language's entropy to the next one's. Ties go to the label that sorts first; other columns are
    ignored.
    """
    return label(docs.select("doc_id", "text", "lang")).select("doc_id", "lang_pred", "score")


def label(docs: DataFrame) -> DataFrame:
    """``docs`` (with doc_id, text and lang) and two more columns, lang_pred and score; see ``identify``.

    Columns of these two names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    sample = docs.sparkSession.sparkContext.broadcast(samples(docs))

    def run(batches):
        model = loaded(sample.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                languages, scores = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                    names=[*part.schema.names, "lang_pred", "score"],
                )

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def op7_langid(spark, sf_dir) -> DataFrame:
    """The language of every document; held_out is false for a null id, which trains."""
    from chronolith.llm.common import table

    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
