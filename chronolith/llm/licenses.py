"""License scans: short notices found with a bounded number of edits.

A text is brought to lower-case words joined by single spaces. A notice of k allowed edits is split into k + 1 pieces;
k edits can't touch them all, so every place of the notice holds one of them unchanged (the pigeonhole principle). One
Aho-Corasick pass finds the pieces of all notices; each hit names the place where its notice would have to lie, and the
regex library's bounded-error matching searches that stretch alone, a notice's length and twice its edits, for the best
match. Only verified matches count. Words in brackets must stand unchanged, as they tell one license from another; each
stretch between them may have one edit for eight characters, three at most. Edits count UTF-8 bytes.

Besides, exact phrases are looked up as runs of whole words. Texts stay where they are: there is no shuffle.
"""

from __future__ import annotations

import re
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import worker_model

#: Exact phrases of whole words and their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Notices (label, words); what stands in brackets may not be edited.
NOTICES = (
    ("agpl", "[gnu affero general] public license"),
    ("apache", "licensed under the [apache] license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "spdx license identifier [apache]"),
    ("boost", "[boost] software license version 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("bsd", "licensed under the [bsd] license"),
    ("bsd", "released under the [bsd] license"),
    ("bsd", "spdx license identifier [bsd]"),
    ("cc-by", "licensed under [cc by] 4 0"),
    ("cc-by", "licensed under a creative commons [attribution] 4 0 international license"),
    ("cc-by-nc", "licensed under [cc by nc] 4 0"),
    ("cc-by-nc", "creative commons [attribution noncommercial] 4 0"),
    ("cc-by-sa", "licensed under [cc by sa] 4 0"),
    ("cc-by-sa", "creative commons [attribution sharealike] 4 0"),
    ("cc0", "spdx license identifier [cc0]"),
    ("epl", "[eclipse] public license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("gpl", "licensed under the [gnu general] public license"),
    ("gpl", "under the terms of the [gnu general] public license"),
    ("gpl", "spdx license identifier [gpl]"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "[gnu lesser general] public license"),
    ("lgpl", "spdx license identifier [lgpl]"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "licensed under the [mit] license"),
    ("mit", "released under the [mit] license"),
    ("mit", "distributed under the [mit] license"),
    ("mit", "spdx license identifier [mit]"),
    ("mpl", "this source code form is subject to the terms of the [mozilla] public license"),
    ("mpl", "spdx license identifier [mpl]"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "altered source versions must be plainly marked as such"),
)
#: Bytes of a text after which words are told apart: letters lower-case, other ASCII than letters and digits a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Characters for each edit of a stretch, and most edits of one.
SHARE, MOST = 8, 3


class Notice:
    """One notice: its label, whole text, allowed edits, exact pieces with their offsets, and compiled pattern."""

    def __init__(self, label: str, words: str):
        self.label, self.text, self.edits, pattern = label, re.sub(r"[\[\]]", "", words), 0, ""
        for n, part in enumerate(re.split(r"[\[\]]", words)):
            part = part.encode().decode("latin-1")
            allowed = 0 if n % 2 else min(MOST, len(part) // SHARE)
            self.edits += allowed
            pattern += f"(?:{regex.escape(part, literal_spaces=True)}){{e<={allowed}}}" if allowed else regex.escape(part, literal_spaces=True)
        self.text = self.text.encode().decode("latin-1")
        self.pattern = regex.compile(f"(?b)(?<![^ ]){pattern}(?![^ ])")
        cuts = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.pieces = [(a, self.text[a:b]) for a, b in pairwise(cuts)]

    def near(self, text: str, starts) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the best match near each place where the notice might begin, each once."""
        found = set()
        for at in starts:
            m = self.pattern.search(text, max(0, at - self.edits), at + len(self.text) + 2 * self.edits + 1)
            if m:
                found.add((m.start(), m.end(), sum(m.fuzzy_counts)))
        return sorted(found)


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES):
        self.notices = [Notice(*n) for n in notices]
        self.phrases = [(label, b" %s " % words.encode()) for label, words in phrases]
        self.seeds = ahocorasick.Automaton()
        pieces: dict[str, list] = {}
        for n, notice in enumerate(self.notices):
            for offset, piece in notice.pieces:
                pieces.setdefault(piece, []).append((n, offset + len(piece) - 1))
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, uses)
        if pieces:
            self.seeds.make_automaton()

    def matches(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) in a text of joined words: of overlapping matches of one label the one with the
        smallest share of edits, then the longest, then the first."""
        places: dict[int, set[int]] = {}
        for end, uses in self.seeds.iter(text) if len(self.seeds) else ():
            for n, offset in uses:
                places.setdefault(n, set()).add(end - offset)
        by: dict[str, list] = {}
        for n, starts in places.items():
            by.setdefault(self.notices[n].label, []).extend(self.notices[n].near(text, sorted(starts)))
        out = []
        for label, found in sorted(by.items()):
            kept = None
            for one in sorted(found):
                if kept is not None and one[0] < kept[1]:
                    kept = min(kept, one, key=lambda m: (m[2] / (m[1] - m[0]), m[0] - m[1], m[0]))
                    continue
                out += [(label, *kept)] if kept else []
                kept = one
            out += [(label, *kept)] if kept else []
        return out

    def scan(self, data: bytes):
        """(number of words, base places (label, word), matches (label, start, end, word, words, edits)); start and end
        count code points of the text."""
        words = data.translate(FOLD).split()
        joined = b" " + b" ".join(words) + b" "
        base = []
        for label, phrase in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                base.append((label, at))
                at = joined.find(phrase, at + 1)
        matches = self.matches(joined[1:-1].decode("latin-1"))
        if not base and not matches:
            return len(words), (), ()
        begins = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)[:-1]  # of word n in the joined text
        numbers = np.searchsorted(begins, [at for _, at in base])
        base = sorted(zip([label for label, _ in base], numbers.tolist()), key=lambda b: (b[1], b[0]))
        found = []
        if matches:
            spans = [m.span() for m in WORDS.finditer(data.decode("utf-8", "replace"))]
            for label, a, b, edits in matches:
                first, last = (int(np.searchsorted(begins, x, "right")) - 1 for x in (a, b - 1))
                found.append((label, spans[first][0], spans[last][1], first, last - first + 1, edits))
        return len(words), base, sorted(found, key=lambda f: (f[1], f[2], f[0]))


SPANS = "array<struct<label: string, start: long, end: long, word: long, words: long, edits: long>>"
SCHEMA = f"doc_id long, n_words long, base array<struct<label: string, word: long>>, spans {SPANS}"


def scan(docs: DataFrame, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, base, spans) for each row: where exact phrases stand (label, word from 0, by word) and where
    notices stand within their edits (label, start and end in code points, first word, words, edits, by start).

    Matches begin and end with whole words. A null or empty text has no words, places or spans. Each row is scanned by
    itself and whole, one at a time, so very long texts take memory in proportion to their own length; repeated rows
    come out repeated, other columns are ignored, an empty table gives none.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))), ("spans", pa.list_(pa.struct([("label", pa.string()), *((c, pa.int64()) for c in ("start", "end", "word", "words", "edits"))])))])
    names = [f.name for f in kinds.field("spans").type.value_type]

    def run(batches):
        scanner = worker_model(("licenses", notices, phrases), lambda: Scanner(notices, phrases))
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                found = [scanner.scan(t.as_py() or b"") for t in part.column(1)]
                base = [[{"label": label, "word": n} for label, n in f[1]] for f in found]
                spans = [[dict(zip(names, s)) for s in f[2]] for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array(base, kinds.field("base").type), pa.array(spans, kinds.field("spans").type)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def op12_licenses(spark, sf_dir) -> DataFrame:
    """Words, exact phrases and fuzzy notices of every document; a document's score is 1 for an exact phrase, else the
    best match's share of unedited characters, else 0. spans lists label:start:end:edits by start."""
    from chronolith.llm.common import table

    found = scan(table(spark, sf_dir, "documents"))
    own, all_labels = F.array_distinct("base.label"), F.array_union("base.label", "spans.label")
    best = F.array_max(F.transform("spans", lambda s: 1 - s["edits"] / F.greatest(s["end"] - s["start"], s["edits"], F.lit(1))))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        F.array_join(F.sort_array(own), ",").alias("base_labels"), F.array_join(F.sort_array(all_labels), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["edits"])), ",").alias("spans"),
    )
