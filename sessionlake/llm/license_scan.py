"""License scans: exact phrases, and short notices found with up to a bounded number of edits.

A notice with ``k`` allowed edits is split into ``k + 1`` pieces; where it occurs with at most ``k`` edits, one piece
occurs exactly (pigeonhole). Aho-Corasick finds all pieces in one pass; around each, the regex library's bounded-error
matching verifies the notice and reports its span and edits. Text is compared as its words, lower-cased in A-Z and joined
by one blank, so line breaks and punctuation do not count as edits. Names and identifiers of licenses are too short for
edits and are found as whole words, exactly.

Null and empty texts have no words: counts 0, null places, empty labels, score 0. Repeated rows are judged one by one; an
empty table gives an empty table. Very long texts are searched whole. Only the key and ``text`` are read, so extra
columns of any name do not matter.
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, binary_text, lean

#: Phrases that count wherever their words stand together, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label and words of each notice.
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "waived all copyright and related or neighboring rights"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved no part of this publication may be reproduced"),
    ("unlicense", "free and unencumbered software released into the public domain"),
)
#: Label and words of names and identifiers; no edits.
NAMES = (
    ("apache", "apache license"), ("bsd", "bsd license"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("cc0", "cc0 1 0"),
    ("isc", "isc license"), ("mit", "mit license"), ("mpl", "mozilla public license"), ("unlicense", "the unlicense"),
) + tuple(
    (label, f"spdx license identifier {words}") for label, words in (
        ("agpl", "agpl 3 0"), ("apache", "apache 2 0"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("gpl", "gpl 2 0"),
        ("gpl", "gpl 3 0"), ("isc", "isc"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("mit", "mit"), ("mpl", "mpl 2 0"), ("unlicense", "unlicense"),
    )
)
#: One edit for so many letters.
LETTERS_PER_EDIT = 14

HIT = "struct<label:string,first_word:int,last_word:int,begin:int,stop:int,edits:int>"


class Notices:
    def __init__(self, notices=NOTICES, names=NAMES, per_edit: int = LETTERS_PER_EDIT):
        self.notices = [(label, text, max(1, len(text) // per_edit)) for label, text in notices]
        self.notices += [(label, f" {text} ", 0) for label, text in names]
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(t, special_only=True)}){{e<={k}}}") for _, t, k in self.notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.notices):
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def search(self, norm: str) -> list[tuple[int, int, int, int]]:
        """Notice, begin, stop and edits of every verified occurrence; occurrences of one notice do not overlap."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(norm):
            start = end + 1 - size
            for n, offset in where:
                _, text, k = self.notices[n]
                a, b = max(0, start - offset - k), min(len(norm), start - offset + len(text) + k)
                held = windows.setdefault(n, [])
                if held and a <= held[-1][1]:
                    held[-1][1] = max(b, held[-1][1])
                    held[-1][0] = min(a, held[-1][0])
                else:
                    held.append([a, b])
        out = []
        for n, held in windows.items():
            if not self.notices[n][2]:  # a whole piece is the occurrence
                size = len(self.notices[n][1])
                out += [(n, a, a + size, 0) for a0, b in held for a in range(a0, b - size + 1) if norm.startswith(self.notices[n][1], a)]
                continue
            for a, b in held:
                out += [(n, m.start(), m.end(), sum(m.fuzzy_counts)) for m in self.patterns[n].finditer(norm, a, b)]
        return out


@functools.lru_cache(2)
def _notices(notices: tuple, names: tuple) -> Notices:
    """One for each Python worker and list of notices."""
    return Notices(notices, names)


def notices_of(rows: DataFrame, most: int = 10_000) -> tuple[tuple, tuple]:
    """Notices and names from rows ``label, words, edits`` (``edits`` false: found exactly, as a name), as arguments for
    ``scan_licenses``. Words are taken as those of texts; rows without words or label go; more than ``most`` are an error."""
    told = rows.where("label is not null").select("label", F.col("words").cast("string").alias("words"), F.coalesce("edits", F.lit(True)).alias("edits")).distinct().limit(most + 1).collect()
    if len(told) > most:
        raise ValueError(f"more than {most} notices")
    held = sorted((r["label"], b" ".join(alnum_words((r["words"] or "").encode())).decode(), r["edits"]) for r in told)
    return tuple((la, w) for la, w, e in held if w and e), tuple((la, w) for la, w, e in held if w and not e)


def scan(words: list[bytes], notices: Notices) -> tuple[int, int | None, int | None, list[str], list[tuple], float]:
    """Number of phrases, their first and last word, their labels, the notices found, and the score."""
    norm = b" " + b" ".join(words) + b" "
    starts, base = [], []
    for phrase, label in PHRASES:
        at, before, found = norm.find(b" %b " % phrase.encode()), 0, -1
        word = 0
        while at >= 0:
            word += norm.count(b" ", before, at)
            before = at
            starts.append(word)
            found = at
            at = norm.find(b" %b " % phrase.encode(), at + 1)
        if found >= 0:
            base.append(label)
    text = norm.decode("utf-8", "replace")
    hits, score = [], 1.0 if base else 0.0
    for n, a, b, edits in notices.search(text):
        label, notice, _ = notices.notices[n]
        first = text.count(" ", 0, a + (text[a] == " ")) - 1
        last = text.count(" ", 0, b - (text[b - 1] == " ")) - 1
        hits.append((label, max(first, 0), max(last, 0), a, b, edits))
        score = max(score, 1.0 - edits / len(notice))
    return len(starts), min(starts, default=None), max(starts, default=None), base, sorted(hits, key=lambda h: (h[3], h[4], h[0])), score


def scan_licenses(docs: DataFrame, key: str = "doc_id", with_hits: bool = True, notices=NOTICES, names=NAMES) -> DataFrame:
    """The key, ``n_words, n_base, first_word, last_word, base_labels, labels, score`` and ``hits`` (notices found).

    ``begin`` and ``stop`` of a hit are letters of the normalised text (one blank before the first word). Other notices and
    names than the fixed ones may be given, as from ``notices_of``; phrases stay.
    """
    fields = [docs.schema[key]] + [T.StructField(n, t) for n, t in (
        ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
        ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()),
    )]
    if with_hits:
        fields.append(T.StructField("hits", T.ArrayType(T._parse_datatype_string(HIT))))
    hit = pa.struct([("label", pa.string()), *((n, pa.int32()) for n in ("first_word", "last_word", "begin", "stop", "edits"))])

    notices, names = tuple(map(tuple, notices)), tuple(map(tuple, names))

    def run(batches):
        held = _notices(notices, names)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = alnum_words(text)
                n, first, last, base, hits, score = scan(words, held)
                labels = {*base, *(h[0] for h in hits)}
                rows.append((len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, [dict(zip([f.name for f in hit], h)) for h in hits]))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(hit)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types[: len(fields) - 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.name for f in fields])

    return lean(docs).select(key, binary_text()).mapInArrow(run, T.StructType(fields))
