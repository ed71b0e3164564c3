"""License scans: exact phrases, and fuzzy short notices found by pigeonhole seeds.

A notice of n words that occurs with at most k edits, split into k + 1 pieces, has one piece without an
edit. Pieces are searched as exact strings; where one occurs, the regex library's bounded-error matching
verifies the whole notice around it, within its k edits, and gives the span. Base phrases are sought
exactly, word for word.

Words are runs of ASCII letters, digits and non-ASCII characters, after A-Z is lower-cased. Whole texts
are scanned row by row; nothing is shuffled.

Defined cases: a null text is empty; texts without a phrase or notice have empty labels and score 0;
texts of any length are scanned whole; repeated rows each keep their row; only the id and the text are read and the
id returned, so other columns, of whatever names, don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices of public licences, by label.
NOTICES: list[tuple[str, str]] = [
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by", "this work is licensed under cc by"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
    ("public-domain", "this work is in the public domain"),
    ("reserved", "no part of this publication may be reproduced"),
    ("reserved", "copyright all rights reserved by the author"),
]
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 15
_WORD = np.ones(256, bool)
_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_IN_WORD = rb"[0-9a-z\x80-\xff]"

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("edits", T.LongType())]))),
    ]
)


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int = field(init=False)
    pieces: tuple[tuple[str, int], ...] = field(init=False)
    pattern: str = field(init=False)

    def __post_init__(self) -> None:
        edits = len(self.text) // CHARS_PER_EDIT
        n, k = len(self.text), edits + 1
        cuts = [i * n // k for i in range(k + 1)]
        object.__setattr__(self, "edits", edits)
        object.__setattr__(self, "pieces", tuple((self.text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)))
        object.__setattr__(self, "pattern", f"(?b)(?:{regex.escape(self.text)}){{e<={edits}}}")


def notices_of(pairs: Sequence[tuple[str, str]]) -> list[Notice]:
    return [Notice(label, text) for label, text in pairs]


class Scanner:
    """Scans one text after another; holds the compiled phrases and notices."""

    def __init__(self, phrases: dict[str, str], notices: Sequence[Notice]):
        words = lambda p: _GAP.join(re.escape(w.encode()) for w in p.split())
        self.phrases = [(label, p.split()[0].encode(), re.compile(b"(?<!" + _IN_WORD + b")" + words(p) + b"(?!" + _IN_WORD + b")")) for p, label in phrases.items()]
        self.notices = [(n, regex.compile(n.pattern)) for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for piece, at in n.pieces:
                seeds.setdefault(piece, []).append((i, at))
        self.seeds = list(seeds.items())

    def fuzzy(self, plain: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) in a text of words joined by single spaces, none within another of its label."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for piece, places in self.seeds:
            at = plain.find(piece)
            while at >= 0:
                for i, offset in places:
                    n = self.notices[i][0]
                    windows.setdefault(i, []).append((at - offset - n.edits, at - offset + len(n.text) + n.edits))
                at = plain.find(piece, at + 1)
        out = []
        for i, spans in windows.items():
            n, pattern = self.notices[i]
            spans.sort()
            merged = [list(spans[0])]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                at = max(0, a)
                while found := pattern.search(plain, at, b):
                    out.append((n.label, found.start(), found.end(), sum(found.fuzzy_counts)))
                    at = max(found.end(), at + 1)
        return out

    def scan(self, text: bytes) -> tuple:
        low = text.lower()
        data = np.frombuffer(low, np.uint8)
        word = _WORD[data]
        begin = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        if len(word) and word[0]:
            begin = np.concatenate([[0], begin])
        places, labels = [], set()
        for label, first, pattern in self.phrases:
            if first in low:
                got = [m.start() for m in pattern.finditer(low)]
                places += got
                if got:
                    labels.add(label)
        starts = np.searchsorted(begin, sorted(places)).tolist()
        plain = " ".join(_split(low))
        edges = None
        spans, score = [], 1.0 if labels else 0.0
        for label, a, b, edits in sorted(self.fuzzy(plain)):
            if edges is None:
                edges = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le"), np.uint32) == 32)
            a, b = a + (plain[a : a + 1] == " "), b - (plain[b - 1 : b] == " ")
            spans.append({"label": label, "start_word": int(np.searchsorted(edges, a)), "end_word": int(np.searchsorted(edges, b - 1)) + 1, "edits": edits})
            score = max(score, 1.0 - edits / max(1, b - a))
        every = labels | {s["label"] for s in spans}
        return len(begin), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, spans


_SEPARATORS = bytes.maketrans(bytes(i for i in range(256) if not _WORD[i]), b" " * int((~_WORD).sum()))


def _split(low: bytes) -> list[str]:
    return [w for w in low.translate(_SEPARATORS).decode().split(" ") if w]


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row.

    The base columns count exact phrases; ``spans`` has the fuzzy notices, by word, with their edits;
    ``score`` is 1 for a base phrase, else the best notice's share of characters without an edit.
    """
    phrases, listed = phrases or PHRASES, notices_of(NOTICES if notices is None else notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, listed)
        names = RESULT.names
        for batch in batches:
            rows = [scanner.scan(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[id_col, *names])

    picked = docs.select(id_col, text_col)
    return picked.mapInArrow(run, T.StructType([picked.schema[id_col], *RESULT.fields]))
