"""License scans: fuzzy search for short notices.

A notice that occurs with at most ``e`` errors contains one of any ``e + 1`` parts of it unchanged (pigeonhole), so an
Aho-Corasick pass over a text's words looks for the parts of all notices at once. Around each part found, the regex
library matches the whole notice with bounded errors, and the best match gives its span and its edits.

Words are runs of a-z, 0-9 and anything beyond ASCII, A-Z folded; notices are searched in the words joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from millrace.llm.words import rows_of

# fixed values: phrases that are counted exactly, and their labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# notices that are searched with errors, and their labels; end of fixed values below
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under cc by": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "eclipse public license": "epl",
    "boost software license": "bsl",
}  # end of fixed values
ERROR_EVERY = 9  # characters of a notice for each error it may have
_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else 0x20 for c in range(256))

SCHEMA = "doc_id long, n_words long, matches array<struct<label:string,exact:boolean,word:long,start:int,end:int,errors:int,score:double>>"


class Match(NamedTuple):
    label: str
    exact: bool  # a base phrase; otherwise a notice found with errors
    word: int  # the first word's place
    start: int  # the span in the joined words
    end: int
    errors: int
    score: float


class Notice(NamedTuple):
    text: str
    label: str
    errors: int
    pattern: object


def joined_words(text: str | None) -> str:
    """The words of a text, each between single spaces."""
    if not text:
        return " "
    found = text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()
    return f" {b' '.join(found).decode('utf-8', 'surrogatepass')} " if found else " "


def seed_parts(text: str, errors: int) -> list[tuple[int, str]]:
    """The text cut into ``errors + 1`` parts of about equal length, with their places."""
    n = errors + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def _automaton(notices: tuple[tuple[str, str], ...], error_every: int):
    automaton, found = ahocorasick.Automaton(), []
    parts: dict[str, list[tuple[int, int]]] = {}
    for text, label in notices:
        errors = len(text) // error_every
        pattern = regex.compile(rf"(?<= )(?:{regex.escape(text, special_only=True)}){{e<={errors}}}(?= )", regex.BESTMATCH)
        for at, part in seed_parts(text, errors):
            parts.setdefault(part, []).append((len(found), at))
        found.append(Notice(text, label, errors, pattern))
    for part, owners in parts.items():
        automaton.add_word(part, (len(part), owners))
    automaton.make_automaton()
    return automaton, found


def notices_in(joined: str, notices: tuple[tuple[str, str], ...], error_every: int = ERROR_EVERY) -> list[tuple[int, int, int, Notice]]:
    """Spans of notices and their errors: non-overlapping for each notice, the best first among overlapping ones."""
    automaton, known = _automaton(notices, error_every)
    windows: dict[int, list[list[int]]] = {}
    for last, (length, owners) in automaton.iter(joined):
        start = last - length + 1
        for i, at in owners:
            slack = known[i].errors + 1
            low, high = max(0, start - at - slack), min(len(joined), start - at + len(known[i].text) + slack)
            spans = windows.setdefault(i, [])
            if spans and low <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], high)
            else:
                spans.append([low, high])
    out = []
    for i, spans in windows.items():
        for low, high in spans:
            todo = [(low, high)]
            while todo:  # the best match of a part, then what lies before and behind it
                low, high = todo.pop()
                if m := known[i].pattern.search(joined, low, high):
                    out.append((m.start(), m.end(), sum(m.fuzzy_counts), known[i]))
                    todo += [(low, m.start()), (m.end(), high)]
    return sorted(out, key=lambda x: (x[0], x[1], x[3].text))


def matches(text: str | None, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> tuple[int, list[Match]]:
    """Number of words, and every base phrase and notice of a text."""
    joined = joined_words(text)
    n = joined.count(" ") - 1 if len(joined) > 1 else 0
    out = []
    for phrase, label in base.items():
        at = joined.find(f" {phrase} ")
        while at >= 0:
            out.append(Match(label, True, at, at + 1, at + 1 + len(phrase), 0, 1.0))
            at = joined.find(f" {phrase} ", at + 1)
    for start, end, errors, notice in notices_in(joined, tuple(notices.items())):
        out.append(Match(notice.label, False, start - 1, start, end, errors, 1.0 - errors / len(notice.text)))
    if out:  # the space before a match tells its word: one pass over the text for all of them
        spaces = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == ord(" "))
        places = np.searchsorted(spaces, [m.word for m in out]).tolist()
        out = [m._replace(word=word) for m, word in zip(out, places, strict=True)]
    return n, out


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """``doc_id``, ``n_words`` and ``matches`` of every row of ``docs``; NULL and empty texts have no words.

    Spans count code points in the text's words joined by one space, with one space before the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        matched = pa.list_(pa.struct(list(zip(Match._fields, types))))
        for batch in batches:
            ids, sizes, found = [], [], []
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                n, own = matches(text, base, notices)
                ids.append(doc_id)
                sizes.append(n)
                found.append([m._asdict() for m in own])
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, matched)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "matches"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
