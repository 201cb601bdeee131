"""License notices in texts: exact phrases, and short notices with a few typing errors.

A notice of at most k errors, cut into k + 1 pieces, holds one of them unchanged
(pigeonhole). So pieces are looked for exactly, and only around them the ``regex``
library's bounded-error matching verifies a notice and gives its span and errors. Every
occurrence of a piece is verified, so every place a notice stands is found. Short words that
tell licenses apart (``mit``, ``nc``) must stand as they are, or joined to the word beside
them: ``mpl`` or ``by sa`` in their place is another license, not a typing error.

Words are lower-cased runs of letters and digits (and all that isn't ASCII); notices
are looked for in the words joined by spaces, so marks and line ends don't matter.

Defined cases: a null text counts as empty; texts without words have no labels and
score 0; notices that overlap are all reported, of one notice's overlapping spans the
one with fewest errors, then the first; very long texts are scanned whole; rows are independent, so repeated rows get
equal results and a null id passes through; an empty table gives an empty table.
Results have the columns named here only, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Exact phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Short notices, found with errors, and their labels.
NOTICES = {
    "under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

#: One error is allowed for so many characters of a notice.
CHARACTERS_PER_ERROR = 10

#: Words of notices that tell licenses apart and allow no error.
TELLING = {"mit", "nc", "2"}

#: ASCII marks and blanks become spaces, A-Z become a-z.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = rb"[0-9a-z\x80-\xff]"


@dataclass(frozen=True)
class Span:
    label: str
    first_word: int
    n_words: int
    errors: int
    score: float


class Notice:
    """A notice's pieces and its matcher."""

    def __init__(self, text: str, label: str):
        self.text, self.label = text.encode(), label
        self.errors = len(self.text) // CHARACTERS_PER_ERROR
        size = len(self.text) / (self.errors + 1)
        cuts = [round(size * i) for i in range(self.errors + 2)]
        self.pieces = [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:])]
        body = regex.escape(self.text.decode(), special_only=True).encode()
        self.matcher = regex.compile(
            rb"(?<!" + _WORD + rb")(?:" + body + rb"){e<=%d}(?!" % self.errors + _WORD + rb")", regex.ENHANCEMATCH
        )
        own = text.split()
        self.telling = []
        for i, word in enumerate(own):
            if word in TELLING:
                before = b"".join(b"|" + regex.escape(w.encode()) for w in own[max(0, i - 1) : i])
                after = b"".join(b"|" + regex.escape(w.encode()) for w in own[i + 1 : i + 2])
                self.telling.append(
                    regex.compile(rb"(?:(?<!" + _WORD + rb")" + before + rb")" + word.encode() + rb"(?:(?!" + _WORD + rb")" + after + rb")")
                )

    def windows(self, joined: bytes) -> list[tuple[int, int]]:
        """Where the notice can stand: around each piece, neighbours made one."""
        found = []
        for piece, offset in self.pieces:
            at = joined.find(piece)
            while at >= 0:
                start = at - offset - self.errors - 1
                found.append((max(0, start), at - offset + len(self.text) + self.errors + 1))
                at = joined.find(piece, at + 1)
        found.sort()
        merged: list[tuple[int, int]] = []
        for start, end in found:
            if merged and start <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(end, merged[-1][1])
            else:
                merged.append((start, end))
        return merged

    def spans(self, joined: bytes) -> Iterator[Span]:
        for start, end in self.windows(joined):
            best: list[tuple[int, int, int]] = []
            at = start
            while match := self.matcher.search(joined, at, min(end, len(joined))):
                left, right = match.span()
                found = sum(match.fuzzy_counts), left, right
                if not all(word.search(match[0]) for word in self.telling):
                    pass
                elif best and left < best[-1][2]:
                    best[-1] = min(best[-1], found)
                else:
                    best.append(found)
                at = joined.find(b" ", left) + 1  # a better one may start within
                if not at or at >= end:
                    break
            for errors, left, right in best:
                text = joined[left:right].strip(b" ")
                left += len(joined[left:right]) - len(joined[left:right].lstrip(b" "))
                yield Span(
                    self.label, joined.count(b" ", 0, left), text.count(b" ") + 1, errors, 1 - errors / len(self.text)
                )


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        self.phrases = [(f" {text} ".encode(), label) for text, label in phrases.items()]
        self.notices = [Notice(text, label) for text, label in notices.items()]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[Span]]:
        """Number of words, places of the phrases with their labels, and spans of the notices."""
        words = (text or "").encode().translate(_PLAIN).split()
        joined = b" ".join(words)
        around = b" " + joined + b" "
        places = []
        for phrase, label in self.phrases:
            at = around.find(phrase)
            while at >= 0:
                places.append((around.count(b" ", 0, at), label))
                at = around.find(phrase, at + 1)
        spans = [span for notice in self.notices for span in notice.spans(joined)]
        return len(words), places, sorted(spans, key=lambda s: (s.first_word, s.label, s.n_words))


def _mapped(docs: DataFrame, id_col: str, text_col: str, phrases, notices, schema: str, rows) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        kinds = [types[part.split()[1]] for part in schema.split(", ")]
        for batch in batches:
            out = [r for i, t in zip(batch.column(0), batch.column(1)) for r in rows(i.as_py(), scanner.scan(t.as_py()))]
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    """One row for each place of a notice: ``doc_id``, ``label``, ``first_word``, ``n_words``, ``errors``, ``score``."""

    def rows(doc_id, scanned):
        return [(doc_id, s.label, s.first_word, s.n_words, s.errors, s.score) for s in scanned[2]]

    schema = "doc_id long, label string, first_word long, n_words long, errors long, score double"
    return _mapped(docs, id_col, text_col, {}, notices or NOTICES, schema, rows)


def labels(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
) -> DataFrame:
    """One row for each text: words, places of the phrases, labels of both kinds, and
    the score of the surest (1 for a phrase)."""

    def rows(doc_id, scanned):
        n, places, found = scanned
        starts = [at for at, _ in places]
        base = {label for _, label in places}
        score = 1.0 if places else max((s.score for s in found), default=0.0)
        first, last = (min(starts), max(starts)) if starts else (None, None)
        both = base | {s.label for s in found}
        return [(doc_id, n, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(both)), score)]

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double"
    )
    return _mapped(docs, id_col, text_col, phrases or PHRASES, notices or NOTICES, schema, rows)
