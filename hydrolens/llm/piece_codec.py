"""Exact encoding and decoding with a SentencePiece BPE model.

The library merges the best-scored adjacent pair again and again. Here a text is
encoded by backtracking instead: an Aho-Corasick automaton finds all vocabulary
pieces that start at each position; the longest is tried first; a piece may
follow another only if re-merging the two strings gives these two pieces; a
position from which no continuation exists is marked in a bit field, and not tried
again. The result equals the library's (``tests/llm`` compare both).

Texts are cut where no piece can span: before a run of spaces, between Latin
letters and ASCII marks, and around characters outside the vocabulary (the model is
tested for this when it is read). Cuts therefore change no id. Encoded parts are
remembered in dictionaries of bounded size, which affects time only.

Defined cases: a null text counts as empty; an empty text has no ids and decodes
to an empty text; rows are independent, so repeated rows get equal results and a
null id passes through; an empty table gives an empty table. Results have the
columns named here only, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"  # how the vocabulary writes a space
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = re.escape(string.punctuation)
REMEMBERED = 150_000  # entries of a task's dictionaries; full ones are replaced
ROWS = 256  # of a batch at a time


@dataclass(frozen=True)
class Vocabulary:
    """Normal pieces with id and score, byte pieces, and what decodes to nothing."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    surfaces: list[str | None]  # by id; None for byte pieces
    halves: dict[str, tuple[str, str]] = field(default_factory=dict)
    """The two pieces that a piece is merged from at last, ``(piece, "")`` for a
    character. Holds the pieces that merging their own characters gives."""

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a BPE model with byte fallback, identity normalisation and a dummy prefix."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.encode("\n  a", out_type=int) != model.encode(f"\n {SPACE}a", out_type=int):
            raise ValueError("the model must escape spaces and nothing else")
        pieces, byte_ids, surfaces = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surfaces.append(None)
            elif model.is_control(i):
                surfaces.append("")
            elif model.is_unknown(i):
                surfaces.append(model.decode([i]))
            else:
                pieces[piece] = (i, model.get_score(i))
                surfaces.append(piece.replace(SPACE, " "))
        if any(SPACE in piece.lstrip(SPACE) for piece in pieces) or not all(byte_ids[1:]):
            raise ValueError("pieces must not span words, and bytes must be pieces")
        if any(re.search(f"[{LETTERS}][{MARKS}]|[{MARKS}][{LETTERS}]", piece) for piece in pieces):
            raise ValueError("pieces must not join letters and marks")
        known, halves = cls(pieces, byte_ids, surfaces), {}
        for piece in pieces:
            last = {piece: (piece, "")}
            if known.merged(piece, last) == [piece]:
                halves[piece] = last[piece]
        for piece, (left, right) in halves.items():
            if right and set(piece) != {SPACE} and any(
                half not in halves or halves[half][1] and pieces[half][1] <= pieces[piece][1]
                for half in (left, right)
            ):
                raise ValueError("a piece must score less than the pieces it is merged from")
        return cls(pieces, byte_ids, surfaces, halves)

    def merged(self, text: str, last: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Merge the best-scored pair, the leftmost of equals, until none is left.
        ``last`` takes the two halves of every merge."""
        parts = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(parts):
                both = parts[left] + parts[right]
                if both in self.pieces:
                    heapq.heappush(queue, (-self.pieces[both][1], left, both))

        for left in range(len(parts)):
            offer(left)
        while queue:
            _, left, both = heapq.heappop(queue)
            right = after[left]
            if not parts[left] or right >= len(parts) or parts[left] + parts[right] != both:
                continue
            if last is not None:
                last[both] = parts[left], parts[right]
            parts[left], parts[right] = both, ""
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [part for part in parts if part]


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece in vocabulary.halves:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.byte_of = {i: byte for byte, i in enumerate(vocabulary.byte_ids)}
        self.spaced = frozenset(i for piece, (i, _) in vocabulary.pieces.items() if piece[0] == SPACE)
        self.letters = frozenset(piece for piece in vocabulary.pieces if len(piece) == 1)
        outside = "".join(c for c in "\t\n\r" if c not in vocabulary.pieces)
        letters, marks, stop = f"[{LETTERS}]", f"[{MARKS}]", f"[{SPACE}{outside}]"
        self.parts = re.compile(
            rf"{SPACE}*{letters}+(?={marks}|{stop}|\Z)|{SPACE}*{marks}+(?={letters}|{stop}|\Z)"
            rf"|{SPACE}*[^{SPACE}{outside}]+?(?:(?<={letters})(?={marks})|(?<={marks})(?={letters})|(?={stop}|\Z))"
            rf"|{SPACE}+" + (f"|[{outside}]" if outside else "")
        )
        self.follows: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives exactly these two.

        Merges happen in the order of scores. So go back in time from the two whole
        pieces, undo the younger one's last merge at each step, and see whether the
        two at the seam would have merged with each other before that.
        """
        if len(self.follows) >= REMEMBERED:
            self.follows.clear()
        valid = self.follows[left, right] = self._apart(left, right)
        return valid

    def _apart(self, left: str, right: str) -> bool:
        pieces, halves = self.vocabulary.pieces, self.vocabulary.halves
        left_ends = right_ends = float("-inf")  # scores of the merges that take them in
        while True:
            seam = pieces.get(left + right)
            # Of equal pieces the leftmost merges first.
            if seam and seam[1] > left_ends and seam[1] >= right_ends:
                return False
            left_parts, right_parts = halves[left], halves[right]
            if not left_parts[1] and not right_parts[1]:
                return True
            if not right_parts[1] or left_parts[1] and pieces[left][1] < pieces[right][1]:
                left_ends, left = pieces[left][1], left_parts[1]
            else:
                right_ends, right = pieces[right][1], right_parts[0]

    def backtracked(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are in the vocabulary."""
        lengths: list[list[int]] = [[] for _ in text]
        for end, length in self.automaton.iter(text):
            lengths[end + 1 - length].append(length)  # the longest comes last
        chosen: list[tuple[str, int]] = []
        failed = bytearray(len(text) // 8 + 1)
        follows, before = self.follows, ""
        at, option, size = 0, len(lengths[0]) - 1, len(text)
        while True:
            while option >= 0:
                end = at + lengths[at][option]
                if not failed[end >> 3] >> (end & 7) & 1:
                    piece = text[at:end]
                    if not before:
                        break
                    valid = follows.get((before, piece))
                    if valid or valid is None and self.may_follow(before, piece):
                        break
                option -= 1
            if option >= 0:
                chosen.append((piece, option))
                if end == size:
                    return [piece for piece, _ in chosen]
                before, at = piece, end
                option = len(lengths[at]) - 1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece, option = chosen.pop()
                before = chosen[-1][0] if chosen else ""
                at -= len(piece)
                option -= 1

    def _word(self, text: str) -> list[str]:
        """Pieces of a text with at most one leading space; characters outside the
        vocabulary stay as single pieces."""
        if text and self.letters.issuperset(text):
            return self.backtracked(text)
        pieces, run = [], []
        for c in text:
            if c in self.vocabulary.pieces:
                run.append(c)
                continue
            if run:
                pieces += self.backtracked("".join(run))
                run = []
            pieces.append(c)
        return pieces + (self.backtracked("".join(run)) if run else [])

    def encode_part(self, part: str) -> list[int]:
        """Ids of a run of spaces and the word after it. Pieces of several spaces
        have the lowest score of all and tie, so they merge after all words, by the
        merging rule itself."""
        word = part.lstrip(SPACE)
        spaces = len(part) - len(word)
        pieces = self._word(SPACE + word if spaces and word else word)
        if spaces > 1 or not word:
            alone = not word or pieces[0] == SPACE
            left = SPACE * (spaces - (not alone))
            pieces = self.vocabulary.merged(left) + (pieces[1:] if alone and word else pieces)
        ids = []
        for piece in pieces:
            known = self.vocabulary.pieces.get(piece)
            ids += [known[0]] if known else [self.vocabulary.byte_ids[b] for b in piece.encode()]
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the dummy prefix goes from the first piece that isn't a control."""
        first = next((i for i in ids if self.vocabulary.surfaces[i] != ""), None)
        return self._surface(ids)[first in self.spaced :]

    def _surface(self, ids: list[int]) -> str:
        try:
            return "".join([self.vocabulary.surfaces[i] for i in ids])
        except TypeError:  # byte pieces, which have no text of their own
            text, run = [], bytearray()
        for i in ids:
            surface = self.vocabulary.surfaces[i]
            if surface is None:
                run.append(self.byte_of[i])
                continue
            text.append(_readable(run) + surface)
            run.clear()
        return "".join(text) + _readable(run)

    def _part(self, part: str) -> tuple[str, str]:
        """Ids of a part, joined by commas, and the text these ids decode to."""
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        if not (found := self.older.get(part)):
            ids = self.encode_part(part)
            found = ",".join(map(str, ids)), self._surface(ids)
        if len(part) <= 64:
            self.known[part] = found
        return found

    def both(self, text: str | None) -> tuple[str, str]:
        """Decimal ids joined by commas, and the decoded text."""
        if not text:
            return "", ""
        known, encode = self.known.get, self._part
        done = [known(p) or encode(p) for p in self.parts.findall(SPACE + text.replace(" ", SPACE))]
        return ",".join([ids for ids, _ in done]), "".join([s for _, s in done]).removeprefix(" ")

    def encode(self, text: str | None) -> list[int]:
        ids, _ = self.both(text)
        return list(map(int, ids.split(","))) if ids else []


def _readable(run: bytearray) -> str:
    """Bytes as text; each byte of no character becomes one replacement character."""
    text = []
    for c in run.decode("utf-8", "surrogateescape"):
        text.append("�" if "\udc80" <= c <= "\udcff" else c)
    return "".join(text)


def _over_texts(docs: DataFrame, id_col: str, text_col: str, path: str, schema: str, row) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))  # one vocabulary, not data
    out = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, codec = to_arrow_schema(out), Codec(shared.value)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                rows = [row(codec, value.as_py()) for value in some.column(1)]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], schema=arrow)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, out)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``, the piece ids of each text."""
    return _over_texts(docs, id_col, text_col, path, f"`{id_col}` long, ids array<int>", lambda c, t: (c.encode(t),))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text``, decoded from arrays of ids; a null array counts as empty."""
    as_text = F.coalesce(F.array_join(ids_col, ","), F.lit(""))
    rows = encoded.select(F.col(id_col), as_text.alias("joined"))
    return _over_texts(
        rows,
        id_col,
        "joined",
        path,
        f"`{id_col}` long, text string",
        lambda c, t: (c.decode(list(map(int, t.split(","))) if t else []),),
    )


def digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Number of ids, and SHA-256 of the ids and of the text decoded from them; with
    ``with_ids`` also the ids.

    Encoded and decoded in one pass, so no array of ids need leave the task.
    """

    def row(codec: Codec, text: str | None) -> tuple:
        ids, decoded = codec.both(text)
        counted = (
            ids.count(",") + bool(ids),
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        )
        return (*counted, np.fromstring(ids, np.int32, sep=",")) if with_ids else counted

    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _over_texts(docs, id_col, text_col, path, schema + ", ids array<int>" * with_ids, row)
