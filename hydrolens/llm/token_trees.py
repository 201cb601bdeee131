"""Token counts that follow edits.

Byte-pair merges never cross pre-tokens, so a text's count is the sum over them. A document
keeps a segment tree: leaves of some pre-tokens each, and the sums of characters and
tokens of every subtree. An edit finds its leaves by descending the sums, splits and
encodes only these and what is needed until a pre-token ends again where a leaf did
before, and updates the sums on the way up.

Context: splitting reads at most two characters beyond a pre-token's end (``LOOKAHEAD``),
so pre-tokens that end further before an edit stay as they are; and the splitter keeps no
state, so once a pre-token ends at an old border beyond the edit, all that follow are the old
ones. Counts therefore equal those of the edited text counted anew (``tests/llm``).

Trees are two array columns beside the text (characters and tokens of each leaf), so they
can be stored with the documents. Edits of a document are its script, an array in order; each
position counts code points of the text as the edits before have left it.

Defined cases: a null text counts as empty, a null script as no edits; very long texts have
larger trees, whose edits still touch few leaves; positions and
lengths beyond the text are cut to it; a null insertion is empty; rows are independent, so
repeated rows get equal results and null ids pass through; an empty table gives an empty
table. ``with_trees`` replaces columns of the names it adds; all else is handed on.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.llm.tables import hidden

LEAF = 32  # pre-tokens of a new leaf
SPLIT = 4 * LEAF  # pre-tokens from which a leaf is split
LOOKAHEAD = 2
REMEMBERED = 300_000  # pre-tokens whose counts a task remembers
SCRIPT = "array<struct<at:bigint,removed:bigint,inserted:string>>"


class Counter:
    """Pre-tokens of a text, and tokens of a pre-token."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known, out = self.known.get, []
        for piece in pieces:
            n = known(piece)
            out.append(self._count(piece) if n is None else n)
        return out

    def _count(self, piece: str) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            self.known[piece] = n
        return n


class Tree:
    """Leaves' texts, and sums by subtree: node i has the children 2i and 2i + 1."""

    def __init__(self, counter: Counter, texts: list[str], tokens: list[int]):
        self.counter, self.reencoded = counter, 0
        self._grow(texts, tokens)

    @classmethod
    def of(cls, counter: Counter, text: str) -> Tree:
        return cls(counter, *leaves(counter, counter.split(text)))

    def _grow(self, texts: list[str], tokens: list[int]) -> None:
        self.width = 1
        while self.width < len(texts):
            self.width *= 2
        empty = self.width - len(texts)
        self.texts = texts + [""] * empty
        self.chars = [0] * self.width + [len(t) for t in texts] + [0] * empty
        self.tokens = [0] * self.width + tokens + [0] * empty
        for node in range(self.width - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = leaf + self.width
        more_chars, more_tokens = len(text) - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf with the character at a position, and the leaf's first position."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def edit(self, at: int, removed: int, inserted: str) -> None:
        at = min(max(at, 0), self.chars[1])
        end = min(at + max(removed, 0), self.chars[1])
        first, start = self.find(max(at - LOOKAHEAD, 0))
        last, _ = self.find(end)
        last = max(first, last)
        old = "".join(self.texts[first : last + 1])
        text = old[: at - start] + inserted + old[end - start :]
        while True:
            context, after = "", last + 1
            while after < self.width and len(context) < LOOKAHEAD:
                context += self.texts[after]
                after += 1
            pieces, size = [], 0
            for piece in self.counter.split(text + context):
                if size >= len(text):
                    break
                pieces.append(piece)
                size += len(piece)
            self.reencoded += size
            if size == len(text):
                break
            last = after - 1  # a pre-token crosses the leaf's old border
            text += context
        if len(pieces) < SPLIT:
            self._put(first, text, sum(self.counter.counts(pieces)))
            for leaf in range(first + 1, last + 1):
                if self.texts[leaf]:
                    self._put(leaf, "", 0)
            return
        texts, tokens = leaves(self.counter, pieces)
        base = self.width
        before = [(self.texts[i], self.tokens[base + i]) for i in range(first)]
        behind = [(self.texts[i], self.tokens[base + i]) for i in range(last + 1, base)]
        every = [x for x in [*before, *zip(texts, tokens), *behind] if x[0]]
        self._grow([t for t, _ in every], [n for _, n in every])


def leaves(counter: Counter, pieces: list[str]) -> tuple[list[str], list[int]]:
    counts = counter.counts(pieces)
    starts = range(0, len(pieces), LEAF)
    return ["".join(pieces[i : i + LEAF]) for i in starts], [sum(counts[i : i + LEAF]) for i in starts]


def _counter(df: DataFrame, path: str, pattern: str):
    with open(path, "rb") as file:  # a vocabulary, read by the driver and sent to the tasks
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    return lambda: Counter(shared.value, pattern)


def with_trees(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns, with ``leaf_chars`` and ``leaf_tokens``."""
    counter = _counter(docs, path, pattern)

    @F.arrow_udf("leaf_chars array<int>, leaf_tokens array<int>")
    def grown(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter()
        for batch in batches:
            trees = [leaves(own, own.split(text.as_py() or "")) for text in batch]
            chars = pa.array([[len(t) for t in texts] for texts, _ in trees], pa.list_(pa.int32()))
            tokens = pa.array([tokens for _, tokens in trees], pa.list_(pa.int32()))
            yield pa.StructArray.from_arrays([chars, tokens], ["leaf_chars", "leaf_tokens"])

    own = hidden(docs, "tree")
    tree = docs.withColumn(own, grown(F.col(text_col).cast("string")))
    return tree.withColumns({name: F.col(own)[name] for name in ("leaf_chars", "leaf_tokens")}).drop(own)


def edited(
    trees: DataFrame, path: str, pattern: str, script_col: str = "script", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts before and after each document's script, the edited text and its tree:
    ``doc_id``, ``n_tokens``, ``n_edits``, ``n_chars``, ``n_tokens_after``, ``n_reencoded``
    (characters that had to be encoded again), ``text``, ``leaf_chars``, ``leaf_tokens``."""
    counter = _counter(trees, path, pattern)
    schema = (
        "doc_id long, n_tokens long, n_edits long, n_chars long, n_tokens_after long, n_reencoded long, "
        "text string, leaf_chars array<int>, leaf_tokens array<int>"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter()
        kinds = [pa.int64()] * 6 + [pa.string()] + [pa.list_(pa.int32())] * 2
        for batch in batches:
            rows = [_edited_row(own, *(value.as_py() for value in row)) for row in zip(*batch.columns)]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return trees.select(
        F.col(id_col).cast("long"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")),
        "leaf_chars",
        "leaf_tokens",
        F.coalesce(F.col(script_col).cast(SCRIPT), F.array().cast(SCRIPT)),
    ).mapInArrow(run, schema)


def _edited_row(counter: Counter, doc_id, text: str, chars: list[int], tokens: list[int], script: list[dict]) -> tuple:
    texts, at = [], 0
    for n in chars:
        texts.append(text[at : at + n])
        at += n
    tree = Tree(counter, texts, tokens)
    before = tree.tokens[1]
    for edit in script:
        if edit is not None:
            tree.edit(edit["at"] or 0, edit["removed"] or 0, edit["inserted"] or "")
    own = [(t, n) for t, n in zip(tree.texts, tree.tokens[tree.width :]) if t]
    after = "".join(t for t, _ in own)
    sizes, counts = [len(t) for t, _ in own], [n for _, n in own]
    return doc_id, before, len(script), len(after), tree.tokens[1], tree.reencoded, after, sizes, counts


def sample_script(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A script for any document, made from the document itself: replace a dozen characters
    in the middle by the first ones, insert the id at a quarter, drop the first three, and
    repeat the last forty at the end."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.length(text).cast("long")

    def edit(at, removed, inserted):
        return F.struct(at.cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))

    return F.array(
        edit(F.floor(n / 2), 12, F.substring(text, 1, 12)),
        edit(F.floor(n / 4), 0, F.concat_ws("", F.lit(" "), F.col(id_col).cast("string"), F.lit(" "))),
        edit(F.lit(0), 3, F.lit("")),
        edit(n + 1000, 0, F.substring(text, -40, 40)),
    )
