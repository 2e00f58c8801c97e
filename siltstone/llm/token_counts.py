"""Edit-aware token counts (operator 2).

A document is cut into leaves of about ``LEAF`` characters, always between a character
that is no white space and a space or newline: there no pre-token of the byte-level
tokenizers can lie across, so leaves' counts add up to the text's count exactly. Two
segment trees over the leaves hold sums of characters and of tokens. An edit finds its
leaves by character position, widens them while a border is no longer such a cut
(boundary context), re-encodes that region alone and updates the sums above it.

Slots are fixed when the tree is built: a region's new text is spread over the slots it
replaces (some may become empty, the last may grow), so the tree keeps its shape.

Defined results: a null or empty text has 0 tokens and takes insertions only. Positions
are in characters of the text as it is when the edit is applied, edits apply in order;
positions beyond the text are its end, an end before the start is the start, a null
replacement is empty. Repeated documents each get their row; extra columns are ignored. No rows
give no rows. A text of any length is one tree; where it has no cut it is one leaf, which an edit
encodes whole.
"""

from __future__ import annotations

import base64
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 512
_CUT = re.compile(r"(?s).{%d,}?\S(?=[ \n])|.+" % LEAF)
_EMAIL = re.compile(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[0-9]{5,}")

_ENCODINGS: dict = {}


def counter(ranks: str | None = None):
    """A function from texts to token counts: byte-level BPE from a tiktoken rank file."""
    import public_tokenizers as public
    import tiktoken

    ranks = ranks or public.path("byte_bpe_50k.tiktoken")
    if ranks not in _ENCODINGS:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("counts", pat_str=public.PATTERN, mergeable_ranks=table, special_tokens={})
        _ENCODINGS[ranks] = lambda text: len(encoding.encode_ordinary(text))
    return _ENCODINGS[ranks]


def leaves_of(text: str) -> list[str]:
    return _CUT.findall(text)


class TokenTree:
    """Leaves of one text with segment trees (heaps; node 1 is the root) of characters and tokens."""

    def __init__(self, text: str | None, count, sizes: list[int] | None = None, counts: list[int] | None = None):
        """``sizes`` and ``counts``: characters and tokens of the leaves, if they are known."""
        self.count = count
        ends = list(accumulate(sizes, initial=0)) if sizes else []
        self.leaves = [text[a:b] for a, b in zip(ends, ends[1:])] if text and sizes else leaves_of(text or "") or [""]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        counts = counts if counts is not None else [count(x) for x in self.leaves]
        pad = [0] * (self.width - len(self.leaves))
        self.chars = self._heap([len(x) for x in self.leaves] + pad)
        self.tokens = self._heap(counts + pad)
        self.encoded = 0  # characters encoded again by edits

    @staticmethod
    def _heap(level: list[int]) -> list[int]:
        out = level
        while len(level) > 1:
            level = [a + b for a, b in zip(level[::2], level[1::2])]
            out = level + out
        return [0, *out]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf at the end), and the offset in it."""
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node] and (at > self.chars[node] or self.chars[node + 1]):
                at -= self.chars[node]
                node += 1
        leaf = min(node - self.width, len(self.leaves) - 1)
        return leaf, at if leaf == node - self.width else len(self.leaves[leaf])

    def tokens_before(self, leaf: int) -> int:
        """Tokens of the leaves before ``leaf``."""
        node, out = leaf + self.width, 0
        while node > 1:
            if node & 1:
                out += self.tokens[node - 1]
            node //= 2
        return out

    def _set(self, leaf: int, text: str, tokens: int):
        self.leaves[leaf] = text
        node = leaf + self.width
        more, chars = tokens - self.tokens[node], len(text) - self.chars[node]
        while node:
            self.tokens[node] += more
            self.chars[node] += chars
            node //= 2

    def edit(self, start: int, stop: int, text: str | None):
        """Replace characters [start, stop) by ``text``."""
        size = self.chars[1]
        start = max(0, min(start, size))
        stop = max(start, min(stop, size))
        first, a = self.find(start)
        last, b = self.find(stop)
        region = self.leaves[first][:a] + (text or "") + self.leaves[last][b:]
        while first > 0 and (region[:1] not in (" ", "\n") or self.leaves[first - 1][-1:].isspace() or not self.leaves[first - 1]):
            first -= 1
            region = self.leaves[first] + region
        while last + 1 < len(self.leaves) and (not region or region[-1].isspace() or self.leaves[last + 1][:1] not in (" ", "\n")):
            last += 1
            region += self.leaves[last]
        pieces = leaves_of(region)
        slots = last - first + 1
        if len(pieces) > slots:
            pieces[slots - 1 :] = ["".join(pieces[slots - 1 :])]
        pieces += [""] * (slots - len(pieces))
        for leaf, piece in enumerate(pieces, first):
            if piece != self.leaves[leaf]:
                self.encoded += len(piece)
                self._set(leaf, piece, self.count(piece) if piece else 0)


def redactions(text: str | None) -> list[tuple[int, int, str]]:
    """Edits a corpus gets before training, last position first: e-mail addresses and long
    numbers are masked, second and later copies of a line go."""
    if not text:
        return []
    found, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line and line in seen:
            found.append((max(0, at - 1), at + len(line), ""))
        else:
            seen.add(line)
            if "@" in line:
                found += [(at + m.start(), at + m.end(), "[EMAIL]") for m in _EMAIL.finditer(line)]
            masked = [(a, b) for a, b, _ in found if b > at]
            found += [
                (at + m.start(), at + m.end(), "[NUMBER]")
                for m in _NUMBER.finditer(line)
                if not any(a < at + m.end() and at + m.start() < b for a, b in masked)
            ]
        at += len(line) + 1
    return sorted(found, reverse=True)


def edited_counts(docs: DataFrame, editor=redactions, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_edited, n_chars_encoded (again, by the edits) of every row.

    ``editor``: a function of the text that returns edits in order of application.
    """

    def run(batches):
        count = counter(ranks)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                tree = TokenTree(text, count)
                before, edits = tree.total, editor(text)
                for edit in edits:
                    tree.edit(*edit)
                rows.append((before, len(edits), tree.total, tree.chars[1], tree.encoded))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]],
                ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long"
    )


def build_trees(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, text, leaf_chars and leaf_tokens: what later edits start from, to be stored."""

    def run(batches):
        count = counter(ranks)
        for batch in batches:
            trees = [TokenTree(t, count) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array([[len(x) for x in t.leaves] for t in trees], pa.list_(pa.int32())),
                    pa.array([t.tokens[t.width : t.width + len(t.leaves)] for t in trees], pa.list_(pa.int32())),
                ],
                ["doc_id", "text", "leaf_chars", "leaf_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>")


def apply_edits(trees: DataFrame, edits: DataFrame, ranks: str | None = None) -> DataFrame:
    """Trees after edits (doc_id, seq, start, stop, replacement); same columns plus n_tokens.

    Documents without edits pass unchanged; edits of unknown or null ids do nothing.
    """
    script = F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "replacement"))).alias("script")
    rows = trees.join(edits.groupBy(F.col("doc_id").alias("edited")).agg(script), F.col("doc_id") == F.col("edited"), "left")

    def run(batches):
        count = counter(ranks)
        for batch in batches:
            texts, chars, tokens, totals = [], [], [], []
            for text, sizes, held, script in zip(*(batch.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "script"))):
                tree = TokenTree(text, count, sizes, held if text else None)
                for e in script or ():
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["replacement"])
                text = tree.text() if script else text
                texts.append(text)
                chars.append([len(x) for x in tree.leaves])
                tokens.append(tree.tokens[tree.width : tree.width + len(tree.leaves)])
                totals.append(tree.total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), pa.array(totals, pa.int64())],
                ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens"],
            )

    kind = trees.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "leaf_chars", "leaf_tokens", "script").mapInArrow(
        run, f"doc_id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"
    )
