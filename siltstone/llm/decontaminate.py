"""Benchmark decontamination with a generalised suffix automaton (operator 8).

Test items are normalised (A-Z lower-cased, words are runs of digits, letters
and non-ASCII characters) and inserted, word by word, into one automaton of all
their substrings. Each document's words are streamed through it; the longest
match length at a word tells whether a window (``window`` consecutive words of
an item, or a whole shorter item) ends there.

The automaton is broadcast. Its size is bounded: items are cut into shards of at
most ``shard_words`` words (an item is never split), one automaton for each. The
driver reads items shard by shard. Up to ``held`` automata are broadcast and scanned
in one narrow pass; what it finds is written to the shared folder before the next
are built, so that a benchmark of any size works with bounded memory.

Defined results: a null or wordless text has no words, no hits and the digest of
the empty string. Items with null or wordless text are ignored; an item with a
null id still marks words but adds no id. Repeated item ids count once, repeated
documents get one row each, extra columns of ``documents`` are not read by
:func:`scan` and are kept as they are by :func:`decontaminate`. No documents give no
rows, no items no hits; a text of any length is streamed whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from siltstone.llm._shared import drop_memo, fresh, give_back, materialize, release, sliced

WINDOW = 10
SHARD_WORDS = 100_000
HELD = 4  # automata of one pass

_TABLE = bytes(
    (c + 32) if 65 <= c <= 90 else c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256)
)
_RUN = re.compile(rb"[^ ]+")
_BITS = 1 << 22


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class ItemAutomaton:
    """Suffix automaton of all items' word sequences, with the windows' states marked."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        edges: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        sequences = []
        for item_id, words in items:
            if words:
                sequences.append((item_id, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]))
        for _, seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(edges, link, length, last, w)
        self.edges, self.link, self.length = edges, link, length
        # the state of each suffix of exactly `window` words, and of each whole short item
        self.ids: list[str | None] = [i for i, _ in sequences]
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        pairs = set()
        for n, (_, seq) in enumerate(sequences):
            pairs.update(zip(seq, seq[1:]))
            state = 0
            for at, w in enumerate(seq):
                state = edges[state][w]
                if at + 1 >= window:
                    self.full.setdefault(self._window_state(state), set()).add(n)
            if len(seq) < window:
                self.short.setdefault(state, []).append((len(seq), n))
        self.shortest = min([min(len(s), window) for _, s in sequences], default=0)
        self.mark = np.zeros(_BITS, dtype=bool)
        if pairs:
            p = np.array(sorted(pairs), dtype=np.int64)
            self.mark[self._slot(p[:, 0], p[:, 1])] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & (_BITS - 1)

    @staticmethod
    def _extend(edges, link, length, last, w) -> int:
        if w in edges[last]:
            q = edges[last][w]
            if length[q] == length[last] + 1:
                return q
            return ItemAutomaton._clone(edges, link, length, last, w, q)
        cur = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in edges[p]:
            edges[p][w] = cur
            p = link[p]
        if p != -1:
            q = edges[p][w]
            link[cur] = q if length[q] == length[p] + 1 else ItemAutomaton._clone(edges, link, length, p, w, q)
        return cur

    @staticmethod
    def _clone(edges, link, length, p, w, q) -> int:
        new = len(edges)
        edges.append(dict(edges[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and edges[p].get(w) == q:
            edges[p][w] = new
            p = link[p]
        return new

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, seq: list[int]):
        """Yield (end position, window length, item numbers) for every window that ends there."""
        edges, link, length, window = self.edges, self.link, self.length, self.window
        state = matched = 0
        for at, w in enumerate(seq):
            while state and w not in edges[state]:
                state = link[state]
                matched = length[state]
            if w in edges[state]:
                state = edges[state][w]
                matched += 1
            if matched >= window:
                s = self._window_state(state)
                if s in self.full:
                    yield at, window, self.full[s]
            if self.short:
                s = state
                while s > 0:
                    for k, n in self.short.get(s, ()):
                        if k <= matched:
                            yield at, k, (n,)
                    s = link[s]

    def scan(self, documents: list[list[bytes]]):
        """Per document: sorted disjoint hit spans (first word, end) and the items that hit."""
        get, sizes = self.vocab.get, [len(d) + 1 for d in documents]
        ids = np.fromiter((i for d in documents for i in (*[get(w, 0) for w in d], 0)), np.int64, sum(sizes))
        out = [([], set()) for _ in documents]
        if not self.shortest or not len(ids):
            return out
        joined = np.zeros(len(ids), dtype=bool)  # whether word i and i + 1 may follow each other in an item
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        joined[both] = self.mark[self._slot(ids[both], ids[both + 1])]
        starts = np.flatnonzero((ids > 0) & ~np.concatenate(([False], joined[:-1])))
        ends = np.flatnonzero((ids > 0) & ~joined) + 1
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        first = np.concatenate(([0], np.cumsum(sizes)))
        owner = np.searchsorted(first, starts, side="right") - 1
        for s, e, d in zip(starts.tolist(), ends.tolist(), owner.tolist()):
            spans, items = out[d]
            for at, k, found in self.stream(ids[s:e].tolist()):
                a, b = s + at - k + 1 - int(first[d]), s + at + 1 - int(first[d])
                items.update(found)
                while spans and spans[-1][0] >= a:  # a longer window may end here than the last one
                    b = max(b, spans.pop()[1])
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
        return out


def _merge(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def shards(benchmark: DataFrame, shard_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in shards of bounded size; read by one pass in id order, a shard at a time."""
    now, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).filter("t is not null")
    for row in rows.distinct().sort("i", "t").toLocalIterator():
        n = len(words_of(row.t))
        if not n:
            continue
        if now and held + n > shard_words:
            yield now
            now, held = [], 0
        now.append((row.i, words_of(row.t)))
        held += n
    if now:
        yield now


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_SPANS_TYPE = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))
_SCAN = "n_words long, spans array<struct<a: int, b: int>>, items array<string>"


def _search(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int, held: int, finish, schema) -> DataFrame:
    """``finish(batch, documents, spans, items)`` of each batch of ``docs``, once all shards are scanned.

    documents: the words; spans: hit word ranges; items: ids of items that hit. Between passes they are kept in two more columns.
    """
    context, width = docs.sparkSession.sparkContext, len(docs.columns)
    at, taken = docs.columns.index("text"), docs.columns
    names = [*taken, fresh("spans", taken), fresh("items", [*taken, "spans"])]
    between = StructType([*docs.schema.fields, StructField(names[-2], _SPANS_TYPE), StructField(names[-1], ArrayType(StringType()))])

    def keep(batch, documents, spans, items):
        return pa.RecordBatch.from_arrays([*batch.columns, _spans_array(spans), pa.array([sorted(i) for i in items], pa.list_(pa.string()))], names)

    def parts_of(batch):
        yield from sliced(batch, at, rows=500)
        give_back()

    def scanned(rows, automata, end, kinds):
        def run(batches):
            drop_memo()
            for whole in chain.from_iterable(map(parts_of, batches)):
                batch = whole.select(list(range(width)))
                documents = [words_of(t) for t in batch.column(at).to_pylist()]
                spans, items = [[] for _ in documents], [set() for _ in documents]
                if whole.num_columns > width:
                    spans = [[(s["a"], s["b"]) for s in x] for x in whole.column(width).to_pylist()]
                    items = [set(x) for x in whole.column(width + 1).to_pylist()]
                for shard in automata:
                    a = shard.value
                    for n, (found, numbers) in enumerate(a.scan(documents)):
                        if found:
                            spans[n] += found
                            items[n] |= {a.ids[i] for i in numbers} - {None}
                yield end(batch, documents, [_merge(x) for x in spans], items)

        return rows.mapInArrow(run, kinds)

    parts, rows = shards(benchmark, shard_words), docs
    automata = [context.broadcast(ItemAutomaton(s, window)) for s in islice(parts, held)]
    while (following := next(parts, None)) is not None:
        after = materialize(scanned(rows, automata, keep, between), "leaks")  # before the next automata are built
        for shard in automata:
            shard.destroy()
        if rows is not docs:
            release(rows)
        rows = after
        automata = [context.broadcast(ItemAutomaton(s, window)) for s in islice(chain([following], parts), held)]
    return scanned(rows, automata, finish, schema)


def _spans_array(spans) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], _SPANS)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, held: int = HELD) -> DataFrame:
    """Add n_words, spans (hit word ranges) and items (ids of items that hit) to doc_id and text."""

    def finish(batch, documents, spans, items):
        return pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array([len(d) for d in documents], pa.int64()),
                _spans_array(spans),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            ],
            ["doc_id", "text", "n_words", "spans", "items"],
        )

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, {_SCAN}"
    return _search(docs.select("doc_id", "text"), benchmark, window, shard_words, held, finish, kinds)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of :func:`scan` per document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.b - x.a)
    return scan(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_span: int = 0,
    max_coverage: float = 0.0,
    shard_words: int = SHARD_WORDS,
    held: int = HELD,
) -> DataFrame:
    """Remove leaked passages; all columns of ``docs`` stay.

    A document goes if its hit words exceed ``max_coverage`` of its words; in the
    others, spans of more than ``max_span`` words are cut out of the text. With
    the default of 0 a document with any window goes.
    """
    at = docs.columns.index("text")

    def finish(batch, documents, spans, items):
        texts = batch.column(at).to_pylist()
        keep, changed = [], False
        for n, found in enumerate(spans):
            keep.append(sum(b - a for a, b in found) <= max_coverage * len(documents[n]))
            cut = [s for s in found if s[1] - s[0] > max_span]
            if keep[-1] and cut:
                texts[n], changed = cut_spans(texts[n], cut), True
        if changed:
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        return batch.filter(pa.array(keep, pa.bool_()))

    return _search(docs, benchmark, window, shard_words, held, finish, docs.schema)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word ranges, from a range's first word to its last."""
    raw = text.encode("utf-8")
    at = [m.span() for m in _RUN.finditer(raw.translate(_TABLE))]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode("utf-8")


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
g AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
hit AS (SELECT g.doc_id, g.i, g.k, win.item_id FROM g JOIN win ON g.k = win.k AND g.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
""".replace("lower_az(coalesce(text, ''))", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
