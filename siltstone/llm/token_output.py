"""Token ids as Parquet list columns (operator 3).

Texts are encoded whole and written in ascending doc_id order as one row per
document: ``doc_id``, chosen metadata columns, ``n_tokens``, ``before`` (tokens before it
in its file) and ``ids`` (list of int32, end id included). Encodings are per column: ids either dictionary pages
(token ids repeat) or DELTA_BINARY_PACKED; row-group and page sizes are set, and
Parquet's page index is written, so that a reader of a doc_id range, or of
metadata alone, touches only those pages and columns.

Encoding. The tokenizers library drops white space before its merges, so a text
encodes to its space-separated chunks' ids in a row; each distinct chunk goes
through the library once per worker while it is held in a bounded memo. A full
memo keeps its most used chunks. Words of Latin letters skip the library's
normaliser and regular expression where these are known to do nothing to such
words but lower-case them. Texts are taken in parts of bounded size, so that a
worker's memory doesn't follow the size of Arrow's batches; a longer text is a
part of its own.

Defined results: a null or empty text is the end id alone. Equal doc_ids are
ordered by a hash of their text; a null doc_id comes first. Other columns are
ignored unless they are named as metadata. No rows give no rows; a text of any
length is one row and one list.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm._shared import drop_memo, fresh, give_back, scratch_path, sliced, worker_memo

END_ID = 1
MEMO_CHUNKS = 600_000
MEMO_CHARS = 12_000_000
_MARKS = ".,;:!?*#$%&"
_NOT_LATIN = re.compile("[^\0-\u012f\u0131-\u024f]")  # of these letters lower-casing and composition make single letters
ROW_GROUP = 32 << 20
PAGE = 256 << 10


# of the tokenizer file: what is done to a text before its merges
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _stays_letter(c: str) -> bool:
    """Latin letters that are still single letters after composition and lower-casing."""
    return c.isalpha() and c < "\u0250" and c != "\u0130"


class ChunkEncoder:
    """Encodes texts chunk by chunk with a bounded memo; the ids equal those of the whole text.

    Only for tokenizers whose normaliser and pre-tokeniser treat white space as a
    separator that leaves no token and whose words end in a marked token (checked
    on construction by a probe text); others encode whole texts.
    """

    def __init__(self, path: str, end_id: int | None = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        vocab = self.tokenizer.get_vocab(True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        probe = "One two'll  3three,\nété   x\n\n fin. <|endoftext|>y"
        # the library matches these in the raw text, before it lower-cases
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.marks = "".join(m for m in _MARKS if not any(m in t for t in self.added))
        # an added token with a digit or a mark is in no word of letters
        self.apart = all(any("!" <= c <= "~" and not c.isalpha() for c in t) for t in self.added)
        self.words = self._word_tokenizer()
        self.chunked = bool(self.closes.any()) and self._whole([probe])[0] == [
            i for x in self._whole(probe.replace("\n", " ").split(" ")) for i in x
        ]
        self._reset()

    def _word_tokenizer(self):
        """The same model without normaliser, for lower-cased words of Latin letters between spaces; None if it might differ."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        spec = json.loads(self.tokenizer.to_str())
        same = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER
        if not same or not self.apart or spec["truncation"] or spec["padding"]:
            return None
        words = Tokenizer(self.tokenizer.model)  # shared, not copied
        words.pre_tokenizer = Sequence([Split(" ", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
        return words

    def _whole(self, texts):
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lowered(self, texts):
        return [e.ids for e in self.words.encode_batch_fast([t.lower() for t in texts], add_special_tokens=False)]

    def _reset(self):
        self.memo = defaultdict(count(1).__next__)  # numbers chunks as they are first seen; 0 closes a document
        self.ids = np.zeros(1 << 20, np.int32)  # the pool: ids of all chunks
        self.filled = self.chars = 0
        self.chunk = np.zeros((1 << 18, 2), np.int64)  # of chunks, by their number: first id, count
        self.used = np.zeros(1 << 18, np.int32)  # by their number, too
        self.known = 0  # chunks that have a place
        end = [] if self.end_id is None else [self.end_id]
        self.chunk[0] = self._pool(np.array(end, np.int32)), len(end)

    def _shrink(self):
        """Keep the chunks used most, a quarter of the memo at most; of the others nothing is held."""
        names, used = list(self.memo), self.used[1 : self.known + 1]
        kept = np.flatnonzero(used > 1)
        kept = kept[np.argsort(-used[kept], kind="stable")][: MEMO_CHUNKS // 4]
        names = [names[i] for i in kept.tolist()]
        sizes = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))
        names = names[: int(np.searchsorted(sizes, MEMO_CHARS // 4, "right"))]
        kept = kept[: len(names)]
        used, places = used[kept] // 2, self.chunk[kept + 1]  # old use counts for less
        flat = self._gather(places[:, 0], places[:, 1])
        self._reset()
        for name in names:
            self.memo[name]
        self._room(len(names) + 1)
        self._place(np.arange(1, len(names) + 1), flat, places[:, 1])
        self.used[1 : len(names) + 1] = used
        self.known, self.chars = len(names), sum(map(len, names))

    def _room(self, n: int):
        while n > len(self.chunk):
            self.chunk = np.concatenate([self.chunk, np.zeros_like(self.chunk)])
            self.used = np.concatenate([self.used, np.zeros_like(self.used)])

    def _pool(self, flat: np.ndarray) -> int:
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = self.filled
        self.ids[at : at + len(flat)] = flat
        self.filled += len(flat)
        return at

    def _place(self, numbers, flat: np.ndarray, sizes: np.ndarray):
        self.chunk[numbers, 0] = self._pool(flat) + np.cumsum(sizes) - sizes
        self.chunk[numbers, 1] = sizes

    def _place_whole(self, names: list[str], numbers: list[int]):
        for at in range(0, len(names), 4096):
            lists = self._whole(names[at : at + 4096])
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self._place(numbers[at : at + 4096], np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes)

    def _place_words(self, names: list[str], numbers: list[int], encode):
        """All-letter words: many in one text, told apart by the tokens that end a word."""
        for at in range(0, len(names), 4096):
            part = names[at : at + 4096]
            lists = encode([" ".join(part[i : i + 128]) for i in range(0, len(part), 128)])
            flat = np.fromiter(chain.from_iterable(lists), np.int32)
            ends = np.flatnonzero(self.closes[flat]) + 1
            if len(ends) == len(part):
                self._place(numbers[at : at + 4096], flat, np.diff(ends, prepend=0))
            else:
                self._place_whole(part, numbers[at : at + 4096])

    def _split(self, chunks: list[str]) -> tuple[list[str], list[str]]:
        """Cores and marks of chunks; a letter and the marks after it never share a token."""
        core, tail = [], []
        marks = self.marks
        every = " ".join(chunks).lower()
        added = [t for t in self.added if t in every]
        for c in chunks:
            mark = ""
            if c[-1:] in marks:
                bare = c.rstrip(marks)
                if bare and _stays_letter(bare[-1]):
                    c, mark = bare, c[len(bare) :]
            if c.isascii() and not (added and any(t in c.lower() for t in added)):
                c = c.lower()  # the normaliser lower-cases too
            core.append(c)
            tail.append(mark)
        return core, tail

    def _learn(self):
        """Place the memo's new chunks; cores and marks are chunks too, and join the memo if they are new."""
        number, n = self.memo.__getitem__, self.known + 1
        new = self._unknown()
        core, tail = self._split(new)
        core = np.fromiter(map(number, core), np.int64, len(core))
        tail = np.fromiter(map(number, tail), np.int64, len(tail))
        new = self._unknown()
        self._room(n + len(new))
        derived = core != np.arange(n, n + len(core))  # all others are their own core
        own = np.concatenate([np.flatnonzero(~derived), np.arange(len(core), len(new))]).tolist()
        latin, words, odd = [], [], []
        for i in own:
            if not self.apart or not new[i].isalpha():
                odd.append(i)
            elif self.words is None or _NOT_LATIN.search(new[i]):
                words.append(i)
            else:
                latin.append(i)
        self._place_words([new[i] for i in latin], [n + i for i in latin], self._lowered)
        self._place_words([new[i] for i in words], [n + i for i in words], self._whole)
        self._place_whole([new[i] for i in odd], [n + i for i in odd])
        first, last = self.chunk[core[derived]], self.chunk[tail[derived]]
        both = np.stack([first, last], 1).reshape(-1, 2)
        sizes = first[:, 1] + last[:, 1]
        copied = last[:, 1] > 0  # others share the place of their core
        both, some = both[np.repeat(copied, 2)], sizes[copied]
        at = self._pool(self._gather(both[:, 0], both[:, 1]))
        starts = first[:, 0].copy()
        starts[copied] = at + np.cumsum(some) - some
        numbers = n + np.flatnonzero(derived)
        self.chunk[numbers, 0] = starts
        self.chunk[numbers, 1] = sizes
        self._use(core)
        self.chars += sum(map(len, new))
        self.known += len(new)

    def _unknown(self) -> list[str]:
        """Chunks without a place, in the order of their numbers."""
        new = list(islice(reversed(self.memo), len(self.memo) - self.known))
        new.reverse()
        return new

    def _use(self, numbers: np.ndarray):
        found = np.bincount(numbers)
        self.used[: len(found)] = np.minimum(self.used[: len(found)] + found, 1 << 30)

    def _gather(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        before = np.cumsum(count) - count
        return self.ids[np.repeat(first - before, count) + np.arange(int(count.sum()))]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        if len(self.memo) > MEMO_CHUNKS or self.chars > MEMO_CHARS:
            self._shrink()
        if not self.chunked:
            end = [] if self.end_id is None else [self.end_id]
            return pa.array([x + end for x in self._whole([t or "" for t in texts])], pa.list_(pa.int32()))
        number, index, closes = self.memo.__getitem__, array("q"), [0]
        collecting = gc.isenabled()
        gc.disable()  # the memo's many strings hold no cycles, and walking them costs a tenth of the time
        try:
            for t in texts:
                if t:
                    index.extend(map(number, t.replace("\n", " ").split(" ")))
                index.append(0)
                closes.append(len(index))
            if len(self.memo) > self.known:
                self._learn()
        finally:
            if collecting:
                gc.enable()
        index = np.frombuffer(index, np.int64)
        self._use(index)
        first, sizes = self.chunk[index, 0], self.chunk[index, 1]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.array(closes)]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(self._gather(first, sizes)))


def encoder(path: str, end_id: int | None = END_ID) -> ChunkEncoder:
    """One encoder per worker process, kept from task to task."""
    return worker_memo(("tokens", path, end_id), lambda: ChunkEncoder(path, end_id))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    metadata: tuple = (),
    encoding: str = "dictionary",
    row_group: int = ROW_GROUP,
    page: int = PAGE,
    end_id: int = END_ID,
) -> None:
    """Encode ``docs`` and write them to ``path`` in ascending doc_id order."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)
    tokenizer = tokenizer or default_tokenizer()
    meta = [c for c in metadata if c in docs.columns]
    taken = ["doc_id", "n_tokens", "before", "ids", "text"]
    named = []
    for c in meta:
        named.append(fresh(c, taken + named))
    rows = docs.select("doc_id", *[F.col(c).alias(n) for c, n in zip(meta, named)], "text")
    tie = fresh("tie", rows.columns)
    rows = (
        rows.withColumn(tie, F.xxhash64("text"))
        .repartitionByRange("doc_id", tie)
        .sortWithinPartitions("doc_id", tie)
        .drop(tie)
    )
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches):
        enc, held = encoder(tokenizer, end_id), 0
        for whole in batches:
            for batch in sliced(whole):
                ids = enc.encode(batch.column("text").to_pylist())
                n = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                before = np.cumsum(n) - n + held
                held += int(n.sum())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(before), ids], [*batch.schema.names[:-1], "n_tokens", "before", "ids"])
            give_back()

    out = rows.mapInArrow(run, ", ".join([*kinds, "n_tokens long", "before long", "ids array<int>"]))
    options = {
        "maxRecordsPerFile": "0",  # a task's rows are one file
        "compression": "zstd",
        "parquet.block.size": str(row_group),
        "parquet.page.size": str(page),
        "parquet.enable.dictionary": "true",
        "parquet.writer.version": "v2" if encoding == "delta" else "v1",
    }
    if encoding == "delta":
        options["parquet.enable.dictionary#ids.list.element"] = "false"
        options["parquet.enable.dictionary#doc_id"] = "false"
    out.write.options(**options).parquet(path)


def file_number(name):
    """The number of the task that wrote a file; as text, part-100000 would come before part-99999."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("long")


def file_starts(rows: DataFrame) -> DataFrame:
    """(number, base): tokens in all files before each; ``rows``: file_name, n_tokens."""
    sums = rows.groupBy(file_number(F.col("file_name")).alias("number")).agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return sums.select("number", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Rows of the files with ``start`` (ids of all rows before it) and the crc32 of the ids read.

    No row is shuffled: ``start`` adds what the files before hold to what the row's file says; two
    numbers a file are broadcast.
    """
    at = spark.read.parquet(path)
    rows = at.select(file_number(F.col("_metadata.file_name")).alias("number"), "doc_id", "n_tokens", "before", "ids")
    kind = at.schema["doc_id"].dataType.simpleString()

    def run(batches):
        drop_memo()  # that of the writing tasks
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            cols = [batch.column("number"), batch.column("doc_id"), batch.column("before")]
            cols += [pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())]
            names = ["number", "doc_id", "before", "n_tokens", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, ids], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"number long, doc_id {kind}, before long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    base = file_starts(at.select("_metadata.file_name", "n_tokens"))  # of the files, only this column is read twice
    got = rows.mapInArrow(run, schema).join(F.broadcast(base), "number")
    return got.select("doc_id", (F.col("base") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def select_tokens(spark: SparkSession, path: str, first, last, columns: tuple = ("ids",)) -> DataFrame:
    """``doc_id`` and ``columns`` of the rows with first <= doc_id <= last; row groups and pages outside the range, and other columns, aren't read."""
    return spark.read.parquet(path).filter(F.col("doc_id").between(first, last)).select("doc_id", *columns)


def round_trip(docs: DataFrame, tokenizer: str | None = None, keep_ids: bool = False, metadata: tuple = ("lang", "source")) -> DataFrame:
    """Write to the shared folder, read back; one row per document."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, metadata)
    return read_tokens(spark, path, keep_ids)
