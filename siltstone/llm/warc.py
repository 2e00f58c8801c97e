"""WARC archives: writing, and reading by boundary-chain verification (operator 6).

Writing. Each row becomes a record whose payload is the page's html. Rows with equal
payloads (by digest) keep one ``response``, that of the largest page_id; the others
become ``revisit`` records without payload that refer to it. The records go out
through Spark's text writer with the record terminator as line separator, so any
file system that Spark reaches will do and failed tasks leave nothing behind.

Reading. Archives are cut into byte ranges, a task for each. A task finds every
``WARC/1.`` in its range that parses as a header (payloads may hold such text too) and
emits the offset together with where the chain of content lengths from it leaves the
range. Pointer jumping over these links, from offset 0 of each file, keeps the one true
entry of each range; a second pass walks from there and parses only reachable records.
Either pass reads a byte once, in windows, and beyond its range only what a record that
begins in it needs; a task holds a window and one record. Files are opened by pyarrow
(local, S3, GCS, Azure, HDFS by libhdfs); a scheme that it doesn't know is an error.

Defined results: a null html is the empty payload. Without page_id a row is written,
never referred to, and read back with a null page_id. Repeated rows of the largest
page_id are all responses. Payloads under ``min_payload`` bytes are all responses.
A file whose chain breaks yields the records before the break. A null url leaves its
header out. Other columns are not written. No pages make no archive and no rows. A
header, like a payload, may be of any length.
"""

from __future__ import annotations

import base64
import hashlib
from urllib.parse import unquote_plus, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._shared import materialize, release, scratch_path

SPLIT = 8 << 20
MOST_RANGES = 200_000  # ranges grow beyond that
READ = 4 << 20  # bytes of a window
HEADER = 4 << 10  # read at first where a header crosses the end of a range; longer ones are read on
BROADCAST_GROUPS = 200_000  # groups of equal payloads, of about 100 bytes each; only the join's plan depends on it
END = "\r\n\r\n"
MAGIC = b"WARC/1."


def base32_sha1(data):
    """Upper-case base32 of the SHA-1, from built-in functions: 20 bits (five hex digits) are four symbols."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, html, digest, bytes, original (null: response)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    groups = rows.filter(F.col("bytes") >= min_payload).groupBy("digest", "bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = materialize(groups.filter("n > 1").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "top"), "copied")
    if groups.count() <= BROADCAST_GROUPS:  # else payloads are shuffled to their groups, large ones split by AQE
        groups = F.broadcast(groups)
    rows = rows.join(groups, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    return rows.select("page_id", "url", "html", "digest", "bytes", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("original"))


def _uri(page_id):
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(">"))


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """One archive for each partition of ``records`` (see :func:`plan_records`)."""
    again = F.col("original").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _uri(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("original")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
    ]
    text = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), F.col("block"))
    records.withColumn("block", block).select(text.alias("value")).write.option("lineSep", END).text(path)


# -- reading ---------------------------------------------------------------


def header_at(data: bytes, at: int):
    """Fields and end of the header at ``at``; None if there is none, or it isn't complete."""
    if data[at : at + len(MAGIC)] != MAGIC:
        return None
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    return (fields, stop + 4) if size.isascii() and size.isdigit() else None


class Archive:
    """A file by pyarrow's file systems; counts the bytes it reads."""

    def __init__(self, path: str, length: int):
        from pyarrow import fs

        scheme = urlsplit(path).scheme
        at = (fs.LocalFileSystem(), urlsplit(path).path) if scheme in ("", "file") else fs.FileSystem.from_uri("s3" + path[len(scheme) :] if scheme in ("s3a", "s3n") else path)
        self.length, self.bytes_read, self.file = length, 0, at[0].open_input_file(at[1])

    def read(self, start: int, size: int) -> bytes:
        size = max(0, min(size, self.length - start))
        self.bytes_read += size
        return self.file.read_at(size, start) if size else b""


class Window:
    """Bytes of a range, read in order and once; ``to`` is where the range ends."""

    def __init__(self, archive: Archive, start: int, to: int):
        self.archive, self.low, self.to, self.data = archive, start, to, b""

    def bytes(self, at: int, size: int) -> bytes:
        """``size`` bytes from ``at``, fewer at the file's end; ``at`` never goes back."""
        lack = at + size - self.low - len(self.data)
        if lack > 0:
            ahead = min(READ, self.to - self.low - len(self.data))  # never beyond the range without need
            old, high = self.data[at - self.low :], self.low + len(self.data)
            if at > high:  # what lies between isn't wanted
                old, lack, high = b"", size, at
                ahead = min(READ, self.to - at)
            self.data, self.low = old + self.archive.read(high, max(lack, ahead)), at
        return self.data[at - self.low : at - self.low + size]

    def header(self, at: int):
        """Like header_at, with the end counted from ``at``; reads on while the header goes on."""
        size = HEADER
        while True:
            data = self.bytes(at, size)
            found = header_at(data, 0)
            if found or data[: len(MAGIC)] != MAGIC or b"\r\n\r\n" in data or at + size >= self.archive.length:
                return found
            size *= 4


def links_of(archive: Archive, start: int, end: int) -> list[tuple[int, int]]:
    """(offset, exit) of each candidate record that begins in [start, end).

    exit: the first offset at or after ``end`` on the chain from it; -1 if the chain breaks.
    """
    window, follow = Window(archive, start, end), {}
    for region in range(start, end, READ):
        stop = min(region + READ, end)
        data = window.bytes(region, stop - region + len(MAGIC) - 1)
        at = data.find(MAGIC)
        while at >= 0:
            o = region + at
            found = header_at(data, at)
            found = (found[0], found[1] - at) if found else Window.header(window, o) if data.find(b"\r\n\r\n", at) < 0 else None
            if found:
                follow[o] = o + found[1] + int(found[0]["content-length"]) + 4
            at = data.find(MAGIC, at + 1)
    out: dict[int, int] = {}
    for o in sorted(follow, reverse=True):
        s = follow[o]
        out[o] = -1 if s > archive.length else s if s >= end else out.get(s, -1)
    return sorted(out.items())


def records_from(archive: Archive, entry: int, end: int):
    """(offset, fields, block) of the records from ``entry`` that begin before ``end``."""
    at, window = entry, Window(archive, entry, end)
    while at < min(end, archive.length):
        found = window.header(at)
        if not found:
            return
        size = int(found[0]["content-length"])
        if at + found[1] + size + 4 > archive.length:
            return
        yield at, found[0], window.bytes(at + found[1], size)
        at += found[1] + size + 4


def _ranges(spark: SparkSession, path: str, split: int) -> tuple[DataFrame, int]:
    """path, length, start, end of each byte range; how many there are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path", "length").filter("length > 0")
    total = files.agg(F.sum("length")).head()[0] or 0
    split = max(split, -(-total // MOST_RANGES))
    pieces = files.withColumn("n", F.ceil(F.col("length") / split).cast("long"))
    count = pieces.agg(F.sum("n")).head()[0] or 1
    rows = pieces.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("start", F.col("n") * F.lit(split)).drop("n")
    return materialize(rows.withColumn("end", F.least(F.col("start") + split, F.col("length"))), "ranges"), count


def _dealt(ranges: DataFrame, tasks: int) -> DataFrame:
    """A range to a task: their rows are tiny, so without a number AQE would put all in one."""
    return ranges.repartitionByRange(tasks, "path", "start")


def entries(ranges: DataFrame) -> DataFrame:
    """(path, start, entry): the reachable record where each range begins, if any does."""

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                path, start, end = (batch.column(c)[n].as_py() for c in ("path", "start", "end"))
                found = links_of(Archive(path, batch.column("length")[n].as_py()), start, end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array([start] * len(found), pa.int64()), pa.array([o for o, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())],
                    ["path", "start", "offset", "leaves"],
                )

    every = materialize(ranges.mapInArrow(run, "path string, start long, offset long, leaves long"), "links")
    # a range is entered at file start or where a chain from an earlier range leads, so few candidates matter
    doors = every.select("path", F.col("leaves").alias("offset")).distinct()
    links = materialize(every.filter("offset = 0").unionByName(every.filter("offset > 0").join(doors, ["path", "offset"], "left_semi")), "links")
    release(every)
    jump = links.select("path", "offset", F.col("leaves").alias("to")).filter("`to` >= 0")
    reached = links.filter("offset = 0").select("path", "offset")
    made: list[DataFrame] = []
    while True:  # after k rounds all entries within 2^k ranges of the file's start are known
        step = reached.join(jump, ["path", "offset"]).select("path", F.col("to").alias("offset"))
        more = materialize(reached.union(step).distinct().join(links.select("path", "offset"), ["path", "offset"], "left_semi"), "reached")
        far = jump.select("path", F.col("offset").alias("to"), F.col("to").alias("far"))
        jump = materialize(jump.join(far, ["path", "to"]).select("path", "offset", F.col("far").alias("to")), "jump")
        made += [more, jump]
        reached = more
        if jump.isEmpty():
            break
    out = materialize(links.join(reached, ["path", "offset"], "left_semi").groupBy("path", "start").agg(F.min("offset").alias("entry")), "entries")
    release(links, *made)
    return out


def read_archives(spark: SparkSession, path: str, split: int = SPLIT, payloads: bool = False) -> DataFrame:
    """A row for each reachable record: page id as text, payload size and digest, type, what it refers to."""
    ranges, tasks = _ranges(spark, path, split)
    rows = _dealt(ranges.join(entries(_dealt(ranges, tasks)), ["path", "start"]), tasks)

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                entry, end = batch.column("entry")[n].as_py(), batch.column("end")[n].as_py()
                out, held = [], 0
                path, length = batch.column("path")[n].as_py(), batch.column("length")[n].as_py()
                for at, fields, block in records_from(Archive(path, length), entry, end):
                    out.append(_row(path, at, fields, block))
                    held += len(block) if payloads else 0
                    if held > SPLIT:
                        yield _batch(out, payloads)
                        out, held = [], 0
                yield _batch(out, payloads)

    kinds = "path string, offset long, page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean"
    return rows.select("path", "length", "start", "end", "entry").mapInArrow(run, kinds + ", payload binary" * payloads)


def _page(uri: str | None) -> str | None:
    found = unquote_plus((uri or "").strip("<>").removeprefix("urn:page:"))
    return found or None


def _row(path, at, fields, block):
    head, _, payload = block.partition(b"\r\n\r\n")
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type")
    size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest, intact = told, True
    if kind != "revisit":
        digest, size, intact = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), size == len(payload)
        intact = intact and told in ("", digest)
    refers = _page(fields["warc-refers-to"]) if kind == "revisit" and "warc-refers-to" in fields else None
    return path, at, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, digest, kind, refers, intact, payload


def _batch(rows, payloads):
    names = ["path", "offset", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary()]
    keep = 10 if payloads else 9
    cols = list(zip(*rows)) or [[]] * 10
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:keep], kinds)], names[:keep])


def round_trip(pages: DataFrame, min_payload: int = 0, split: int = SPLIT) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(plan_records(pages, min_payload), path)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path, split).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact"
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
q AS (
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY x) AS top,
    array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
      lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, 1 + 5 * i, 5) AS INTEGER) >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to, true AS intact
FROM q
"""
