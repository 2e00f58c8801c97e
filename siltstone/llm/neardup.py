"""Near-duplicate documents by min-max hashing (operator 10).

Each permutation is evaluated once per shingle and both its minimum and its
maximum are kept, so ``values`` signature entries cost half as many evaluations;
for two sets each entry agrees with probability J. Entries are banded; documents
that share a band are candidates and are confirmed on their full shingle sets.

A band bucket is never expanded into all its pairs. Its members are first
compared with one leader (the member that shares most buckets with others, which
in a family of edited copies is the original). Verified links give components.
Where a bucket still spans several components, members outside the leader's component
are compared with more members of it, the most popular first; and those that no
leader reached with all members of other components. So every candidate pair is either
compared or already connected, and no link that joins two components is lost. Equal shingle sets are one node throughout.

Recall of one link at similarity s is 1 - (1 - s^rows)^bands: 0.999997 at 0.8 with
the defaults (32 bands of 5), more above.

Defined results: a text that is null or without words has n_shingles 0 and stands
alone. A row without doc_id is linked with nothing, its component is null and it
is kept. Repeated rows get one result row each. Columns other than doc_id and
text are not read. No rows give no rows. A text of any length is one set; equal sets (ties)
are one node, whose least doc_id stands for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._shared import fresh, materialize, narrow, release, worker_memo

PERCENT = 80
BANDS, ROWS = 32, 5
SMALL = 4096  # pairs of a group that are joined as rows; larger groups are compared block by block
STRAYS, MEMBERS = 256, 2048  # of a block
BLOCK_SHINGLES = 1 << 20  # of a block's side; 8 bytes each
LEADERS = (9,)  # members of a bucket's main component that others are compared with before all are
MEMO_WORDS = 400_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, numbered as first seen."""

    def __init__(self):
        self.hashes = np.zeros(1 << 16, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n >= len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n] = xxhash.xxh64_intdigest(word)
        self[word] = n
        return n


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words, index, sizes = worker_memo("shingles", Words, lambda m: len(m) > MEMO_WORDS), [], []
    for t in texts:
        found = t.encode().translate(_LOWER).split() if t else ()
        index.extend(map(words.__getitem__, found))
        sizes.append(len(found))
    h = words.hashes[np.array(index, np.int64)]
    ends = np.cumsum(sizes) if sizes else []
    whole = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        whole = _mix(whole * _M3 + h[j : j + len(whole)] + np.uint64(j + 1))
    out = []
    for n, e in zip(sizes, ends):
        if n >= k:
            out.append(np.unique(whole[e - n : e - k + 1]))
        elif n:
            s = np.zeros(1, np.uint64)
            for j in range(n):
                s = _mix(s * _M3 + h[e - n + j] + np.uint64(j + 1))
            out.append(_mix(s + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], values: int, seed: int = 1) -> np.ndarray:
    """(sets, values) of uint32: the minima of values/2 permutations, then their maxima. No set may be empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(seed)
    half = values // 2
    a = rng.integers(0, 1 << 31, half, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, half, dtype=np.uint32)
    out = np.empty((len(sets), 2 * half), np.uint32)
    v = np.empty_like(flat)
    for p in range(half):
        np.multiply(flat, a[p], out=v)
        np.add(v, b[p], out=v)
        out[:, p] = np.minimum.reduceat(v, starts)
        out[:, half + p] = np.maximum.reduceat(v, starts)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), np.uint64)
    for j in range(bands):
        x = np.full(len(sig), j + 1, np.uint64)
        for r in range(rows):
            x = _mix(x * _M3 + sig[:, j * rows + r])
        out[:, j] = x
    return out.view(np.int64)


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def features(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set), bands, sig (one byte of each signature entry)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = shingle_sets(batch.column("text").to_pylist(), k)
                full = [n for n, s in enumerate(sets) if len(s)]
                node, keys, sig = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    some = signatures([sets[n] for n in full], bands * rows)
                    for n, x, y in zip(full, band_keys(some, bands, rows), (some >> np.uint32(24)).astype(np.uint8)):
                        node[n], keys[n], sig[n] = xxhash.xxh3_128_digest(sets[n].tobytes()), x, y.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(map(len, sets), pa.int64()),
                        pa.array(node, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(sig, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "node", "bands", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {_kind(docs)}, n_shingles long, node binary, bands array<long>, sig binary"
    )


def full_sets(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """node and its whole set, for the nodes of ``wanted`` (node, rep)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist(), k)]
                keep = [n for n, s in enumerate(sets) if xxhash.xxh3_128_digest(s) == batch.column("node")[n].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(pa.array(keep, pa.int64())), pa.array([sets[n] for n in keep], pa.binary())], ["node", "whole"]
                )

    rows = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep").select("node", "text")
    return rows.mapInArrow(run, "node binary, whole binary")


def _alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose signatures rule a link out (six standard deviations below the limit)."""
    sig = reps.select(F.col("node").alias("n"), "sig")
    j = percent / 100

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                least = j - 6 * (j * (1 - j) / x.shape[1]) ** 0.5
                batch = batch.filter(pa.array((x == y).mean(axis=1) >= least))
            yield batch.drop_columns(["sa", "sb"])

    rows = pairs.join(sig.withColumnsRenamed({"n": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"n": "b", "sig": "sb"}), "b")
    return rows.select(*pairs.columns, "sa", "sb").mapInArrow(run, pairs.schema)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs whose whole sets reach the limit."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                keep = []
                for x, y in zip(batch.column("wa"), batch.column("wb")):
                    x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * same >= percent * (len(x) + len(y) - same))
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left = sets.withColumnsRenamed({"node": "a", "whole": "wa"})
    right = sets.withColumnsRenamed({"node": "b", "whole": "wb"})
    rows = pairs.join(left, "a").join(right, "b").select("u", "v", "wa", "wb")
    kind = pairs.schema["u"].dataType.simpleString()
    return rows.mapInArrow(run, f"u {kind}, v {kind}")


def block_links(rest: DataFrame, sizes: DataFrame, reps: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(u, v) links of the members outside a main component with those of other components, for large groups.

    ``sizes``: main, strays, members and the shingles of either. Both sides are cut into blocks of bounded size; a task compares the
    signatures, then the whole sets, of one block with another and returns only links, and no more than one from a
    document to a component.
    """
    cut = lambda rows, most: F.greatest(F.ceil(F.col(rows) / most), F.ceil(F.col(f"{rows}_shingles") / BLOCK_SHINGLES))
    blocks = sizes.select("main", cut("strays", STRAYS).alias("nx"), cut("members", MEMBERS).alias("ny"))
    rows = rest.select("main", "node", "rep", "n", "c").distinct().join(blocks, "main")
    rows = materialize(rows.join(reps.select("node", "sig"), "node").join(whole, "node"), "blocks")
    again = rows.sparkSession.read.schema(rows.schema).parquet(rows._siltstone_path)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    cols = ["main", "x", "y", "node", "rep", "n", "c", "sig", "whole"]
    left = rows.filter("c <> main").withColumn("x", own("nx")).withColumn("y", each("ny")).select(cols)
    right = again.withColumn("y", own("ny")).withColumn("x", each("nx")).select(cols)
    j = percent / 100
    kind = rest.schema["rep"].dataType.simpleString()

    def compare(a, b):
        u, v = [], []
        if a.num_rows and b.num_rows:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            least = j - 6 * (j * (1 - j) / sig.shape[1]) ** 0.5
            size, comp = b.column("n").to_numpy(), b.column("c").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in b.column("whole").to_pylist()]
            reps_b = b.column("rep").to_pylist()
            for mine, w, n, c, r in zip(*(a.column(x).to_pylist() for x in ("sig", "whole", "n", "c", "rep"))):
                alike = (sig == np.frombuffer(mine, np.uint8)).mean(axis=1) >= least
                near = np.minimum(size, n) * 100 >= np.maximum(size, n) * percent
                w, joined = np.frombuffer(w, np.uint64), set()
                for k in np.flatnonzero(alike & near & (comp != c)).tolist():
                    if comp[k] in joined:
                        continue
                    same = len(np.intersect1d(w, sets[k], assume_unique=True))
                    if 100 * same >= percent * (len(w) + len(sets[k]) - same):
                        joined.add(comp[k])
                        u.append(r)
                        v.append(reps_b[k])
        return pa.table({"u": pa.array(u, a.schema.field("rep").type), "v": pa.array(v, a.schema.field("rep").type)})

    key = ["main", "x", "y"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, f"u {kind}, v {kind}")


def stars(hooks: DataFrame, nodes: int) -> DataFrame:
    """(member, component) where every chain of (member, component) is followed to its end; takes over ``hooks``."""
    while True:
        up = hooks.select(F.col("member").alias("component"), F.col("component").alias("far"))
        after = hooks.join(up, "component").select("member", F.col("far").alias("component"), (F.col("far") != F.col("component")).alias("moved"))
        after = materialize(narrow(after, nodes), "hooks")
        release(hooks)
        still = after.filter("moved").isEmpty()
        path, hooks = after._siltstone_path, after.drop("moved")
        hooks._siltstone_path = path
        if still:
            return hooks


def contracted(edges: DataFrame, label: DataFrame, most: int | None = None) -> DataFrame:
    """The distinct edges (u, v) between components that ``edges`` (at most ``most``, if that is known) make; nodes without a label are their own."""
    of = lambda end: label.select(F.col("member").alias(end), F.col("component").alias(f"c{end}"))
    rows = edges.join(of("u"), "u", "left").join(of("v"), "v", "left")
    rows = rows.select(F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv")).filter("cu <> cv")
    rows = rows.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct()
    return materialize(rows if most is None else narrow(rows, most), "edges")


def merged(label: DataFrame, star: DataFrame) -> DataFrame:
    """``label`` with its components replaced as ``star`` says, and the members that only ``star`` has."""
    far = star.select(F.col("member").alias("component"), F.col("component").alias("far"))
    moved = label.join(far, "component", "left").select("member", F.coalesce("far", "component").alias("component"))
    every = moved.unionByName(star.join(label.select("member"), "member", "left_anti").select("member", "component"))
    return materialize(narrow(every, label.count() + star.count()), "labels")


def components(edges: DataFrame) -> DataFrame:
    """(member, component) of the nodes of ``edges`` (u, v): the least reachable id.

    Every node hooks to its least neighbour, pointer jumps turn the trees into stars, and edges
    are mapped to the stars' roots; what is left of them is solved the same way. Two rounds at least halve the
    nodes of each component. Each round is written to the shared folder, nothing is gathered on the driver.
    """
    now, label = materialize(edges.filter("u <> v").select("u", "v").distinct(), "edges"), None
    while True:
        n = now.count()  # from the files' footers
        both = now.union(now.select("v", "u"))
        hooks = both.groupBy(F.col("u").alias("member")).agg(F.min("v").alias("c")).select("member", F.least("member", "c").alias("component"))
        star = stars(materialize(narrow(hooks, 2 * n), "hooks"), 2 * n)
        after = contracted(now, star, n)
        release(now)
        if label is None:
            label = star
        else:
            both = merged(label, star)
            release(label, star)
            label = both
        now = after
        if now.isEmpty():
            release(now)
            return label


def close_in_size(x, y, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def open_buckets(ranked: DataFrame, label: DataFrame) -> DataFrame:
    """Members of the buckets that span several components, with their component ``c`` and ``main``, that of the most popular member."""
    placed = ranked.join(label.withColumnsRenamed({"member": "rep", "component": "c"}), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    split = placed.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.max(F.struct("popularity", "node", "c")).alias("top"))
    return materialize(placed.join(split.filter("c0 <> c1").select("bucket", F.col("top.c").alias("main")), "bucket"), "open")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept, a row for each of ``docs``."""
    base = materialize(features(docs, k, bands, rows), "features")
    sets = base.filter("node is not null and doc_id is not null")
    reps = materialize(
        sets.groupBy("node").agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
        ),
        "sets",
    )
    members = reps.select(F.explode("bands").alias("bucket"), "node", "rep", "n")
    crowded = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialize(members.join(crowded, "bucket"), "shared")

    # one leader a bucket
    popular = shared.groupBy("node").agg(F.sum("size").alias("popularity"))
    ranked = materialize(shared.drop("size").join(popular, "node"), "ranked")
    release(shared)
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("popularity", "node", "rep", "n")).alias("lead"))
    led = ranked.join(leaders.select("bucket", "lead.node", "lead.rep", "lead.n").toDF("bucket", "lnode", "lrep", "ln"), "bucket")
    whole = materialize(full_sets(docs, k, ranked.select("node", "rep").distinct()), "whole")
    first = (
        led.filter((F.col("node") != F.col("lnode")) & close_in_size(F.col("n"), F.col("ln"), percent))
        .select(F.col("node").alias("a"), F.col("lnode").alias("b"), F.col("rep").alias("u"), F.col("lrep").alias("v"))
        .distinct()
    )
    links = materialize(verified(first, whole, percent), "links")
    label = components(links)
    release(links)

    # more leaders, from the largest leader's component, where a bucket still spans several components
    low, opened = 1, []
    for high in [*LEADERS, None]:
        rest = open_buckets(ranked, label)
        opened.append(rest)
        if rest.isEmpty():
            break
        blocks = None
        if not high:  # last, what is left: members outside the main component with those of other components
            counts = lambda rows, name: rows.select("main", "node", "n").distinct().groupBy("main").agg(F.count("*").alias(name), F.sum("n").alias(f"{name}_shingles"))
            strays, members = counts(rest.filter("c <> main"), "strays"), counts(rest, "members")
            sizes = materialize(strays.join(members, "main").filter(F.col("strays") * F.col("members") > SMALL), "sizes")
            blocks = block_links(rest, sizes, reps, whole, percent)
            rest = rest.join(sizes.select("main"), "main", "left_anti")
        a = rest.filter("c <> main").select("bucket", F.col("node").alias("a"), F.col("rep").alias("u"), F.col("n").alias("na"), F.col("c").alias("ca"))
        b = rest.select("bucket", F.col("node").alias("b"), F.col("rep").alias("v"), F.col("n").alias("nb"), F.col("c").alias("cb"), "main", "popularity")
        if high:
            order = Window.partitionBy("bucket").orderBy(F.desc("popularity"), "b")
            b = b.filter("cb = main").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= high).filter(F.col("r") > low)
            low = high
        pairs = (
            a.join(b, "bucket")
            .filter((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & close_in_size(F.col("na"), F.col("nb"), percent))
            .select("a", "b", "u", "v")
            .distinct()
        )
        more = verified(_alike(pairs, reps, percent), whole, percent)
        more = contracted(more if blocks is None else more.union(blocks), label)
        if not more.isEmpty():
            star = components(more)
            both = merged(label, star)
            release(star, label)
            label = both
        release(more)
    release(ranked, whole, *opened)

    linked = label.withColumnRenamed("member", "rep")
    groups = reps.select("node", "rep", "copies").join(linked, "rep", "left").filter("copies > 1 or component is not null")
    groups = groups.select(F.col("node").alias("g"), F.coalesce("component", "rep").alias("c"))
    out = base.select("doc_id", "n_shingles", "node").join(groups, (F.col("node") == F.col("g")) & F.col("doc_id").isNotNull(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    out = materialize(
        out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "groups"
    )
    release(base, reps, label)
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group, all columns; rows without doc_id stay.

    Rows with one doc_id and different texts are different documents; of those with one text one stays.
    """
    named, key = docs.filter("doc_id is not null"), "doc_id"
    repeated = not named.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty()
    if repeated:
        key = fresh("number", docs.columns)
        named = _numbered(named, key)
    near = near_duplicates(named.select(F.col(key).alias("doc_id"), "text"), k, percent)
    kept = near.filter("kept").select(F.col("doc_id").alias(key)).distinct()
    named = named.join(kept, key, "left_semi")
    if repeated:  # of rows with one number, which differ in other columns at most, that with the least hash of all
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        named = named.groupBy(key).agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return named.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """Add a number for each distinct (doc_id, text), ascending with doc_id."""
    tie = fresh("tie", [*docs.columns, key])
    docs = docs.withColumn(tie, F.xxhash64("text"))
    pairs = docs.select("doc_id", tie).distinct().repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    pairs = materialize(pairs.withColumn(key, F.monotonically_increasing_id()), "numbers")
    return materialize(docs.join(pairs, ["doc_id", tie]).drop(tie), "numbered")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
g AS MATERIALIZED (SELECT doc_id, unnest(sh) AS x FROM s),
f AS MATERIALIZED (SELECT x, count(*) AS f FROM g GROUP BY x HAVING count(*) > 1),
o AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(f, 1), x) AS r FROM g LEFT JOIN f USING (x)),
p AS MATERIALIZED (SELECT o.doc_id, x FROM o JOIN n USING (doc_id) JOIN f USING (x) WHERE r <= n.n - ceil(0.8 * n.n) + 1),
c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id WHERE least(na.n, nb.n) * 100 >= greatest(na.n, nb.n) * 80),
e AS MATERIALIZED (
  SELECT a, b FROM (SELECT c.a, c.b, len(list_intersect(sa.sh, sb.sh)) AS i, len(sa.sh) + len(sb.sh) AS t
    FROM c JOIN s sa ON sa.doc_id = c.a JOIN s sb ON sb.doc_id = c.b) WHERE 100 * i >= 80 * (t - i)),
lk AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM lk UNION SELECT reach.a, lk.b FROM reach JOIN lk ON reach.b = lk.a),
m AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(m.b, n.doc_id)) AS component_id,
  n.doc_id = least(n.doc_id, coalesce(m.b, n.doc_id)) AS kept
FROM n LEFT JOIN m USING (doc_id)
"""
