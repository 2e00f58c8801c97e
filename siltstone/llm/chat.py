"""Chat formatting by quotation linking (operator 5); DataFrame functions only.

Lines that start with ``>`` markers are quotes; the number of markers is the level.
Passages are runs of lines of one level without a blank line between them. Quoted
passages, and each of their lines, are normalised (lower case, runs of white space as
one space) and hashed. Each hash is joined to the latest earlier message of the
conversation that has that passage or line as its own. The message with most quoted lines found
(a passage counts as many as it has, besides its lines) at the lowest level that finds
any is what is replied to (ties: the later message).
Attribution lines ("On ... wrote:") go with the quotes. Conversations are then put in
reply order: threads by their first turn, messages in a thread by turn, quotes gone.

No pairs are formed: the search for the latest earlier message is a running maximum
in two levels (turn buckets, then turns), positions are two-level counts; so one
conversation, or one very common line, may hold a large part of all rows.

Defined results: a null text is an empty message. Rows with a null conv_id or turn
are linked with nothing; they are ordered like others, nulls first. Repeated (conv_id, turn)
rows get the same links and follow one another, ordered by role and text. Extra
columns are ignored. No messages give no rows. A text of any length is parsed whole;
the work grows with its lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._shared import materialize, release, running_total

SPAN = 256  # turns a bucket
QUOTE = r"^[ \t]*(?:>[ \t]*)+"
#: fixed values: how mail clients announce a quote
ATTRIBUTION = r"^(On|Am|Le|El) .* (wrote|schrieb|a écrit|escribió) ?:[ \t\r]*$"


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _normal(line):
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\r]+", " "))


def with_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` as a mail client would send them: the text follows an attribution line and the
    whole message replied to, which is quoted once, with the one it replied to in turn quoted twice.

    A turn replies to the one before, each third turn to the one before that; turns without
    such a message stay as they are. Of repeated turns the least role and text are quoted.
    """
    before = lambda turn: turn - F.when(turn % 3 == 2, 2).otherwise(1)
    said = messages.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    named = lambda n: said.select(F.col("conv_id").alias(f"c{n}"), F.col("turn").alias(f"t{n}"), F.col("role").alias(f"r{n}"), F.col("text").alias(f"x{n}"))
    marked = lambda text, mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit(f"\n{mark}")), F.lit("\n"))
    rows = messages.select("conv_id", "turn", "role", "text", before(F.col("turn")).alias("up"))
    rows = rows.withColumn("upper", before(F.col("up")))
    rows = rows.join(named(1), (F.col("conv_id") == F.col("c1")) & (F.col("up") == F.col("t1")), "left")
    rows = rows.join(named(2), (F.col("conv_id") == F.col("c2")) & (F.col("upper") == F.col("t2")), "left")
    quote = F.concat(
        F.lit("On turn "), F.col("up").cast("string"), F.lit(" "), F.coalesce("r1", F.lit("")), F.lit(" wrote:\n"),
        F.coalesce(marked(F.col("x2"), ">> "), F.lit("")), marked(F.col("x1"), "> "), F.lit("\n"), F.coalesce("text", F.lit("")),
    )
    return rows.select("conv_id", "turn", "role", F.coalesce(quote, F.col("text")).alias("text"))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, n_quoted (lines), and the keys ``quoted`` (level, hash, weight) and ``own`` (hashes)."""
    raw = F.transform(_lines(F.col("text")), lambda x: F.struct(x.alias("line"), F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", "")).alias("level")))
    rows = messages.select("conv_id", "turn", "role", raw.alias("raw"))
    quotes = F.exists("raw", lambda y: y.level > 0)
    level = lambda x: F.when((x.level == 0) & x.line.rlike(ATTRIBUTION) & F.col("quotes"), -1).otherwise(x.level)
    rows = rows.withColumn("quotes", quotes)
    rows = rows.withColumn("lines", F.transform("raw", lambda x: F.struct(x.line.alias("line"), level(x).alias("level"), _normal(F.regexp_replace(x.line, QUOTE, "")).alias("norm"))))
    own_text = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.line), "\n"))
    at = lambda i: F.get(F.col("lines"), i)
    begins = lambda i: (i == 0) | (at(i)["level"] != at(i - 1)["level"]) | ((at(i)["norm"] == "") != (at(i - 1)["norm"] == ""))
    rows = rows.withColumn("begins", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), begins))
    run = lambda i, n: F.struct(i.alias("a"), (F.coalesce(F.get(F.col("begins"), n + 1), F.size("lines")) - i).alias("n"))
    runs = F.filter(F.transform("begins", run), lambda r: (r.n > 1) & (at(r.a)["norm"] != "") & (at(r.a)["level"] >= 0))
    text = lambda r: F.array_join(F.transform(F.slice("lines", r.a + 1, r.n), lambda x: x.norm), "\n")
    passages = F.transform(runs, lambda r: F.struct(at(r.a)["level"].alias("level"), F.sha2(text(r), 256).alias("h"), r.n.alias("weight")))
    single = F.transform(F.filter("lines", lambda x: (x.norm != "") & (x.level >= 0)), lambda x: F.struct(x.level.alias("level"), F.sha2(x.norm, 256).alias("h"), F.lit(1).alias("weight")))
    rows = rows.withColumn("keys", F.concat(single, passages))
    return rows.select(
        "conv_id",
        "turn",
        "role",
        F.regexp_replace(own_text, r"^\n+|\n+$", "").alias("own_text"),
        F.size(F.filter("lines", lambda x: x.level > 0)).cast("long").alias("n_quoted"),
        F.filter("keys", lambda k: k.level > 0).alias("quoted"),
        F.transform(F.filter("keys", lambda k: k.level == 0), lambda k: k.h).alias("own"),
    )


def reply_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, found): what each quoting message replies to."""
    known = parsed.filter("conv_id is not null and turn is not null")
    quoted = known.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.h", "q.weight")
    quoted = materialize(quoted.distinct(), "quoted")
    own = known.select("conv_id", "turn", F.explode("own").alias("h"))
    own = own.join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")
    own = materialize(own.select("conv_id", "h", "turn", F.floor(F.col("turn") / SPAN).alias("bucket")).distinct(), "own")

    # the latest own turn in earlier buckets, then within the bucket
    events = quoted.select("conv_id", "h", F.floor(F.col("turn") / SPAN).alias("bucket"), "turn", "level", "weight", F.lit(None).cast(own.schema["turn"].dataType).alias("own_turn"))
    events = events.unionByName(own.select("conv_id", "h", "bucket", "turn", F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("weight"), F.col("turn").alias("own_turn")))
    tops = events.groupBy("conv_id", "h", "bucket").agg(F.max("own_turn").alias("top"))
    before = Window.partitionBy("conv_id", "h").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("conv_id", "h", "bucket", F.max("top").over(before).alias("earlier"))
    within = Window.partitionBy("conv_id", "h", "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("near", F.max("own_turn").over(within)).filter("level is not null").join(tops, ["conv_id", "h", "bucket"])
    found = found.select("conv_id", "turn", "level", "weight", F.coalesce("near", "earlier").alias("reply_to")).filter("reply_to is not null")

    votes = found.groupBy("conv_id", "turn", "level", "reply_to").agg(F.sum("weight").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "n", "reply_to")).alias("best"))
    out = materialize(best.select("conv_id", "turn", F.col("best.reply_to").alias("reply_to"), F.col("best.n").alias("found")), "replies")
    release(quoted, own)
    return out


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root) of every replying message, by pointer jumping; messages whose root is found jump no more."""
    active = every = links.select("conv_id", "turn", F.col("reply_to").alias("root"))
    done: list[DataFrame] = []
    while True:
        up = every.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("far"))
        step = active.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        done.append(step.filter("not moved").drop("moved"))
        active = step.filter("moved").drop("moved")
        every = reduce(DataFrame.union, [*done, active])
        if active.isEmpty():
            return reduce(DataFrame.union, done)


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message in reply order: conv_id, turn, role, reply_to, thread_root, reply_pos, n_quoted, own_text, rendered."""
    parsed = materialize(parse(messages), "parsed")  # read three times; filters pushed into it would parse for each line
    links = reply_links(parsed)
    rows = parsed.select("conv_id", "turn", "role", "own_text", "n_quoted")
    if links.isEmpty():
        rows = rows.withColumn("reply_to", F.lit(None).cast(messages.schema["turn"].dataType)).withColumn("thread_root", F.col("turn"))
    else:
        both = links.select("conv_id", "turn", "reply_to").join(thread_roots(links), ["conv_id", "turn"])
        rows = rows.join(both, ["conv_id", "turn"], "left").withColumn("thread_root", F.coalesce("root", "turn")).drop("root")

    bucket = lambda c: F.coalesce(F.floor(F.col(c) / SPAN), F.lit(-(1 << 62)))  # noqa: E731  nulls first
    threads = rows.groupBy("conv_id", "thread_root").agg(F.count("*").alias("n")).withColumn("bucket", bucket("thread_root"))
    threads = running_total(threads, ["conv_id"], "bucket", ["thread_root"], "n", "base")
    threads = threads.select(F.col("conv_id").alias("c"), F.col("thread_root").alias("r"), "base")
    rows = rows.withColumn("one", F.lit(1)).withColumn("bucket", bucket("turn"))
    rows = running_total(rows, ["conv_id", "thread_root"], "bucket", ["turn", "role", "own_text"], "one", "within")
    rows = rows.join(threads, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("thread_root").eqNullSafe(F.col("r")))
    rendered = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("own_text"), F.lit("\n"))
    return rows.select(
        "conv_id", "turn", "role", "reply_to", "thread_root", (F.col("base") + F.col("within") + 1).cast("long").alias("reply_pos"), "n_quoted", "own_text", rendered.alias("rendered")
    )


def transcripts(ordered: DataFrame, messages: int = 64) -> DataFrame:
    """Rendered text in reply order, at most ``messages`` messages a row: conv_id, part, text."""
    rows = ordered.withColumn("part", F.floor((F.col("reply_pos") - 1) / messages))
    rows = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("reply_pos", "rendered"))).alias("m"))
    return rows.select("conv_id", "part", F.array_join("m.rendered", "").alias("text"))


#: links of a table ``sent``: conv_id, turn, role, text
ORACLE_LINKS = r"""
l AS MATERIALIZED (SELECT conv_id, turn, role, row_number() OVER () AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM sent),
x AS (SELECT *, list_transform(ls, lambda y: length(regexp_replace(regexp_extract(y, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g'))) AS l0 FROM l),
y AS MATERIALIZED (
  SELECT conv_id, turn, role, id, ls,
    list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN l0[i] = 0 AND list_max(l0) > 0 AND regexp_matches(ls[i], '^(On|Am|Le|El) .* (wrote|schrieb|a écrit|escribió) ?:[ \t\r]*$') THEN -1 ELSE l0[i] END) AS lv,
    list_transform(ls, lambda z: trim(regexp_replace(lower(regexp_replace(z, '^[ \t]*(?:>[ \t]*)+', '')), '[ \t\r]+', ' ', 'g'), ' ')) AS nm FROM x),
e AS MATERIALIZED (SELECT id, conv_id, turn, i, lv[i] AS level, nm[i] AS line FROM y, unnest(range(1, len(ls) + 1)) AS t(i)),
g AS (SELECT *, sum(CASE WHEN level IS NOT DISTINCT FROM pl AND (line = '') IS NOT DISTINCT FROM (pn = '') THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS run
  FROM (SELECT *, lag(level) OVER (PARTITION BY id ORDER BY i) AS pl, lag(line) OVER (PARTITION BY id ORDER BY i) AS pn FROM e)),
k AS MATERIALIZED (
  SELECT DISTINCT conv_id, turn, level, line AS key, 1 AS weight FROM e WHERE line <> '' AND level >= 0
  UNION
  SELECT DISTINCT conv_id, turn, min(level), string_agg(line, chr(10) ORDER BY i), count(*) FROM g WHERE line <> '' AND level >= 0 GROUP BY id, conv_id, turn, run HAVING count(*) > 1),
f AS (SELECT q.conv_id, q.turn, q.level, q.key, q.weight, max(o.turn) AS reply_to FROM k q JOIN k o ON q.conv_id = o.conv_id AND q.key = o.key AND o.level = 0 AND o.turn < q.turn WHERE q.level > 0 GROUP BY ALL),
v AS (SELECT conv_id, turn, level, reply_to, sum(weight) AS n FROM f GROUP BY ALL),
r AS MATERIALIZED (SELECT conv_id, turn, reply_to FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, reply_to DESC) = 1),
up(conv_id, turn, root) AS (SELECT conv_id, turn, reply_to FROM r UNION ALL SELECT up.conv_id, up.turn, r.reply_to FROM up JOIN r ON up.conv_id = r.conv_id AND up.root = r.turn),
top AS (SELECT conv_id, turn, min(root) AS root FROM up GROUP BY ALL),
t AS (
  SELECT y.conv_id, y.turn, y.role, r.reply_to, coalesce(top.root, y.turn) AS thread_root, CAST(len(list_filter(lv, lambda z: z > 0)) AS BIGINT) AS n_quoted,
    regexp_replace(trim(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: lv[i] = 0), lambda i: ls[i]), chr(10)), ' '), '^\n+|\n+$', '', 'g') AS own_text
  FROM y LEFT JOIN r ON r.conv_id = y.conv_id AND r.turn = y.turn LEFT JOIN top ON top.conv_id = y.conv_id AND top.turn = y.turn)
SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY thread_root NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, own_text NULLS FIRST) AS BIGINT) AS reply_pos,
  '<|' || coalesce(role, '') || '|>' || chr(10) || own_text || chr(10) AS rendered
FROM t
"""
ORACLE = r"""
WITH RECURSIVE said AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2),
ups AS (SELECT *, CASE WHEN up % 3 = 2 THEN up - 2 ELSE up - 1 END AS upper FROM (SELECT *, CASE WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END AS up FROM conversations)),
sent AS (
  SELECT m.conv_id, m.turn, m.role, CASE WHEN a.text IS NULL THEN m.text ELSE
    'On turn ' || up || ' ' || coalesce(a.role, '') || ' wrote:' || chr(10)
    || coalesce('>> ' || replace(b.text, chr(10), chr(10) || '>> ') || chr(10), '')
    || '> ' || replace(a.text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || coalesce(m.text, '') END AS text
  FROM ups m LEFT JOIN said a ON a.conv_id = m.conv_id AND a.turn = m.up LEFT JOIN said b ON b.conv_id = m.conv_id AND b.turn = m.upper),
""" + ORACLE_LINKS
