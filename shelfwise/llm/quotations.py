"""Quotation linking: conversations ordered by who replies to whom, without the quotes.

A line's leading ``>`` signs give its quote level; lines of one level that follow each other are a passage. A message's own
text has level 0. Quoted passages are normalised and hashed; a hash finds the latest earlier message of the conversation
whose own text, paragraphs or lines have it. The message of a first-level quote is the one replied to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.storage import stored
from shelfwise.sources.session import checkpointed

#: Turns per bucket when the latest earlier message is looked up.
BUCKET = 1024
_MARKS = r"^[ \t]*(?:>[ \t]?)+"


def marked_lines(text: Column) -> Column:
    """An array of (level, body), one per line; ``body`` has no quote marks."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1)
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), "[^>]", ""))
    return F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body")))


def passages(lines: Column) -> Column:
    """An array of (level, body) of the runs of lines of one level, in their order.

    ``lines`` must be a column of its own and no expression: it is looked into once per run."""
    count = F.size(lines)
    starts = F.filter(
        F.sequence(F.lit(1), count),
        lambda i: (i == 1) | (F.get(lines, i - 1)["level"] != F.get(lines, i - 2)["level"]),
    )
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(count + 1))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("size")))
    return F.transform(
        runs,
        lambda r: F.struct(
            F.get(lines, r["start"] - 1)["level"].alias("level"),
            F.array_join(F.transform(F.slice(lines, r["start"], r["size"]), lambda x: x["body"]), "\n").alias("body"),
        ),
    )


def _with_held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row: the optimizer would put its expression wherever it is read, also
    into the loops over its own entries. A generator of one row is a border that it doesn't cross."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parsed_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, passages, own_text and n_quotes of messages, each text read once."""
    lines = _with_held(messages.select("conv_id", "turn", "role", "text"), "lines", marked_lines(F.col("text")))
    found = _with_held(lines.drop("text"), "passages", passages(F.col("lines"))).drop("lines")
    own = F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["body"]), "\n")
    clean = F.regexp_replace(F.regexp_replace(own, r"[ \t]+(?=\n|$)", ""), r"^\n+|\n+$", "")
    return found.withColumn("own_text", clean).withColumn("n_quotes", F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long"))


def normalised(text: Column) -> Column:
    """Lower case with single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parts(text: Column) -> Column:
    """The normalised pieces of an own text that a quote can repeat: all of it, its paragraphs and its lines."""
    split = lambda pattern: F.transform(F.split(text, pattern), normalised)
    every = F.concat(F.array(normalised(text)), split(r"\n[ \t]*\n"), split("\n"))
    return F.filter(F.array_distinct(every), lambda x: x != "")


def _latest(originals: DataFrame, quotes: DataFrame) -> DataFrame:
    """``quotes`` (conv_id, hash, turn, level) with ``origin``: the latest turn before ``turn`` with the hash.

    First within buckets of turns, then over the buckets, so a passage repeated without end is no single group."""
    events = originals.select("conv_id", "hash", "turn", F.col("turn").alias("origin"), F.lit(None).cast("int").alias("level")).unionByName(
        quotes.select("conv_id", "hash", "turn", F.lit(None).cast("long").alias("origin"), "level")
    )
    events = events.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    inside = Window.partitionBy("conv_id", "hash", "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = events.withColumn("near", F.max("origin").over(inside)).where("level IS NOT NULL")
    tops = originals.groupBy("conv_id", "hash", F.floor(F.col("turn") / BUCKET).alias("bucket")).agg(F.max("turn").alias("top"))
    asked = near.select("conv_id", "hash", "bucket").distinct().withColumn("top", F.lit(None).cast("long"))
    before = Window.partitionBy("conv_id", "hash").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    far = tops.unionByName(asked).withColumn("far", F.max("top").over(before)).groupBy("conv_id", "hash", "bucket").agg(F.max("far").alias("far"))
    found = near.join(far, ["conv_id", "hash", "bucket"], "left")
    return found.select("conv_id", "hash", "turn", "level", F.coalesce("near", "far").alias("origin")).where("origin IS NOT NULL")


def links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): the message each quoting message replies to: that of its shallowest linked quote, the latest of several."""
    known = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = known.where(F.exists("passages", lambda p: p["level"] > 0))
    quotes = (
        quoted.select("conv_id", "turn", F.explode(F.filter("passages", lambda p: p["level"] > 0)).alias("p"))
        .select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(parts(F.col("p.body"))).alias("piece"))
        .select("conv_id", "turn", "level", F.xxhash64("piece").alias("hash"))
        .distinct()
    )
    originals = (
        known.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
        .select("conv_id", "turn", F.explode(parts(F.col("own_text"))).alias("piece"))
        .select("conv_id", "turn", F.xxhash64("piece").alias("hash"))
        .distinct()
    )
    best = _latest(originals, quotes).groupBy("conv_id", "turn").agg(F.min(F.struct("level", -F.col("origin"))).alias("best"))
    return best.select("conv_id", "turn", (-F.col("best")[F.lit("col2")]).alias("parent"))


def chains(linked: DataFrame) -> DataFrame:
    """``linked`` with ``thread`` (the first message of the chain of replies) and ``depth``, by doubling the steps."""
    now = checkpointed(linked.select("conv_id", "turn", "parent", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        step = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_further"), F.col("depth").alias("_more"))
        joined = now.join(step, ["conv_id", "thread"], "left")
        new = checkpointed(
            joined.select(
                "conv_id", "turn", "parent", F.coalesce("_further", "thread").alias("thread"),
                (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_further").isNotNull().alias("_moved"),
            )
        )
        moved = new.where("_moved").limit(1).count()
        now = new.drop("_moved")
        if not moved:
            return now


def conversations(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, text without quotes, parent_turn, thread_turn, depth, n_quotes.

    ``messages`` needs conv_id, turn, role and text; other columns are ignored. A conversation reads in the order of
    thread_turn, then turn: every message comes after the one it replies to. A message without a linked quote starts a thread
    (depth 0, no parent). A null or empty text has an empty text and no quotes. Rows with equal conv_id and turn are pooled
    for linking and each answered; a null conv_id or turn is never linked.
    """
    parsed = stored(parsed_messages(messages))
    linked = stored(links(parsed))
    rows = parsed.join(chains(linked), ["conv_id", "turn"], "left") if linked.limit(1).count() else (
        parsed.withColumns({c: F.lit(None).cast("long") for c in ("parent", "thread", "depth")})
    )
    return rows.select(
        "conv_id", "turn", "role", F.col("own_text").alias("text"), F.col("parent").alias("parent_turn"),
        F.coalesce("thread", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes",
    )


QUOTE_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role,
         string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM conversations),
marked AS (
  SELECT rid, conv_id, turn, role, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM lines),
levels AS (
  SELECT rid, i, conv_id, turn, role, len(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '') AS body FROM marked),
changes AS (
  SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY i) THEN 1 ELSE 0 END AS new FROM levels),
runs AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM changes),
passages AS (
  SELECT rid, conv_id, turn, role, run, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS body FROM runs GROUP BY ALL),
msgs AS (
  SELECT rid, conv_id, turn, role, count(*) FILTER (level > 0) AS n_quotes,
         regexp_replace(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY run) FILTER (level = 0), ''), '[ \t]+(\n|$)', '\1', 'g'), '^\n+|\n+$', '', 'g') AS text
  FROM passages GROUP BY rid, conv_id, turn, role),
pieces AS (
  SELECT conv_id, turn, level, unnest([body] || regexp_split_to_array(body, '\n[ \t]*\n') || string_split(body, chr(10))) AS p
  FROM (SELECT conv_id, turn, level, body FROM passages WHERE level > 0 UNION ALL SELECT conv_id, turn, 0, text FROM msgs)),
norm AS (SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(p), '\s+', ' ', 'g')) AS p FROM pieces),
found AS (
  SELECT q.conv_id, q.turn, q.level, max(o.turn) AS origin FROM norm q JOIN norm o
  ON q.conv_id = o.conv_id AND q.p = o.p AND q.p <> '' AND q.level > 0 AND o.level = 0 AND o.turn < q.turn GROUP BY q.conv_id, q.turn, q.level),
parents AS (SELECT conv_id, turn, arg_min(origin, level) AS parent FROM found GROUP BY conv_id, turn),
chain AS (
  SELECT conv_id, turn, parent AS thread, 1 AS depth FROM parents
  UNION ALL SELECT c.conv_id, c.turn, p.parent, c.depth + 1 FROM chain c JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.thread),
roots AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM chain GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, m.text, p.parent AS parent_turn, coalesce(r.thread, m.turn) AS thread_turn,
       coalesce(r.depth, 0)::BIGINT AS depth, m.n_quotes
FROM msgs m LEFT JOIN parents p USING (conv_id, turn) LEFT JOIN roots r USING (conv_id, turn)
"""
