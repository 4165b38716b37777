"""Quotation linking for conversations, with DataFrame functions only.

A line's quote level is the number of `>` in its leading marks. A passage is a run of lines of one level without blank lines between
them; passages are compared after white space is folded and A-Z lowered, by a 128-bit hash. A quoted passage's original is the
latest earlier message of the conversation that holds it as a passage or a line of its own. A quote of several lines that is no whole passage
("trimmed") is looked for by its pairs of neighbouring lines: where one message is the latest earlier holder of all of them, that's its
original. A message replies to the original of its first passage of the least level that has one. Threads come from doubling the reply pointers, so their number of rounds is the
logarithm of the longest chain. In a conversation ordered by (thread_turn, turn) threads are contiguous and replies follow what they
reply to.

Originals are found by a running maximum over the sorted holders of a hash and never as pairs, so that a line that everyone says and
quotes costs a row for each saying. Only conversations with quotes are parsed.

Defined results: null or empty texts have no lines of their own and no quotes; messages whose conv_id or turn is null neither quote nor are
quoted, and have no thread; messages that share conv_id and turn are told apart by their texts, and repeated rows get equal results; where
such messages reply to different turns, the thread follows the smallest; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.llm.shared import materialize, table

MARKS = r"^[ \t]*>[ \t>]*"
HAS_QUOTE = r"(?:^|\n)[ \t]*>"
MESSAGE = ["conv_id", "turn", "th"]


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    folded = F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.translate(folded, string.ascii_uppercase, string.ascii_lowercase)


def own_text(text: Column) -> Column:
    """text without its quoted lines."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(MARKS))
    return F.when(text.rlike(HAS_QUOTE), F.array_join(kept, "\n")).otherwise(F.coalesce(text, F.lit("")))


def passages(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages (message, level, pos, key), own lines (message, key) and neighbouring lines of a passage (message, level, pos of the passage, key)
    of distinct messages."""
    lines = messages.select(*MESSAGE, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select(*MESSAGE, "pos", quote_level(F.col("line")).alias("level"), normalised(F.regexp_replace("line", MARKS, "")).alias("key"))
    run = F.col("pos") - F.row_number().over(W.partitionBy(*MESSAGE, "level", F.col("key") == "").orderBy("pos"))
    inside = lines.withColumn("run", run).where("key <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"])
    whole = inside.groupBy(*MESSAGE, "level", "run").agg(F.min("pos").alias("pos"), F.array_join(parts, " ").alias("key")).drop("run")
    near = W.partitionBy(*MESSAGE, "level", "run").orderBy("pos")
    pairs = inside.select(*MESSAGE, "level", F.first("pos").over(near).alias("pos"), F.concat("key", F.lit("\n"), F.lead("key").over(near)).alias("key")).where("key is not null")
    return whole, lines.where("level = 0 and key <> ''").select(*MESSAGE, "key"), pairs


def latest_holders(said: DataFrame, quoted: DataFrame) -> DataFrame:
    """quoted (message, level, pos, key) with original: the latest earlier turn of the conversation in said (conv_id, turn, key)."""
    hashes = (F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("passage"), F.col("key")).alias("h2"))
    said = said.select("conv_id", *hashes, "turn").distinct().select("*", F.lit(None).cast("bigint").alias("th"), F.lit(0).alias("level"), F.lit(0).alias("pos"), F.lit(1).alias("kind"))
    both = said.unionByName(quoted.select("conv_id", *hashes, "turn", "th", "level", "pos", F.lit(0).alias("kind")))
    before = W.partitionBy("conv_id", "h1", "h2").orderBy("turn", "kind").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("original", F.max(F.when(F.col("kind") == 1, F.col("turn"))).over(before)).where("kind = 0").select(*MESSAGE, "level", "pos", "original")


def reply_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, th, n_quotes, n_linked, parent_turn of every distinct message with quotes."""
    usable = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull())
    quoting = usable.where(F.col("text").rlike(HAS_QUOTE)).select("conv_id").distinct()
    found, lines, pairs = passages(usable.join(quoting, "conv_id", "left_semi").dropDuplicates(MESSAGE))
    own = found.where("level = 0").select("conv_id", "turn", "key").unionByName(lines.select("conv_id", "turn", "key"))
    quoted = latest_holders(own, found.where("level > 0"))
    passage = [*MESSAGE, "level", "pos"]
    held = latest_holders(pairs.where("level = 0").select("conv_id", "turn", "key"), pairs.where("level > 0")).groupBy(*passage)
    one = (F.min("original") == F.max("original")) & (F.count("original") == F.count(F.lit(1)))
    trimmed = held.agg(F.when(one, F.max("original")).alias("trimmed"))
    quoted = quoted.join(trimmed, passage, "left").withColumn("original", F.coalesce("original", "trimmed"))
    order = F.when(F.col("original").isNotNull(), F.struct("level", "pos"))
    return quoted.groupBy(*MESSAGE).agg(F.count(F.lit(1)).alias("n_quotes"), F.count("original").alias("n_linked"), F.min_by("original", order).alias("parent_turn"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread_turn, depth of every replying turn, by doubling its pointer to the turn it replies to."""
    now = links.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("up")).withColumn("depth", F.lit(1).cast("bigint"))
    now, _ = materialize(now, "threads")
    while True:
        far = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        step = now.join(far, ["conv_id", "up"], "left")
        if not step.where("up2 is not null").limit(1).count():
            return now.select("conv_id", "turn", F.col("up").alias("thread_turn"), "depth")
        step = step.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        now, _ = materialize(step, "threads")


def link_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, parent_turn, thread_turn, depth for every row."""
    rows = conversations.select("conv_id", "turn", "role", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    links, _ = materialize(reply_links(rows.select("conv_id", "turn", "th", "text")), "replies")
    out = rows.join(links, MESSAGE, "left").join(threads(links), ["conv_id", "turn"], "left")
    root = F.when(F.col("conv_id").isNotNull(), F.coalesce("thread_turn", "turn"))
    return out.select(
        "conv_id", "turn", "role", own_text(F.col("text")).alias("text"), F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        "parent_turn", root.alias("thread_turn"), F.when(root.isNotNull(), F.coalesce("depth", F.lit(0))).cast("bigint").alias("depth"),
    )


def in_reply_order(linked: DataFrame) -> DataFrame:
    """Conversations as sorted ranges: threads together, replies after what they reply to."""
    keys = ["conv_id", "thread_turn", "turn"]
    return linked.repartitionByRange(*keys).sortWithinPartitions(*keys)


def op8_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = in_reply_order(link_conversations(table(spark, sf_dir, "conversations")))
    return linked.select("conv_id", "turn", "role", "n_quotes", "n_linked", "parent_turn", "thread_turn", "depth", F.sha2("text", 256).alias("own_sha256"))


OP8_SQL = r"""
WITH RECURSIVE m AS (
  SELECT DISTINCT conv_id, turn, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL
), l AS (
  SELECT conv_id, turn, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m
), k AS (
  SELECT conv_id, turn, text, pos, length(regexp_replace(regexp_extract(line, '^[ \t]*>[ \t>]*'), '[^>]', '', 'g')) AS level,
         translate(trim(regexp_replace(regexp_replace(line, '^[ \t]*>[ \t>]*', ''), '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, text, level, key = '' ORDER BY pos) AS run FROM k
), p AS (
  SELECT conv_id, turn, text, level, min(pos) AS pos, string_agg(key, ' ' ORDER BY pos) AS key FROM r WHERE key <> '' GROUP BY conv_id, turn, text, level, run
), said AS (
  SELECT conv_id, turn, key FROM p WHERE level = 0 UNION SELECT conv_id, turn, key FROM k WHERE level = 0 AND key <> ''
), q AS (
  SELECT p.conv_id, p.turn, p.text, p.level, p.pos, max(said.turn) AS original
  FROM p LEFT JOIN said ON p.conv_id = said.conv_id AND p.key = said.key AND said.turn < p.turn
  WHERE p.level > 0 GROUP BY p.conv_id, p.turn, p.text, p.level, p.pos
), n AS (
  SELECT conv_id, turn, text, level, min(pos) OVER w AS pos, key || chr(10) || lead(key) OVER w AS key, pos AS at_pos FROM r WHERE key <> ''
  WINDOW w AS (PARTITION BY conv_id, turn, text, level, run ORDER BY pos)
), h AS (
  SELECT a.conv_id, a.turn, a.text, a.level, a.pos, a.at_pos, max(b.turn) AS original
  FROM n a LEFT JOIN n b ON b.level = 0 AND a.conv_id = b.conv_id AND a.key = b.key AND b.turn < a.turn
  WHERE a.level > 0 AND a.key IS NOT NULL GROUP BY ALL
), trimmed AS (
  SELECT conv_id, turn, text, level, pos, max(original) AS original FROM h GROUP BY conv_id, turn, text, level, pos HAVING count(original) = count(*) AND min(original) = max(original)
), q2 AS (
  SELECT q.conv_id, q.turn, q.text, q.level, q.pos, coalesce(q.original, trimmed.original) AS original
  FROM q LEFT JOIN trimmed ON q.conv_id = trimmed.conv_id AND q.turn = trimmed.turn AND q.text = trimmed.text AND q.level = trimmed.level AND q.pos = trimmed.pos
), links AS (
  SELECT conv_id, turn, text, count(*) AS n_quotes, count(original) AS n_linked, arg_min(original, level * 1000000000 + pos) FILTER (original IS NOT NULL) AS parent_turn
  FROM q2 GROUP BY conv_id, turn, text
), up AS (
  SELECT conv_id, turn, min(parent_turn) AS up FROM links WHERE parent_turn IS NOT NULL GROUP BY conv_id, turn
), walk(conv_id, turn, far, depth) AS (
  SELECT conv_id, turn, up, 1 FROM up
  UNION ALL
  SELECT walk.conv_id, walk.turn, up.up, walk.depth + 1 FROM walk JOIN up ON walk.conv_id = up.conv_id AND walk.far = up.turn
), t AS (
  SELECT conv_id, turn, arg_max(far, depth) AS thread_turn, max(depth) AS depth FROM walk GROUP BY conv_id, turn
)
SELECT c.conv_id, c.turn, c.role, coalesce(links.n_quotes, 0)::BIGINT AS n_quotes, coalesce(links.n_linked, 0)::BIGINT AS n_linked, links.parent_turn,
       CASE WHEN c.conv_id IS NOT NULL THEN coalesce(t.thread_turn, c.turn) END AS thread_turn,
       CASE WHEN c.conv_id IS NOT NULL AND c.turn IS NOT NULL THEN coalesce(t.depth, 0)::BIGINT END AS depth,
       sha256(CASE WHEN regexp_matches(c.text, '(^|\n)[ \t]*>') THEN array_to_string(list_filter(string_split(c.text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)) ELSE coalesce(c.text, '') END) AS own_sha256
FROM conversations c
LEFT JOIN links ON c.conv_id = links.conv_id AND c.turn = links.turn AND c.text = links.text
LEFT JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn
"""
