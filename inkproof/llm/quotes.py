"""Quotation linking: conversations in reply order from messages that quote each other, by DataFrame functions.

A message's lines have a quote level: the number of > at their beginning. Lines of level 0 are its own
text; what it quotes at level 1 was written by the message it replies to, at level 2 by the one before
that, and so on. Passages are normalised and hashed. For every hash the earliest message that
has the passage as its own is its original, so a passage that thousands share costs one row each.

A quoted passage speaks for an original in three ways, the stronger first: the text with all that it
quoted itself, the whole text, single lines of it (by their length). The message with the most
weight among the earlier ones is the parent; the roots follow from pointer jumping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkproof.llm.common import let, stored

MARK = r"^((?:[ \t]?>)+)[ \t]?"
#: What mail programs write before a quotation.
ATTRIBUTION = r"(?i)(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
#: Weight of a text with its quotations, and of a whole text; a line weighs its length, up to this.
CHAIN, WHOLE, LINE = 10**12, 10**9, 10**6
#: Message numbers that share a bucket when the messages of a conversation are numbered.
BUCKET = 4096


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def quote_lines(body: Column) -> Column:
    """(level, text) of each line."""
    line = lambda x: F.struct(
        (F.length(F.regexp_extract(x, MARK, 1)) - F.length(F.translate(F.regexp_extract(x, MARK, 1), ">", ""))).alias("level"),
        F.regexp_replace(x, MARK, "").alias("text"))
    return F.transform(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), line)


def parsed(messages: DataFrame) -> DataFrame:
    """message_id, own (text without quotations), chain (normalised text of each level, 0 first), own_lines, quoted_lines."""
    at = lambda lines, level: F.transform(F.filter(lines, lambda x: x["level"] == level), lambda x: x["text"])
    rows = messages.select("message_id", quote_lines(F.col("body")).alias("all"))
    before_quote = F.filter(F.col("all"), lambda x, i: ~((x["level"] == 0) & x["text"].rlike(ATTRIBUTION) & (F.coalesce(F.get(F.col("all"), i + 1)["level"], F.lit(0)) > 0)))
    rows = rows.select("message_id", before_quote.alias("lines"))
    deepest = F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)))
    level_text = lambda level: normalised(F.array_join(at(F.col("lines"), level), "\n"))
    return rows.select(
        "message_id", F.btrim(F.array_join(at(F.col("lines"), 0), "\n"), F.lit(" \t\r\n")).alias("own"),
        F.transform(F.sequence(F.lit(0), deepest), level_text).alias("chain"),
        *[F.array_distinct(F.filter(F.transform(at(F.col("lines"), n), normalised), lambda x: F.length(x) > 0)).alias(name) for n, name in ((0, "own_lines"), (1, "quoted_lines"))])


def passages(rows: DataFrame, quoted: bool) -> DataFrame:
    """(message_id, hash, weight) of what a message has itself, or of what it quotes from the one before."""
    chain, lines = F.col("chain"), F.col("quoted_lines" if quoted else "own_lines")
    from_level = F.slice(chain, 2, F.size(chain)) if quoted else chain
    text = F.get(from_level, F.lit(0))
    entry = lambda kind, value, weight: F.struct(F.xxhash64(F.lit(kind), value).alias("hash"), weight.cast("long").alias("weight"))
    whole = F.when(F.length(text) > 0, F.array(
        entry("chain", F.array_join(from_level, "\x00"), F.lit(CHAIN)), entry("whole", text, F.lit(WHOLE))))
    single = F.transform(lines, lambda x: entry("line", x, F.least(F.length(x), F.lit(LINE))))
    return rows.select("message_id", F.explode(F.array_distinct(F.concat(F.coalesce(whole, F.array().cast("array<struct<hash: bigint, weight: bigint>>")), single))).alias("p")).select("message_id", "p.hash", "p.weight")


def parents(rows: DataFrame) -> DataFrame:
    """(message_id, parent_id) of the messages that quote an earlier one."""
    originals = passages(rows, False).groupBy("hash").agg(F.min("message_id").alias("original"))
    originals = originals.select(F.col("hash").bitwiseXOR(F.lit(1)).alias("at"), "original")  # another key: dealt out anew, so hot passages can be split
    found = passages(rows, True).join(originals, (F.col("hash").bitwiseXOR(F.lit(1)) == F.col("at")) & (F.col("original") < F.col("message_id")))
    votes = found.groupBy("message_id", "original").agg(F.sum("weight").alias("weight"))
    return votes.groupBy("message_id").agg(F.max(F.struct("weight", (-F.col("original")).alias("early"))).alias("best")).select("message_id", (-F.col("best.early")).alias("parent_id"))


def roots(links: DataFrame) -> DataFrame:
    """(message_id, root, depth) for (message_id, parent_id): a parent is always earlier, so there is no circle.

    Each turn replaces a message's ancestor by that one's own ancestor. A message whose ancestor is a
    first message, or has its root already, is settled and moves no more.
    """
    active = stored(links.select("message_id", F.col("parent_id").alias("root"), F.lit(1).alias("depth")), "jumps")
    settled = None
    while True:
        known = active.withColumn("final", F.lit(False))
        if settled is not None:
            known = known.unionByName(settled.withColumn("final", F.lit(True)))
        up = known.select(F.col("message_id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), "final")
        turned = stored(active.join(up, "root", "left").select(
            "message_id", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.coalesce("final", F.lit(True)).alias("final")), "turn")
        done = turned.filter("final").drop("final")
        settled = done if settled is None else settled.unionByName(done)
        active = turned.filter("not final").drop("final")
        if active.isEmpty():
            return settled


def conversations(messages: DataFrame) -> DataFrame:
    """message_id, conversation_id, parent_id, depth, position, text and n_quoted_lines for every row of messages.

    messages: message_id (bigint, in the order of time) and body. Ids are expected once: of repeated rows
    the smallest body counts; rows without an id are left out. Null bodies are empty texts that nothing
    links to. conversation_id is the first message's id; position counts from 0 in the order of the ids,
    in which every reply stands after what it replies to.
    """
    own = messages.filter(F.col("message_id").isNotNull()).groupBy("message_id").agg(F.min(F.coalesce("body", F.lit(""))).alias("body"))
    rows = stored(parsed(own), "messages")
    links = stored(parents(rows), "links")
    placed = roots(links)
    joined = (
        rows.select("message_id", "own", F.size("quoted_lines").alias("n_quoted_lines"))
        .join(links, "message_id", "left").join(placed, "message_id", "left")
        .withColumn("conversation_id", F.coalesce("root", "message_id")).withColumn("depth", F.coalesce("depth", F.lit(0)))
        .withColumn("bucket", F.floor(F.col("message_id") / BUCKET))
    )
    joined = stored(joined, "joined")
    before = Window.partitionBy("conversation_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = joined.groupBy("conversation_id", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.select("conversation_id", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conversation_id", "bucket").orderBy("message_id")
    return joined.withColumn("at", F.row_number().over(inside) - 1).join(counts, ["conversation_id", "bucket"]).select(
        "message_id", "conversation_id", "parent_id", "depth", (F.col("before") + F.col("at")).alias("position"), F.col("own").alias("text"),
        F.col("n_quoted_lines").cast("long").alias("n_quoted_lines"))


def as_mail(turns: DataFrame, spacing: int = 4096) -> DataFrame:
    """Turns of conversations as messages that quote the two turns before them, as mail programs do.

    turns: conv_id, turn, text; message_id is conv_id * spacing + turn. Where the turns need more room,
    the spacing grows to it, and negative turns are counted from the smallest one, so that no two turns
    share an id. Repeated turns count once (the smallest text); rows without a number are left out.
    """
    one = turns.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    one = stored(one, "turns")
    first, last = one.agg(F.min("turn"), F.max("turn")).first()
    first = min(0, first or 0)
    spacing = max(spacing, (last or 0) - first + 1)
    earlier = lambda k: one.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"q{k}"))
    quoted = lambda name, mark: F.when(F.col(name).isNotNull(), F.concat(F.lit(f"\n{mark} "), F.regexp_replace(name, "\n", f"\n{mark} ")))
    rows = one.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left")
    second = F.when(F.col("q1").isNotNull(), quoted("q2", ">>"))
    return rows.select(
        (F.col("conv_id").cast("long") * F.lit(spacing).cast("long") + (F.col("turn") - F.lit(first))).alias("message_id"),
        F.concat(F.col("text"), F.coalesce(quoted("q1", ">"), F.lit("")), F.coalesce(second, F.lit(""))).alias("body"))


SQL = r"""
WITH RECURSIVE one AS (
  SELECT conv_id, turn, min(coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), m AS (
  SELECT a.conv_id * 4096 + a.turn AS id, a.t AS t0, b.t AS t1, CASE WHEN b.t IS NOT NULL THEN c.t END AS t2
  FROM one a LEFT JOIN one b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 LEFT JOIN one c ON a.conv_id = c.conv_id AND a.turn = c.turn + 2
), n AS (
  SELECT id, t0, t1 IS NOT NULL AS quotes, trim(regexp_replace(lower(t0), '\s+', ' ', 'g')) AS n0, trim(regexp_replace(lower(t1), '\s+', ' ', 'g')) AS n1,
         trim(regexp_replace(lower(t2), '\s+', ' ', 'g')) AS n2, t1
  FROM m
), own AS (
  SELECT id, 'c' || concat_ws(chr(1), n0, n1, n2) AS k FROM n WHERE n0 <> ''
  UNION ALL SELECT id, 'w' || n0 FROM n WHERE n0 <> ''
  UNION ALL SELECT id, 'l' || trim(regexp_replace(lower(x), '\s+', ' ', 'g')) FROM (SELECT id, unnest(string_split(t0, chr(10))) AS x FROM n) WHERE trim(x) <> ''
), first AS (
  SELECT k, min(id) AS original FROM own GROUP BY k
), quoted AS (
  SELECT id, 'c' || concat_ws(chr(1), n1, n2) AS k, 1000000000000 AS w FROM n WHERE n1 <> ''
  UNION ALL SELECT id, 'w' || n1, 1000000000 FROM n WHERE n1 <> ''
  UNION ALL SELECT DISTINCT id, 'l' || trim(regexp_replace(lower(x), '\s+', ' ', 'g')), length(trim(regexp_replace(lower(x), '\s+', ' ', 'g')))
            FROM (SELECT id, unnest(string_split(t1, chr(10))) AS x FROM n WHERE quotes) WHERE trim(x) <> ''
), votes AS (
  SELECT id, original, sum(w) AS w FROM quoted JOIN first USING (k) WHERE original < id GROUP BY ALL
), links AS (
  SELECT id, original AS parent FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, original) = 1
), tree AS (
  SELECT m.id, m.id AS root, 0 AS depth FROM m WHERE m.id NOT IN (SELECT id FROM links)
  UNION ALL
  SELECT l.id, t.root, t.depth + 1 FROM links l JOIN tree t ON l.parent = t.id
)
SELECT n.id AS message_id, root AS conversation_id, parent AS parent_id, depth,
       row_number() OVER (PARTITION BY root ORDER BY n.id) - 1 AS position, trim(t0, chr(32) || chr(9) || chr(10) || chr(13)) AS text,
       coalesce((SELECT count(DISTINCT k) FROM quoted q WHERE q.id = n.id AND q.k[1] = 'l'), 0)::BIGINT AS n_quoted_lines
FROM n JOIN tree USING (id) LEFT JOIN links USING (id)
"""
