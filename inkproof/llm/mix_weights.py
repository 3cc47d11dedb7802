"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's documents stand in one fixed order. Each is expected to be taken target / size of the
source times; with one random offset for the source, a document is emitted once for each integer
that the running sum of the expected copies crosses at it. Documents of like size stand together,
so the words that are taken follow the expectation closely.

The running sum is a document's number in its source times the rate. The number comes from two
levels, so that no source is ever sorted in one task: rows are counted in buckets (size class, two
digits of the key's digest), the counts are summed up along the at most few thousand buckets of a
source, and rows are numbered inside their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkproof.llm.common import stored, word_count

WEIGHTS, BUDGET, MOST, SEED = (3, 1, 2), 1.5, 2.0, "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """(group, source_size, target) from (group, source, words): a row for each source.

    The budget is dealt out by weight; a source stops at `most` times its size and what is over goes
    to the others by weight. In the order of limit over weight, the level at which the first source
    does not stop is the level of all that follow. There is one row a source here, so one task is enough.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("words") * F.lit(most))
    rows = rows.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    rows = (
        rows.withColumn("used", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("words").over(whole) * F.lit(budget))
        .withColumn("level", (F.col("total") - F.col("used")) / F.col("open"))
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("none"), "source", "level"))).over(whole))
    )
    target = F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("final.level")))
    return rows.select("group", F.col("words").alias("source_size"), target.alias("target"))


def offset_of(group: Column, seed: str) -> Column:
    """A number from 0 to under 1 that only the source and the seed decide."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), group).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of docs (doc_id, text, source).

    Null and blank texts have size 0; a source of such texts only has target 0. A null source is a source
    of its own and comes last. Rows with equal ids and sizes are interchangeable: which of them gets
    a copy is open, the result is the same.
    """
    group = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select("doc_id", "source", group.alias("group"), word_count(F.col("text")).alias("size"), digest.alias("digest"))
    sized = stored(
        sized.withColumn("class", F.length(F.bin("size"))).withColumn("part", F.substring("digest", 1, 2)), "sizes")
    buckets = sized.groupBy("group", "class", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"), F.first("source").alias("source"))
    buckets = stored(buckets, "buckets")
    targets = source_targets(buckets.groupBy("group").agg(F.first("source").alias("source"), F.sum("words").alias("words")), weights, budget, most)
    before = Window.partitionBy("group").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.select("group", "class", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")).join(targets, "group")
    inside = Window.partitionBy("group", "class", "part").orderBy("size", "digest", "doc_id")
    rows = sized.withColumn("at", F.row_number().over(inside)).join(placed, ["group", "class", "part"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    end = F.col("before") + F.col("at")
    start = offset_of(F.col("group"), seed)
    copies = F.floor(start + end * rate) - F.floor(start + (end - 1) * rate)
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores behind it while it is taken (letter case does not tell names apart)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def emit(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the number of the copy in a last column `copy`.

    Rows that share an id are taken equally often. All columns of docs stay as they are: if there is one
    called `copy`, the number's name gets underscores behind it.
    """
    own, times, number = (free_name(n, docs.columns) for n in ("taken_id", "copies", "copy"))
    taken = mix(docs.select("doc_id", "source", "text"), **settings).groupBy(F.col("doc_id").alias(own)).agg(F.max("copies").alias(times)).filter(F.col(times) > 0)
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(own)))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(number))


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, '-') AS grp,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}/' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
), bucketed AS (
  SELECT *, length(bin(size)) AS class, substr(digest, 1, 2) AS part FROM sized
), sources AS (
  SELECT grp, any_value(source) AS source, sum(size)::BIGINT AS words FROM sized GROUP BY grp
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1] AS weight,
         words * 2.0::DOUBLE AS most
  FROM sources
), levelled AS (
  SELECT *, most / weight AS ratio,
         (sum(words) OVER () * 1.5::DOUBLE
          - coalesce(sum(most) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), final AS (
  SELECT level FROM levelled WHERE level <= ratio ORDER BY ratio, encode(source) NULLS LAST LIMIT 1
), targets AS (
  SELECT grp, words, least(most, coalesce(weight * (SELECT level FROM final), most)) AS target,
         ('0x' || substr(md5('{SEED}/' || grp), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM levelled
), numbered AS (
  SELECT b.*, words, target, start, row_number() OVER (PARTITION BY b.grp ORDER BY class, part, size, digest, doc_id NULLS FIRST) AS place,
         CASE WHEN words > 0 THEN target / words ELSE 0.0::DOUBLE END AS rate
  FROM bucketed b JOIN targets t ON b.grp = t.grp
)
SELECT doc_id, size, words AS source_size, target,
       ((floor(start + place * rate) - floor(start + (place - 1) * rate)) * size)::BIGINT AS taken
FROM numbered
"""
