"""Connected components of an edge table, by the smallest key and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkproof.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(key, root) for every key in edges (a, b); root is the smallest key of the component.

    Each turn takes the smallest root among the neighbours and then the root of that root. Only two
    keys a row are ever moved, and every turn is stored, so a lost executor costs one turn.
    """
    both = stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neighbours")
    roots = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("key").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        moved = roots.join(near, roots["key"] == near["a"]).select("key", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        moved = stored(moved, "moved")
        jumps = moved.select(F.col("key").alias("to"), F.col("to").alias("beyond"))
        turned = stored(moved.join(jumps, "to").select("key", F.least("to", "beyond").alias("root"), "was"), "turn")
        changed = turned.filter(F.col("root") != F.col("was")).limit(1).count()
        roots = turned.select("key", "root")
        if not changed:
            return roots
