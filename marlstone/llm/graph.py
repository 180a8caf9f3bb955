"""Connected components of an edge table, by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import mark, release, stash


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node of it) for every node of the edges (a, b).

    Each round, every node joins the neighbour, or itself, that a fresh hash
    ranks first, and edges move to what their ends joined.  That leaves a
    constant fraction of the edges at most, so rounds grow with the logarithm of
    the input and never with a path's length.  Nothing is collected.
    """
    spark, began = edges.sparkSession, mark()
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    edges = stash(edges.filter("a <> b").select(*pair("a", "b")).distinct(), "edges")
    labels, turn = None, 0
    while True:
        rank = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = stash(both.groupBy("a").agg(F.min(rank("b")).alias("best")).select(F.col("a").alias("node"), F.least(F.col("best"), rank("a"))["id"].alias("root")), "roots")
        if labels is None:
            labels = joined
        else:
            onward = joined.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = stash(labels.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        of = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        edges = stash(edges.join(of("a"), "a").join(of("b"), "b").filter("a_root <> b_root").select(*pair("a_root", "b_root")).distinct(), "edges")
        turn += 1
        release(spark, began, labels, edges)
        if edges.isEmpty():
            break
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    out = stash(labels.join(least, "root").select("node", F.least("component", "node").alias("component")), "components")
    release(spark, began, out)
    return out
