"""Mixing sources to target weights by capped water-filling.

Targets.      All sources share a budget of words by weight.  A source whose share is
              above its cap (so many epochs of its words) is clamped there, and what it
              can't take is shared by the others in proportion to their weights, until
              none is above.  The clamped are those with ``weight * level > cap``, so a
              round is one aggregate over the table of sources, and the driver holds
              nothing but the level; it only rises, and every round clamps one more
              source at least.
Repetitions.  A source takes its documents ``target div words`` times whole.  What is
              left of the target is filled with one more copy of documents in the
              order of a seeded hash of their ids, and the document at the edge gives
              its first words only: the source's words come to its target, rounded
              down.
Edges.        Where the order crosses what is left is searched level by level: words by
              cells of 12 bits of the hash, then by cells within the cell that holds
              the edge, and so on to the row.  So a source that holds a third of all
              rows is summed by partial aggregation and never sorted, and a level has at
              most 4096 cells a source.  Rows that are equal in id and size go on by a
              hash of their place in the table; which of them is taken makes no difference.

Defined results: null, empty and blank texts have no words, and nothing is taken of
them; null sources are a source of their own, the last; null ids hash like an empty
id; rows that repeat an id get a row each, and equal ones are interchangeable; sources
without a weight, or with one that isn't positive, get nothing; where all sources are
clamped, each gets its cap; an empty table gives an empty result; other columns are
ignored but for those to be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.ranking import placed
from marlstone.llm.runtime import mark, release, stash

SHARE, EPOCHS, SEED, BITS = 1.5, 2, "mix", 12
WORD, SPACES = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"


def words_in(text: Column) -> Column:
    """The number of words: each becomes a letter, and what lies between goes, so nothing larger than the text is made."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), SPACES, "")), F.lit(0)).cast("long")


def cycled(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source and weight: the weights in turn, over sources by code point, null last."""
    ranks = placed(sources.select("source").distinct(), [F.col("source").asc_nulls_last()], "sources")
    return ranks.select("source", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """sources (source, source_size, weight) with target. Read once a round: pass what is stored."""
    cap, weight = F.col("source_size") * F.lit(float(epochs)), F.when(F.col("weight") > 0, F.col("weight")).otherwise(0).cast("double")
    budget, level, clamped = None, 0.0, -1
    while True:
        above = weight * F.lit(level) > cap
        r = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, cap)).alias("full"), F.sum(F.when(~above, weight)).alias("free"), F.count_if(above).alias("n")).first()
        if budget is None:
            budget = share * (r["all"] or 0)
        if r["n"] == clamped or not r["free"]:
            break
        clamped, level = r["n"], (budget - (r["full"] or 0.0)) / r["free"]
    return sources.withColumn("target", F.when(weight * F.lit(level) > cap, cap).otherwise(weight * F.lit(level)))


def _edge(cells: DataFrame, left: DataFrame) -> DataFrame:
    """Of each source the cell where its words, in order, come to be more than what is left: (source, cell, n, rows, first, left), now what is left within it."""
    order = Window.partitionBy("source").orderBy("cell")
    sums = cells.withColumn("upto", F.sum("n").over(order)).alias("c").join(left.alias("l"), F.col("c.source").eqNullSafe(F.col("l.source")))
    held = sums.filter((F.col("upto") > F.col("l.left")) & (F.col("upto") - F.col("n") <= F.col("l.left")))
    return held.select("c.source", "cell", "n", "rows", "first", (F.col("l.left") - F.col("upto") + F.col("n")).alias("left"))


def _edges(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """source, first (the order's key of the row at its edge) and left (the words that this row gives)."""
    spark, began = sized.sparkSession, mark()
    of = lambda *names: F.struct(*[F.col(f"key.{n}") for n in names])
    top = lambda name, skipped: F.shiftright(f"key.{name}", 60 - (skipped + 1) * BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    levels = [top("hash", 0), top("hash", 1), of("hash", "size"), top("salt", 0), top("salt", 1), of("salt", "row")]  # each refines the key's order
    rows, left = sized.filter("size > 0").select("source", "key", "size"), plan.select("source", "left").filter("left IS NOT NULL")
    for level in levels:
        own = rows.withColumn("cell", level)
        cells = own.groupBy("source", "cell").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("key").alias("first"))
        edges = stash(_edge(cells, left), "edges")
        if not edges.filter("rows > 1").limit(1).count():
            break
        within = own.alias("r").join(edges.select("source", "cell").alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.cell") == F.col("e.cell")), "left_semi")
        rows, left = stash(within.select("source", "key", "size"), "within"), edges.select("source", "left")
    release(spark, began, edges)
    return edges.select("source", "first", "left")


def mix(df: DataFrame, weights: DataFrame | tuple[int, ...], share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target (its source's), whole and part (copies, and words of one more copy), taken, and ``kept``, a struct of the columns to keep.

    weights: of each source, by (source, weight), or in turn over the sources by code point.
    """
    own = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col).cast("string")).alias("size")]
    rows = df.select(*own, *([F.struct(*keep).alias("kept")] if keep else []))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    salt = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)
    key = F.struct(hashed.alias("hash"), "size", salt.alias("salt"), F.monotonically_increasing_id().alias("row"))
    sized = stash(rows.withColumn("key", key), "sized")  # texts are read once
    sums = stash(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    weight = cycled(sums, weights) if isinstance(weights, tuple) else weights.groupBy(F.col("source").cast("string").alias("source")).agg(F.max("weight").alias("weight"))
    weighed = sums.alias("s").join(weight.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left").select("s.source", "source_size", "weight")
    planned = targets(stash(weighed, "weights"), share, epochs)
    some = F.col("source_size") > 0
    planned = planned.withColumn("whole", F.when(some, F.floor("target").cast("long") - F.pmod(F.floor("target").cast("long"), F.col("source_size"))).otherwise(0))
    planned = planned.withColumn("left", F.when(some, F.floor("target").cast("long") - F.col("whole"))).withColumn("whole", F.when(some, F.expr("whole DIV source_size")).otherwise(0))
    planned = stash(planned, "plan")
    edges = _edges(sized, planned).select("source", F.col("first").alias("edge"), F.col("left").alias("piece"))
    plan = planned.alias("p").join(edges.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left").select("p.*", "edge", "piece")
    at = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    part = F.when(F.col("d.key") < F.col("edge"), F.col("size")).when(F.col("d.key") == F.col("edge"), F.col("piece")).otherwise(0)
    out = at.select("d.doc_id", "d.source", "size", "source_size", "target", "whole", part.alias("part"), *(["kept"] if keep else []))
    return out.withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def texts(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, copy (from 0) and text of everything a mix takes. mixed: from mix, with the text kept. A copy that isn't whole is its first words, joined by spaces."""
    text, cut = F.col(f"kept.{text_col}"), (F.col("part") > 0) & (F.col("part") < F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    copies = F.when(F.col("taken") > 0, F.sequence(F.lit(0), F.col("whole") + (F.col("part") > 0).cast("int") - 1)).otherwise(F.array().cast("array<long>"))
    each = mixed.withColumn("copy", F.explode(copies))
    return each.select("doc_id", "copy", F.when(cut & (F.col("copy") == F.col("whole")), first).otherwise(text).alias("text"))
