"""Consistent hashing with virtual nodes and bounded loads.

Every shard owns ``nodes`` points of a ring of 64-bit hashes; a key belongs to
the arc whose end is the next point clockwise.  A shard's capacity is its exact
share of the rows (counts at most one apart).  What overflows a full shard goes
on clockwise to the next point whose shard has room, so all rows find a place
and only overflowing keys leave their home.

The rows are counted per arc with partial aggregation; an arc of many rows is cut
into cells of about CELL_ROWS, so that a key which holds a third of all rows fills
many cells and no task.  Cells are counted too, and the counts (at most one for
each arc and each CELL_ROWS rows) are poured along the ring on the driver; each
cell's pouring is a list of rank ranges with their shard and first slot.  Rows get
their rank within the cell by a window, and look the range up.

Defined results: equal rows are interchangeable and get different slots; null
keys hash to a place like any other; an empty table gives an empty result;
columns other than the result's own are kept, whatever their names, and those of
the same names (shard, slot) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.runtime import stash

NODES, CELL_ROWS = 64, 500_000


def _ring(spark, shards: int, nodes: int) -> list[tuple[int, int]]:
    """(hash, shard) of all points in ring order; the hash is Spark's, so it is the same everywhere."""
    rows = spark.range(shards * nodes).selectExpr(f"CAST(id DIV {nodes} AS int) AS shard", f"xxhash64(CAST(id DIV {nodes} AS string), CAST(id % {nodes} AS string)) AS at").collect()
    return sorted((r["at"], r["shard"]) for r in rows)


def pour(counts: dict[tuple[int, int], int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges (arc, cell, first rank, end rank, shard, first slot). counts: rows of each (arc, cell); owners: the shard of each arc."""
    total = sum(counts.values())
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    out: list[tuple[int, int, int, int, int, int]] = []
    waiting: list[tuple[int, int, int, int]] = []  # ranges that overflowed, oldest first

    def place(arc: int, cell: int, a: int, z: int, shard: int) -> int:
        n = min(z - a, quota[shard] - filled[shard])
        if n > 0:
            out.append((arc, cell, a, a + n, shard, filled[shard]))
            filled[shard] += n
        return a + max(n, 0)

    # Keys take their home first; then each overflow goes on clockwise from its home.
    for (arc, cell), n in sorted(counts.items()):
        a = place(arc, cell, 0, n, owners[arc])
        if a < n:
            waiting.append((arc, cell, a, n))
    for arc, cell, a, z in waiting:
        at = arc
        while a < z:
            at = (at + 1) % len(owners)
            a = place(arc, cell, a, z, owners[at])
    return out


def assign(df: DataFrame, key: str, ties: list[str], shards: int, nodes: int = NODES) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    spark = df.sparkSession
    ring = _ring(spark, shards, nodes)
    # The arc of a key ends at the first point after its hash. The top bits of the hash lead to the few arcs that reach into that part of the ring.
    bits, place = 12, F.col("own.place")
    top = F.shiftrightunsigned(place.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int")
    spans = []
    edges = [-(1 << 63), *(at for at, _ in ring), (1 << 63) - 1]
    for i in range(len(ring) + 1):
        lo, hi = edges[i], edges[i + 1]
        for part in range((lo + (1 << 63)) >> (64 - bits), ((hi + (1 << 63)) >> (64 - bits)) + 1):
            spans.append((part, lo, hi, i % len(ring), i == len(ring)))
    arcs = F.broadcast(spark.createDataFrame(spans, "part int, lo long, hi long, arc int, last boolean"))
    # What the caller's columns are called doesn't matter: they travel in one column, and the keys in another.
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate([key, *ties])]
    base = df.select(F.struct(*kept).alias("row"), F.struct(F.xxhash64(F.lit("key"), F.col(key).cast("string")).alias("place"), *keys).alias("own"))
    within = (top == F.col("part")) & (place >= F.col("lo")) & ((place < F.col("hi")) | F.col("last"))
    homed = base.join(arcs, within).select("row", "own", "arc")
    many = {r["arc"]: math.ceil(r["n"] / CELL_ROWS) for r in homed.groupBy("arc").agg(F.count("*").alias("n")).filter(F.col("n") > CELL_ROWS).collect()}
    if many:  # equal rows differ in nothing but their place in the table, so that is written down once and read by both passes below
        cells = F.broadcast(spark.createDataFrame(list(many.items()), "arc int, cells int"))
        dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("cells", F.lit(1))).cast("int")
        homed = stash(homed.join(cells, "arc", "left").withColumn("cell", dealt).drop("cells"), "homed")
    else:
        homed = homed.withColumn("cell", F.lit(0))
    counts = {(r["arc"], r["cell"]): r["n"] for r in homed.groupBy("arc", "cell").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return df.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    by_cell: dict[tuple[int, int], list] = {}
    for arc, cell, a, z, shard, slot in pour(counts, [s for _, s in ring], shards):
        by_cell.setdefault((arc, cell), []).append((a, z, shard, slot))
    lookup = F.broadcast(spark.createDataFrame([(arc, cell, v) for (arc, cell), v in by_cell.items()], "arc int, cell int, ranges array<struct<a:long,z:long,shard:int,slot:long>>"))
    rank = (F.row_number().over(Window.partitionBy("arc", "cell").orderBy("own")) - 1).cast("long")
    found = homed.withColumn("rank", rank).join(lookup, ["arc", "cell"]).withColumn("hit", F.filter("ranges", lambda r: (r["a"] <= F.col("rank")) & (F.col("rank") < r["z"]))[0])
    return found.select("row.*", F.col("hit.shard").alias("shard"), (F.col("hit.slot") + F.col("rank") - F.col("hit.a")).alias("slot"))
