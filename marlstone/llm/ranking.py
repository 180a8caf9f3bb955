"""Places in a global order, without a window over everything."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import stash


def placed(df: DataFrame, order: list[Column], name: str = "placed") -> DataFrame:
    """df with ``place``, from 0 in the given order.

    Rows are dealt out by ranges of the order and sorted there; the driver adds up the counts of the ranges (a number for each
    partition).  df is read twice, for the ranges' bounds and for the rows.  Rows that agree in the whole order go to one task:
    end the order with a hash of something that tells copies apart.
    """
    part, at = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": part, "_at": at}), name)
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    before = dict(zip(parts, accumulate([0, *(counts[p] for p in parts)]), strict=False))
    offsets = F.broadcast(df.sparkSession.createDataFrame(list(before.items()), "_part int, _before long"))
    return rows.join(offsets, "_part").withColumn("place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
