"""Loading of a batch: windows, coordinates, conflicts, replacement, staging and replay."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.exprs import window_start
from marlstone.model import CALIBERS, Refused

COORDINATE = ["fin_month", "period_from", "company_id", "metric_id", "scenario", "ccy"]


def assign_window(rows: DataFrame) -> DataFrame:
    """rows (fin_month, caliber, ...) with the landed period and window start. Calculators and unknown calibers get nulls; see refused_calibers."""
    landed, start = F.lit(None).cast("date"), F.lit(None).cast("date")
    for name, c in CALIBERS.items():
        if c.kind != "calculator":
            month = F.add_months("fin_month", 12 * c.years) if c.years else F.col("fin_month")
            landed = F.when(F.col("caliber") == name, month).otherwise(landed)
            start = F.when(F.col("caliber") == name, window_start(c, month)).otherwise(start)
    return rows.withColumns({"landed": landed, "period_from": start})


def refused_calibers(rows: DataFrame) -> DataFrame:
    good = [n for n, c in CALIBERS.items() if c.kind != "calculator"]
    calculators = [n for n, c in CALIBERS.items() if c.kind == "calculator"]
    reason = F.when(F.col("caliber").isin(calculators), "CALIBER_NOT_INGESTIBLE").otherwise("CALIBER_NOT_DECLARED")
    return rows.filter(~F.coalesce(F.col("caliber").isin(good), F.lit(False))).groupBy("caliber").agg(F.count("*").alias("n")).withColumn("reason", reason)


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a coordinate: equal amounts collapse; different ones are marked as a conflict."""
    pair = F.struct(F.col("amount").isNull().alias("none"), F.coalesce("amount", F.lit(0)).alias("amount"))
    return rows.groupBy(*keys).agg(F.min("amount").alias("amount"), (F.min(pair) != F.max(pair)).alias("conflict"), F.count("*").alias("n"))


def _at(keys: list[str] = COORDINATE) -> Column:
    """The condition that rows aliased b and s have one coordinate; a null is a value like any other."""
    return reduce(lambda x, y: x & y, [F.col(f"b.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])


def collisions(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Coordinates of the batch that are stored already. The batch's months restrict the scan of the stored facts by partition."""
    months = batch.select("fin_month").distinct()
    near = stored.join(F.broadcast(months), "fin_month", "left_semi")
    return batch.alias("b").join(near.select(*COORDINATE).distinct().alias("s"), _at(), "left_semi")


def upserted(stored: DataFrame, batch: DataFrame, on_conflict: str = "replace", more: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows not in the batch, and the batch. With reject any shared coordinate refuses the load. more: columns beside coordinates and amount.

    Months that the batch doesn't touch pass through as they are; only the others meet the batch.
    """
    if on_conflict == "reject" and not collisions(batch, stored).isEmpty():
        raise Refused("CONFLICT_WITH_EXISTING")
    columns, months = [*COORDINATE, "amount", *more], F.broadcast(batch.select("fin_month").distinct())  # as many rows as there are months
    elsewhere = stored.join(months, "fin_month", "left_anti").select(*columns)
    return elsewhere.unionByName(months_with(stored, batch, more))


def months_with(stored: DataFrame, batch: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """What the batch's months hold after it: their stored rows at other coordinates, and the batch."""
    columns, months = [*COORDINATE, "amount", *more], F.broadcast(batch.select("fin_month").distinct())
    near = stored.join(months, "fin_month", "left_semi")
    return near.alias("s").join(batch.select(*COORDINATE).alias("b"), _at(), "left_anti").select(*columns).unionByName(batch.select(*columns))


def upsert_into(path: str, batch: DataFrame, on_conflict: str = "replace") -> None:
    """Replaces the batch's months of a fact table stored by month; other months are neither read nor written.

    What is to be written is worked out in full before the first partition is replaced, so a batch that fails has changed nothing.
    """
    spark = batch.sparkSession
    stored = spark.read.parquet(path)
    if on_conflict == "reject" and not collisions(batch, stored).isEmpty():
        raise Refused("CONFLICT_WITH_EXISTING")
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    months_with(stored, batch).write.parquet(aside)
    ready = spark.read.parquet(aside)
    ready.hint("rebalance", "fin_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fin_month").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(aside)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def reconciled(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Batches whose stored count differs from the expected one."""
    counts = stored.groupBy("batch_id").agg(F.count("*").alias("n_stored"))
    return counts.join(expected, "batch_id", "full").filter(~F.col("n_stored").eqNullSafe(F.col("n_expected")))


def staged(rows: DataFrame, degenerate: list[str]) -> DataFrame:
    """Rows with their degenerate columns as JSON with sorted keys."""
    entries = F.array_sort(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in degenerate]))
    return rows.withColumn("degenerate", F.to_json(F.map_from_entries(entries)))


def replay_diff(again: DataFrame, stored: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Cells that are missing (expanded again, but not stored), extra (stored only), or differ in a field; values are not shown. Null keys are keys."""
    side = lambda df, s: df.select(*[F.col(k).alias(f"{s}k_{k}") for k in keys], *[F.col(f).alias(f"{s}_{f}") for f in fields], F.lit(True).alias(f"in_{s}"))
    same = reduce(lambda x, y: x & y, [F.col(f"ak_{k}").eqNullSafe(F.col(f"bk_{k}")) for k in keys])
    joined = side(again, "a").join(side(stored, "b"), same, "full")
    differ = F.filter(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    kinds = F.when(F.col("in_b").isNull(), F.array(F.lit("missing"))).when(F.col("in_a").isNull(), F.array(F.lit("extra"))).otherwise(differ)
    key = lambda k: F.when(F.col("in_a"), F.col(f"ak_{k}")).otherwise(F.col(f"bk_{k}")).alias(k)
    return joined.select(*[key(k) for k in keys], F.explode(kinds).alias("what"))


def missing_periods(batch: DataFrame, periods: DataFrame) -> DataFrame:
    return batch.select("fin_month").distinct().join(periods.select("fin_month"), "fin_month", "left_anti")
