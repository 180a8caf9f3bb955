"""Versioned dimensions: half-open validity, as-of joins and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.model import Refused


def as_of_join(facts: DataFrame, history: DataFrame, key: str, at: str, columns: list[str], block: str = "year") -> DataFrame:
    """facts with the attributes in force at each row's date. Rows without a key or date, or with none in force, are left out.

    The distinct (key, date) pairs of the facts and the versions' beginnings make one stream, in which the last version is carried
    forward; no row meets more than one version.  The stream is cut by key and block of time, so a key of many dates is several
    windows, and each block takes over what was in force at its beginning.  Versions of a key don't overlap; problems() tells those that do.
    """
    when, held = facts.schema[at].dataType, F.struct("valid_from", "valid_to", *columns)
    points = facts.select(F.col(key).alias("id"), F.col(at).alias("day")).dropna().distinct().withColumn("kind", F.lit(1))
    begins = history.filter("valid_from IS NOT NULL").select("id", F.col("valid_from").cast(when).alias("day"), F.lit(0).alias("kind"), held.alias("version"))
    stream = points.unionByName(begins, allowMissingColumns=True).withColumn("block", F.date_trunc(block, "day"))
    ends = stream.groupBy("id", "block").agg(F.max_by("version", F.when(F.col("kind") == 0, F.col("day"))).alias("end"))
    before = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("id", "block", F.last("end", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("id", "block").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = stream.withColumn("version", F.last("version", ignorenulls=True).over(within)).filter("kind = 1").join(carried, ["id", "block"])
    found = last.select(F.col("id").alias("_key"), F.col("day").alias("_day"), F.coalesce("version", "carried").alias("_version"))
    good = found.filter(F.col("_version").isNotNull() & (F.col("_version.valid_to").isNull() | (F.col("_day") < F.col("_version.valid_to"))))
    return facts.join(good, (facts[key] == good["_key"]) & (facts[at] == good["_day"])).select(*[facts[c] for c in facts.columns], *[good[f"_version.{c}"].alias(c) for c in columns])


def as_of_point(history: DataFrame, day: str) -> DataFrame:
    d = F.lit(day).cast("date")
    return history.filter((F.col("valid_from") <= d) & (F.col("valid_to").isNull() | (d < F.col("valid_to"))))


def first_versions(current: DataFrame, history: DataFrame, start: str, columns: list[str]) -> DataFrame:
    """A first version for members without any, from the batch's earliest period."""
    new = current.join(history.select("id").distinct(), "id", "left_anti")
    return new.select("id", F.lit(start).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current"), *columns)


def apply_changes(history: DataFrame, changes: DataFrame, columns: list[str], effective: str) -> DataFrame:
    """Closes the open version of changed members at a date and opens a new one; unchanged members keep theirs."""
    day = F.lit(effective).cast("date")
    if several := changes.groupBy("id").count().filter("count > 1").limit(1).collect():
        raise Refused("SEVERAL_CHANGES", str(several[0]["id"]))  # which of them would be the version of that day can't be told
    new = changes.select("id", F.lit(True).alias("named"), *[F.col(c).alias(f"new_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"new_{c}"))
    marked = history.join(new, "id", "left").withColumn("changed", F.col("is_current") & ~same & F.coalesce("named", F.lit(False)))
    if not marked.filter(F.col("changed") & (F.col("valid_from") >= day)).isEmpty():
        raise Refused("EFFECTIVE_DATE_TOO_EARLY", effective)
    row = lambda *v: F.struct(*[x.alias(n) for n, x in zip(("valid_from", "valid_to", "is_current", *columns), v, strict=True)])
    own = [F.col(c) for c in columns]
    closed = row(F.col("valid_from"), F.when(F.col("changed"), day).otherwise(F.col("valid_to")), F.col("is_current") & ~F.col("changed"), *own)
    opened = row(day, F.lit(None).cast("date"), F.lit(True), *[F.col(f"new_{c}") for c in columns])
    versions = F.when(F.col("changed"), F.array(closed, opened)).otherwise(F.array(closed))
    return marked.select("id", F.explode(versions).alias("v")).select("id", "v.*")


def problems(current: DataFrame, history: DataFrame, columns: list[str]) -> DataFrame:
    """Breaches of the five invariants: (problem, id)."""
    open_ = history.filter("valid_to IS NULL OR is_current")
    tell = lambda df, what: df.select(F.lit(what).alias("problem"), "id")
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(f"cur.{c}").eqNullSafe(F.col(f"open.{c}"))
    return (
        tell(current.join(open_.select("id"), "id", "left_anti"), "no open version")
        .unionByName(tell(current.alias("cur").join(open_.alias("open"), F.col("cur.id") == F.col("open.id")).filter(differ).select(F.col("cur.id").alias("id")).distinct(), "differs from open version"))
        .unionByName(tell(history.select("id").distinct().join(current.select("id"), "id", "left_anti"), "orphan history"))
        .unionByName(tell(open_.groupBy("id").count().filter("count > 1"), "several open versions"))
        .unionByName(tell(history.filter("is_current <> (valid_to IS NULL) OR valid_to <= valid_from"), "contradiction"))
    )
