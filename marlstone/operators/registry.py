"""Registered masters and declarations: label snapshots, load outcomes, metric claims, names in bridges, the batch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.exprs import entity_id, normalize_name
from marlstone.model import Refused
from marlstone.operators import masters


def snapshot(kinds: dict[str, tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """(kind, norm, id) of every label; registered aliases win over names."""
    out = None
    for kind, (rows, aliases) in kinds.items():
        part = masters.known_names(rows, aliases).select(F.lit(kind).alias("kind"), "norm", "id")
        out = part if out is None else out.unionByName(part)
    return out


def unresolved_report(unmatched: DataFrame, candidates: DataFrame) -> DataFrame:
    """raw, n_rows and the suggested ids, best first, comma-joined; most rows first, then by name."""
    best = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ",")
    return unmatched.join(candidates.groupBy("raw").agg(best.alias("candidates")), "raw", "left").orderBy(F.desc("n_rows"), "raw")


def load_outcome(decided: DataFrame, names: DataFrame) -> DataFrame:
    """Names and their rows by planned status, before anything is written."""
    return decided.select("raw", "status").join(names, "raw").groupBy("status").agg(F.count("*").alias("n_names"), F.sum("weight").cast("long").alias("n_rows"))


def alias_list(aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """Aliases with the name of their target, by kind and alias."""
    target = rows.select(F.col("id").alias("target"), F.col("name").alias("target_name"))
    return aliases.join(target, "target", "left").select("kind", F.col("normalized").alias("alias"), "target", "target_name").orderBy("kind", "alias")


def metric_claims(declared: DataFrame, owners: DataFrame) -> DataFrame:
    """declared (name, labels) with the id that their labels own, spelled in whatever way: one owner is kept, none makes a new id.

    Several owners are a conflict, and so is an owner that several names claim. A name without labels is new.
    """
    labels = declared.select("name", F.explode_outer("labels").alias("label")).select("name", normalize_name(F.col("label")).alias("norm")).distinct()
    owned = labels.join(owners.select(normalize_name(F.col("label")).alias("norm"), "id").distinct(), "norm", "left")
    found = owned.groupBy("name").agg(F.countDistinct("id").alias("n_owners"), F.min("id").alias("owner"))
    single = found.withColumn("owner", F.when(F.col("n_owners") == 1, F.col("owner")))
    claims = single.filter("owner IS NOT NULL").groupBy("owner").agg(F.count("*").alias("n_claims"))
    joined = single.join(claims, "owner", "left")
    state = F.when(F.col("n_owners") == 0, "new").when((F.col("n_owners") == 1) & (F.col("n_claims") == 1), "kept").otherwise("conflict")
    new_id = F.when(F.col("state") == "new", F.concat(F.lit("new_"), normalize_name(F.col("name")))).when(F.col("state") == "kept", F.col("owner"))
    return joined.withColumn("state", state).select("name", "n_owners", new_id.alias("id"), "state")


def refused_inputs(rows: DataFrame, definitions: DataFrame, fact: str) -> DataFrame:
    """Metrics whose source amounts a load refuses: derived ones and those of another fact table. definitions (metric_id, fact, derived) are declared."""
    joined = rows.groupBy("metric_id").agg(F.count("*").alias("n")).join(definitions, "metric_id", "left")
    reason = F.when(F.col("derived").isNull(), "METRIC_NOT_DECLARED").when(F.col("derived"), "METRIC_IS_DERIVED").when(F.col("fact") != fact, "METRIC_OF_OTHER_FACT")
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select("metric_id", "n", "reason")


def declared_rows(names: DataFrame, prefix: str) -> DataFrame:
    """Declared members; their id depends on the name alone. Different names of one id are refused: what refers to it would be ambiguous."""
    rows = names.select(entity_id(F.col("name"), prefix).alias("id"), "name").distinct()
    shared = rows.groupBy("id").agg(F.count("*").alias("n"), F.min("name").alias("one"), F.max("name").alias("other")).filter("n > 1").limit(1).collect()
    if shared:
        raise Refused("ENTITY_ID_SHARED", f"{shared[0].one}, {shared[0].other}")
    return rows


def bridge_ids(rows: DataFrame, members: DataFrame, column: str = "name") -> DataFrame:
    """Bridge rows written with names, with ids; an unknown name keeps a null id."""
    known = members.groupBy("name").agg(F.min("id").alias("id"))
    return rows.join(known, rows[column] == known["name"], "left").drop(known["name"])


def synced(members: DataFrame, bridge: DataFrame, prefix: str) -> DataFrame:
    """Dimension and bridge rows staged together; one unknown name in the bridge refuses both."""
    dim = declared_rows(members, prefix)
    linked = bridge_ids(bridge, dim, "member")
    unknown = linked.filter("id IS NULL").select("member").distinct().orderBy("member").limit(20).collect()
    if unknown:
        raise Refused("UNKNOWN_NAME", ", ".join(r.member for r in unknown))
    return linked


def batch_log(log: DataFrame, latest: int = 50) -> DataFrame:
    return log.orderBy(F.desc("imported_at"), "batch_id").limit(latest)


def latest_batch(log: DataFrame) -> DataFrame:
    return log.groupBy("spec_id").agg(F.max_by("batch_id", F.struct("imported_at", "batch_id")).alias("batch_id"))


def search(log: DataFrame, direction: str | None = None, keyword: str = "") -> DataFrame:
    """Batches of a direction whose origin or id holds the keyword, in any case."""
    held: Column = F.contains(F.lower("origin"), F.lit(keyword.lower())) | F.contains(F.lower("batch_id"), F.lit(keyword.lower()))
    return log.filter(held if direction is None else held & (F.col("direction") == direction))


def frozen(log: DataFrame, columns: list[str]) -> DataFrame:
    """What a batch was loaded with, as JSON, so that a replay ignores later edits."""
    return log.select("batch_id", F.to_json(F.struct(*sorted(columns))).alias("frozen"))
