"""A store that whole batches are published into, and replay of a batch from its landed cells.

A load writes everything into folders of its own: staged rows by cell, the months it touches as they will be, their
aggregates, new names with first versions, periods.  Nothing that readers see is written over.  At the end one
record is moved into place under the next number, which fails if it is taken: that is the publication.  Readers look
up the records, so a load that fails at any step has changed nothing for them, and what it left is found again by
``orphans``.  A record names, for facts and each aggregate, the folder that holds each month, so a reader of facts reads
one record; rows of the other tables are those of published batches.

A record also freezes what the batch was read with: the declarations of its blocks and metrics as JSON, and the names it
met with their ids as a table, so a replay expands the landed cells by the same rules, whatever has changed since.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.exprs import entity_id, normalize_name
from marlstone.model import Refused
from marlstone.operators import admission, archives, loading, measures

CELL = ["file_hash", "sheet", "block", "row_no", "col_no"]
STAGED = "file_hash string, sheet string, block int, row_no long, col_no int, company string, metric string, company_id string, metric_id string, fin_month date, caliber string, amount decimal(18,2), degenerate string"
FACTS = "fin_month date, period_from date, company_id string, metric_id string, scenario string, ccy string, amount decimal(18,2), batch_id string"
NAMES = "kind string, norm string, id string"
#: Tables of rows that belong to the batch they came with.
APPENDED = {"staged": STAGED, "catalog": NAMES, "names": NAMES, "versions": "kind string, id string, name string, valid_from date, valid_to date, is_current boolean", "periods": "fin_month date, year int, month int"}
RECORD = "version long, batch_id string, spec_id string, origin string, imported_at string, n_staged long, n_facts long, replaced long, replaced_batches array<string>, blocks array<string>, metrics string, live string"
STEPS = ("stage", "facts", "aggregates", "members", "reconcile", "commit", "archive")


@dataclass(frozen=True)
class Loaded:
    batch_id: str
    version: int
    n_staged: int
    n_facts: int
    replaced: int
    archived: bool


class Store:
    """Tables under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Files.
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _has(self, *parts: str) -> bool:
        return self._files().exists(self._path(*parts))

    def _published(self) -> int:
        """The number of the last record, 0 without any."""
        if not self._has("records"):
            return 0
        names = [f.getPath().getName() for f in self._files().listStatus(self._path("records"))]
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)

    def head(self) -> dict:
        """The last record; of an empty store one without months."""
        version = self._published()
        if not version:
            return {"version": 0, "live": {}}
        source = self._files().open(self._path("records", f"{version:010d}.json"))
        try:
            record = json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()
        return record | {"live": json.loads(record["live"])}

    def _publish(self, record: dict) -> None:
        """Moves a record into its place, or refuses if another load was faster."""
        jvm, aside = self.spark._jvm, self._path("records", f".{uuid.uuid4().hex}")
        out = self._files().create(aside, True)
        out.write(bytearray(json.dumps(record, ensure_ascii=False).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # a taken place is not written over
        try:
            context.rename(context.makeQualified(aside), context.makeQualified(self._path("records", f"{record['version']:010d}.json")), never)
        except Exception as e:
            self._files().delete(aside, False)
            if self._published() >= record["version"]:
                raise Refused("STORE_CHANGED", record["batch_id"]) from e
            raise

    # Readers.
    def log(self) -> DataFrame:
        """A row for each published batch."""
        return self.spark.read.schema(RECORD).json(f"{self.root}/records/*.json") if self._published() else self.spark.createDataFrame([], RECORD)

    def appended(self, table: str, batch_id: str | None = None) -> DataFrame:
        """Rows of published batches, or of one, with batch_id. A batch is a folder, so only its own is read."""
        shape = f"{APPENDED[table]}, batch_id string"
        if not self._has(table):
            return self.spark.createDataFrame([], shape)
        rows = self.spark.read.schema(shape).parquet(f"{self.root}/{table}")
        rows = rows if batch_id is None else rows.filter(F.col("batch_id") == batch_id)
        return rows.join(self.log().select("batch_id"), "batch_id", "left_semi").select(*rows.columns)

    def _live(self, table: str, schema: str, months: dict[str, str]) -> DataFrame:
        if not months:
            return self.spark.createDataFrame([], schema)
        at = f"{self.root}/{table}"
        return self.spark.read.option("basePath", at).schema(schema + ", at string").parquet(*[f"{at}/at={b}/fin_month={m}" for m, b in sorted(months.items())]).drop("at")

    def facts(self) -> DataFrame:
        return self._live("facts", FACTS, self.head()["live"].get("facts", {}))

    def aggregate(self, name: str) -> DataFrame:
        record = self.head()["live"]
        return self._live(name, record["shapes"][name], record[name]) if name in record else self.spark.createDataFrame([], "fin_month date, amount decimal(18,2)")

    def orphans(self) -> list[str]:
        """Folders of batches that were never published; no reader looks at them."""
        known = {r["batch_id"] for r in self.log().select("batch_id").collect()}  # an id for each batch
        tables = [f.getPath().getName() for f in self._files().listStatus(self._path())] if self._has() else []
        found = []
        for t in sorted(set(tables) - {"records", "archive"}):
            for f in self._files().listStatus(self._path(t)):
                name = f.getPath().getName()
                if name.startswith(("batch_id=", "at=")) and name.partition("=")[2] not in known:
                    found.append(f"{t}/{name}")
        return found

    # Writers, into the folders of one batch.
    def write(self, df: DataFrame, table: str, batch_id: str) -> DataFrame:
        path = f"{self.root}/{table}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_months(self, df: DataFrame, table: str, batch_id: str) -> DataFrame:
        path = f"{self.root}/{table}/at={batch_id}"
        df.hint("rebalance", "fin_month").write.mode("overwrite").partitionBy("fin_month").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _rows(cells: DataFrame, blocks: list[admission.SheetSpec]) -> DataFrame:
    """All blocks' rows with the number of their block."""
    out = None
    for i, spec in enumerate(blocks):
        extra = [F.col(n) for n in ("scenario", "ccy") if n in spec.degenerate or n in spec.constants]
        part = admission.expanded(cells, spec).withColumn("block", F.lit(i)).select(*CELL, "company", "metric", "fin_month", "caliber", "amount", "degenerate", *extra)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for n in ("scenario", "ccy"):
        out = out if n in out.columns else out.withColumn(n, F.lit(None).cast("string"))
    return out


def _named(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows with company_id and metric_id. catalog (kind, norm, id): one id for each kind and norm."""
    for kind in ("company", "metric"):
        known = catalog.filter(F.col("kind") == kind).select(F.col("norm").alias(f"{kind}_norm"), F.col("id").alias(f"{kind}_id"))
        rows = rows.withColumn(f"{kind}_norm", normalize_name(F.col(kind))).join(known, f"{kind}_norm", "left").drop(f"{kind}_norm")
    return rows


def _resolved(store: Store, rows: DataFrame, names: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """kind, raw, norm, id and action of every name of a batch. Decisions (kind, raw, action merge or create, target) win over what is known; registered names over given ones."""
    spark = store.spark
    met = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("raw")) for k in ("company", "metric")])).alias("x")).select("x.*").distinct()
    met = met.withColumn("norm", normalize_name(F.col("raw")))
    every = names.select("kind", "norm", "id", F.lit(1).alias("order")).unionByName(store.appended("names").select("kind", "norm", "id", F.lit(0).alias("order")))
    known = every.groupBy("kind", "norm").agg(F.min_by("id", F.struct("order", "id")).alias("known"))
    decided = decisions if decisions is not None else spark.createDataFrame([], "kind string, raw string, action string, target string")
    made = met.join(known, ["kind", "norm"], "left").join(decided.select("kind", "raw", "action", "target"), ["kind", "raw"], "left")
    new = F.when(F.col("kind") == "company", entity_id(F.col("raw"), "c_")).otherwise(entity_id(F.col("raw"), "m_"))
    found = F.when(F.col("action") == "merge", F.col("target")).when(F.col("action") == "create", new).otherwise(F.col("known"))
    return made.select("kind", "raw", "norm", found.alias("id"), "action")


def load(
    store: Store, cells: DataFrame, blocks: list[admission.SheetSpec], names: DataFrame, *, spec_id: str, origin: str = "", decisions: DataFrame | None = None,
    metrics: Iterable[tuple[str, str, bool]] = (), aggregates: dict[str, tuple[str, ...]] | None = None, on_conflict: str = "reject",
    batch_id: str | None = None, imported_at: str | None = None, before: Callable[[str], None] = lambda step: None,
) -> Loaded:
    """Publishes a batch of landed cells, all of it or nothing.

    names (kind, norm, id) are known; metrics (metric_id, fact, derived) are declared; aggregates: grains by name, which hold fin_month.
    before is called ahead of each of STEPS.  A batch without an id gets one; an id that is published is refused, one that failed is tried again.
    """
    spark, head = store.spark, store.head()
    batch_id, imported_at = batch_id or f"b_{uuid.uuid4().hex[:12]}", imported_at or datetime.now(UTC).isoformat(timespec="seconds")
    if not store.log().filter(F.col("batch_id") == batch_id).isEmpty():
        raise Refused("BATCH_ALREADY_LOADED", batch_id)
    metrics = sorted(metrics)
    definitions = spark.createDataFrame(metrics, "metric_id string, fact string, derived boolean") if metrics else None
    for spec in blocks:
        admission.accepted(cells, spec, definitions)

    before("stage")
    rows = store.write(_rows(cells, blocks), "expanded", batch_id)  # the cells are read once
    resolved = store.write(_resolved(store, rows, names, decisions), "resolved", batch_id)  # a row for each name
    spelled = F.struct("kind", "norm")
    told = resolved.agg(F.count_if(F.col("id").isNull()).alias("open"), F.count_if(F.col("action") == "merge").alias("merged"), (F.count_distinct(spelled) - F.count_distinct(F.struct(spelled, "id"))).alias("apart")).first()
    if told["open"]:
        raise Refused("DECISION_NEEDED", ", ".join(str(r["raw"]) for r in resolved.filter("id IS NULL").select("raw").orderBy("raw").limit(20).collect()))
    if told["apart"]:
        raise Refused("NAME_AMBIGUOUS", batch_id)  # two spellings of one name were decided differently
    if told["merged"]:
        there = names.select("kind", "id").unionByName(store.appended("names").select("kind", "id")).unionByName(resolved.filter("action = 'create'").select("kind", "id"))
        if lost := resolved.filter("action = 'merge'").join(there, ["kind", "id"], "left_anti").select("id").limit(1).collect():
            raise Refused("DECISION_TARGET_UNKNOWN", lost[0]["id"])
    catalog = store.write(resolved.select("kind", "norm", "id").distinct(), "catalog", batch_id)
    counted = Observation()
    shown = [*CELL, "company", "metric", "company_id", "metric_id", "fin_month", "caliber", "amount", "degenerate", "scenario", "ccy"]
    staged = store.write(_named(rows, catalog).select(*shown).observe(counted, F.count("*").alias("n")), "staged", batch_id)

    before("facts")
    merged = store.write(admission.windowed(staged).withColumn("batch_id", F.lit(batch_id)), "coordinates", batch_id)
    known = merged.groupBy("fin_month").agg(F.bool_or("conflict").alias("conflict"), F.count("*").alias("n")).collect()  # months
    if any(r["conflict"] for r in known):
        raise Refused("COORDINATE_CONFLICT")
    one, touched, n_facts = merged.drop("conflict"), [r["fin_month"] for r in known], sum(r["n"] for r in known)
    near = store.facts().filter(F.col("fin_month").isin(touched))
    met = loading.collisions(near, one).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("batch_id")).alias("of")).first()  # an id for each batch
    replaced, old = met["n"], met["of"]
    if replaced and on_conflict == "reject":
        raise Refused("CONFLICT_WITH_EXISTING", f"{replaced} rows")
    facts = store.write_months(loading.months_with(near, one, ("batch_id",)), "facts", batch_id)

    before("aggregates")
    live = {k: dict(v) for k, v in head["live"].items()}
    months = {str(m): batch_id for m in touched}
    live["facts"] = live.get("facts", {}) | months
    for name, grain in (aggregates or {}).items():
        made = measures.aggregated(facts, grain)
        store.write_months(made, name, batch_id)
        live[name] = live.get(name, {}) | months
        live["shapes"] = live.get("shapes", {}) | {name: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)}

    before("members")
    first = min(r[0] for r in staged.agg(F.min("fin_month")).collect())
    store.write(resolved.filter("action IS NOT NULL").select("kind", "norm", "id"), "names", batch_id)
    created = resolved.filter("action = 'create'").groupBy("kind", "id").agg(F.min("raw").alias("name"))
    store.write(created.select("kind", "id", "name", F.lit(first).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(True).alias("is_current")), "versions", batch_id)
    new = one.select("fin_month").distinct().join(store.appended("periods").select("fin_month"), "fin_month", "left_anti")
    store.write(new.select("fin_month", F.year("fin_month").alias("year"), F.month("fin_month").alias("month")), "periods", batch_id)

    before("reconcile")
    n_staged = counted.get["n"]
    for what, found, want in (("staged", staged.count(), n_staged), ("facts", facts.filter(F.col("batch_id") == batch_id).count(), n_facts)):
        if found != want:
            raise Refused("LOAD_INCOMPLETE", f"{what}: {found} of {want}")

    before("commit")
    store._publish({
        "version": head["version"] + 1, "batch_id": batch_id, "spec_id": spec_id, "origin": origin, "imported_at": imported_at, "n_staged": n_staged, "n_facts": n_facts, "replaced": replaced, "replaced_batches": old,
        "blocks": [spec.to_json() for spec in blocks], "metrics": json.dumps(metrics), "live": json.dumps(live, sort_keys=True),
    })

    archived = True
    try:
        before("archive")
        archives.archive(one, f"{store.root}/archive")
    except Exception:  # what is published stays so; the archive can be written again from the facts
        archived = False
    for aside in ("expanded", "resolved", "coordinates"):
        store._files().delete(store._path(aside, f"batch_id={batch_id}"), True)
    return Loaded(batch_id, head["version"] + 1, n_staged, n_facts, replaced, archived)


def reconciled(store: Store) -> DataFrame:
    """batch_id, n_staged, n_facts, replaced (of its facts, by later batches), and what is stored of each; states tell whether they agree."""
    count = lambda df, name: df.groupBy("batch_id").agg(F.count("*").alias(name))
    held = store.log().select("batch_id", "n_staged", "n_facts").join(count(store.appended("staged"), "staged_rows"), "batch_id", "left").join(count(store.facts(), "fact_rows"), "batch_id", "left")
    held = held.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("staged_rows", "fact_rows")})
    state = F.when(F.col("staged_rows") != F.col("n_staged"), "staging differs").when(F.col("fact_rows") == F.col("n_facts"), "whole").when(F.col("fact_rows") < F.col("n_facts"), "replaced in part").otherwise("facts differ")
    return held.withColumn("state", state)


def replay(store: Store, cells: DataFrame, spec_id: str | None = None, batch_id: str | None = None, blocks: list[admission.SheetSpec] | None = None) -> DataFrame:
    """Cells (CELL) whose row, expanded again from landed cells by the frozen rules and names, is missing in the staging, extra there, or differs, and in what.

    Of a batch, or of the latest one of a spec.  blocks: other rules than the frozen ones, to see what they would change.
    """
    log = store.log().filter(F.col("batch_id") == batch_id if batch_id else F.col("spec_id") == spec_id)
    record = log.orderBy(F.desc("version")).limit(1).collect()
    if not record:
        raise Refused("SPEC_NOT_INGESTED", str(batch_id or spec_id))
    frozen, metrics = [admission.SheetSpec.from_json(b) for b in record[0]["blocks"]], json.loads(record[0]["metrics"])
    definitions = store.spark.createDataFrame([tuple(m) for m in metrics], "metric_id string, fact string, derived boolean") if metrics else None
    for spec in blocks or frozen:
        admission.accepted(cells, spec, definitions)
    again = _named(_rows(cells, blocks or frozen), store.appended("catalog", record[0]["batch_id"]))
    fields = ["company", "metric", "company_id", "metric_id", "fin_month", "caliber", "amount", "degenerate"]
    return loading.replay_diff(again, store.appended("staged", record[0]["batch_id"]), CELL, fields)
