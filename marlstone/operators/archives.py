"""Archives of batches: a folder for each batch; small files are merged by choice, verified, and only then deleted.

Every file holds ``batch_id`` as a column, so a merged file may hold many batches. Folders are called ``batch=<id>``, those of merged files
``batch=compacted-<name>``; no batch is called so.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.model import Refused
from marlstone.operators.loading import reconciled

MERGED, ASIDE, SOURCES = "compacted-", "_compacting-", "sources"
SMALL, TARGET = 128 * 1024, 128 * 1024 * 1024


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _unfinished(spark: SparkSession, path: str) -> list[str]:
    fs, at = _files(spark, path)
    return [str(f.getPath().toString()) for f in fs.listStatus(at(path)) if f.getPath().getName().startswith(ASIDE)] if fs.exists(at(path)) else []


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("batch_id").agg(F.count("*").alias(name))


def archive(batch: DataFrame, path: str) -> int:
    """Writes a batch under its id, and checks the count that can be read back. Archived again, a batch replaces itself, unless its files were merged with others'."""
    spark, expected = batch.sparkSession, _counts(batch, "n_expected")
    fs, at = _files(spark, path)
    stored = spark.read.schema(batch.select("batch_id").schema.add("batch", "string"))
    if fs.exists(at(path)) and not stored.parquet(path).filter(F.col("batch").startswith(MERGED)).join(expected, "batch_id", "left_semi").isEmpty():
        raise Refused("ARCHIVE_SEALED", path)
    batch.withColumn("batch", F.col("batch_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    back = stored.parquet(path).join(expected.select("batch_id"), "batch_id", "left_semi")
    if not reconciled(back, expected).isEmpty():
        raise Refused("ARCHIVE_INCOMPLETE", path)
    return back.count()


def read_archive(spark: SparkSession, path: str, batch_id: str | None = None) -> DataFrame:
    """The archived rows, of one batch or all. With a batch only its own folder and those of merged files are listed; in these, row groups are skipped by statistics."""
    fs, at = _files(spark, path)
    if any(fs.exists(at(f"{a}/{SOURCES}")) for a in _unfinished(spark, path)):
        raise Refused("ARCHIVE_BUSY", path)  # merged files and their sources may both be there; finish() completes it
    rows = spark.read.option("mergeSchema", True).parquet(path)
    if batch_id is not None:
        folder = F.col("batch").cast("string")
        rows = rows.filter((folder == batch_id) | folder.startswith(MERGED)).filter(F.col("batch_id") == batch_id)
    return rows.drop("batch")


def compaction_plan(spark: SparkSession, path: str, max_bytes: int = SMALL, min_files: int = 2) -> DataFrame:
    """(file, bytes, n_rows, action) of every file: ``merge``, or why it stays: ``large``, ``empty``, or ``few`` where fewer than min_files could be merged.

    Sizes come from the listing. Large files are not opened, and of small ones no column is read: their rows are counted by their footers.
    """
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    files = parts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    small = spark.read.parquet(path).filter(F.col("_metadata.file_size") < max_bytes)
    rows = small.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_rows"))
    fit = rows.agg((F.count("*") >= min_files).alias("enough"))  # one row
    action = F.when(F.col("bytes") >= max_bytes, "large").when(F.col("n_rows").isNull(), "empty").when(F.col("enough"), "merge").otherwise("few")
    known = files.join(rows, "file", "left").crossJoin(F.broadcast(fit))
    return known.select("file", "bytes", F.when(F.col("bytes") < max_bytes, F.coalesce("n_rows", F.lit(0))).alias("n_rows"), action.alias("action"))


def _packed(spark: SparkSession, files: list[str], target_bytes: int) -> DataFrame:
    """The rows of the files, so many of them to a task as make up the target size. Nothing is shuffled: the scan itself packs them."""
    own = spark.newSession()
    for key, value in (("maxPartitionBytes", target_bytes), ("openCostInBytes", 0), ("minPartitionNum", 1)):
        own.conf.set(f"spark.sql.files.{key}", value)
    return own.read.option("mergeSchema", True).parquet(*files)


def finish(spark: SparkSession, path: str) -> None:
    """Completes a compaction that was verified, and drops what an unverified one left. For one writer at a time."""
    fs, at = _files(spark, path)
    for aside in _unfinished(spark, path):
        if fs.exists(at(f"{aside}/{SOURCES}")):
            name = aside.rpartition(ASIDE)[2]
            if fs.exists(at(f"{aside}/rows")):
                fs.rename(at(f"{aside}/rows"), at(f"{path}/batch={MERGED}{name}"))
            for row in spark.read.text(f"{aside}/{SOURCES}").collect():
                source = at(row["value"])
                fs.delete(source, False)
                if not any(f.getPath().getName()[0] not in "_." for f in fs.listStatus(source.getParent())):
                    fs.delete(source.getParent(), True)
        fs.delete(at(aside), True)


def compact(spark: SparkSession, path: str, max_bytes: int = SMALL, min_files: int = 2, target_bytes: int = TARGET, dry_run: bool = False) -> DataFrame:
    """Merges an archive's small files into files of the target size, and returns the plan that it followed, as it was before; a dry run only returns it.

    The merged files are written aside, where readers don't see them, and read back: if a batch's count differs (``ARCHIVE_INCOMPLETE``), they go
    and every source stays. Then one file that lists the sources is moved into place. From there on the compaction is only completed, by
    itself or, after a failure, by finish(); readers are refused in between (``ARCHIVE_BUSY``). The list of files is as long as
    the one that Spark's own listing holds.
    """
    finish(spark, path)
    followed = compaction_plan(spark, path, max_bytes, min_files).collect()
    plan = spark.createDataFrame(followed, "file string, bytes long, n_rows long, action string")
    chosen = [unquote(r.file) for r in followed if r.action == "merge"]
    if dry_run or not chosen:
        return plan
    fs, at = _files(spark, path)
    aside = f"{path.rstrip('/')}/{ASIDE}{uuid.uuid4().hex}"
    _packed(spark, chosen, target_bytes).write.parquet(f"{aside}/rows")
    expected = _counts(spark.read.option("mergeSchema", True).parquet(*chosen), "n_expected")
    if not reconciled(spark.read.parquet(f"{aside}/rows"), expected).isEmpty():
        fs.delete(at(aside), True)
        raise Refused("ARCHIVE_INCOMPLETE", path)
    out = fs.create(at(f"{aside}/writing"), True)
    out.write(bytearray("\n".join(chosen).encode()))
    out.close()
    fs.rename(at(f"{aside}/writing"), at(f"{aside}/{SOURCES}"))
    finish(spark, path)
    return plan
