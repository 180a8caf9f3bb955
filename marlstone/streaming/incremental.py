"""Files that keep coming land once each."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE, BATCH = "_marlstone_file", "_marlstone_batch"
PREFIX, LEDGER = 2, "file_hash string, batch string, prefix string"


def _digests(batch: DataFrame, columns: list[str]) -> DataFrame:
    """file and file_hash of each input file: its row count and sums of row hashes, so that a file of any size is hashed where it is read.

    The order of rows within a file doesn't count; how often each occurs does.
    """
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    part = lambda at: F.sum(F.conv(F.substring("row", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = F.concat_ws(" ", F.count("*").cast("string"), *map(part, (1, 16, 31, 46)))
    return batch.select(FILE, row.alias("row")).groupBy(FILE).agg(F.sha2(sums, 256).alias("file_hash"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LEDGER)


def _enter(digests: DataFrame, path: str) -> None:
    """Adds (file_hash, batch) to the ledger, a folder for each beginning of a digest."""
    digests.withColumn("prefix", F.left("file_hash", F.lit(PREFIX))).hint("rebalance", "prefix").write.mode("append").partitionBy("prefix").parquet(path)


def incremental_landing(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> DataFrame:
    """Drains new Parquet files of a folder into target, keyed by content, and returns what has landed, with each row's file_hash.

    A file seen again, under whatever name, adds nothing. A new file lands with
    every row, also rows that repeat within it or are in other files.  A batch is a
    partition of the target, named by the stream and its number, so one that is
    tried again after a failure replaces what it had written.  An empty folder gives an empty result.

    What has landed is known from a ledger of digests in the target, in 256 buckets by their beginnings: a batch reads the
    buckets of its own files' digests, and no row of the target.  The ledger is written after the rows; entries of the batch
    itself don't count, so that one tried again lands again.  A target from before there was a ledger is read once, to make it.
    """
    columns, ledger = schema.fieldNames(), f"{target.rstrip('/')}/_ledger"
    stream = spark.readStream.schema(schema).parquet(source).select("*", F.col("_metadata.file_path").alias(FILE))
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    if _exists(spark, target) and not _exists(spark, ledger):
        _enter(spark.read.parquet(target).select("file_hash", F.col(BATCH).alias("batch")).distinct(), ledger)

    def land(batch: DataFrame, number: int) -> None:
        session, name = batch.sparkSession, f"{own}-{number}"
        aside = f"{target.rstrip('/')}/_arrived/{name}"  # the digests of the batch's files, worked out once
        _digests(batch, columns).groupBy("file_hash").agg(F.min(FILE).alias(FILE)).write.mode("overwrite").parquet(aside)
        arrived = session.read.parquet(aside)
        buckets = [r.prefix for r in arrived.select(F.left("file_hash", F.lit(PREFIX)).alias("prefix")).distinct().collect()]  # 256 at most
        before = _ledger(session, ledger).filter(F.col("prefix").isin(buckets) & (F.col("batch") != name))
        new = arrived.join(before, "file_hash", "left_anti")
        landed = batch.join(new, FILE).select(*columns, "file_hash", F.lit(name).alias(BATCH))
        landed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(target)
        _enter(new.select("file_hash", F.lit(name).alias("batch")), ledger)
        where = session._jvm.org.apache.hadoop.fs.Path(aside)
        where.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    whole = StructType([*schema.fields]).add("file_hash", "string")
    return spark.read.schema(whole).parquet(target).select(*whole.fieldNames()) if _exists(spark, target) else spark.createDataFrame([], whole)
