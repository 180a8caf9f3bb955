"""What the operators need from the session: tables, shared files and code on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: dict[str, bool] = {}
#: Bytes of an Arrow batch on its way to a Python worker: long documents make a batch of many rows large.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that tasks can import it, and bounds Arrow batches where the session doesn't."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    if _shipped.get(sc.applicationId):
        return
    target = Path(tempfile.mkdtemp(prefix="marlstone-code-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    _shipped[sc.applicationId] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor reaches, from spark.checkpoint.dir; where it is unset, as in tests, a temporary one, but only if there is one machine."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="marlstone-shared-")
        sc.setCheckpointDir(configured)
    return configured


#: Paths of what is stashed and not yet released, oldest first.
_stashed: list[str] = []


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again.

    The files outlive lost executors and go when they are released, or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _file_system(spark, path)
    files.deleteOnExit(where)
    _stashed.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def mark() -> int:
    """A point in time, for release."""
    return len(_stashed)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes what was stashed since a mark, but for ``keep``. Only for stashes whose consumers have been written."""
    kept = {getattr(df, "stash_path", None) for df in keep}
    for path in [p for p in _stashed[since:] if p not in kept]:
        where, files = _file_system(spark, path)
        files.delete(where, True)
        _stashed.remove(path)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names: other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
