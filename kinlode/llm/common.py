"""Shared pieces of the corpus operators: reading tables, lineage cuts in the shared folder, row keys."""

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset and the
    session has no other machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _fallback.setdefault(spark.sparkContext.applicationId, "")
        if not base:
            base = _fallback[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="kinlode-")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back. A lost executor costs a re-read, not a re-run."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a materialised table that no later step reads."""
    delete(df.sparkSession, df._scratch)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps; it acts on what the JVM has found to be garbage."""
    gc.collect()
    spark._jvm.System.gc()


@atexit.register
def _clean() -> None:
    import shutil

    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session is gone: nothing left to ask
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    for path in _fallback.values():
        shutil.rmtree(path, ignore_errors=True)


def whole(text: str | Column = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def content_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key by content: rows with one id and one text get one key, other rows get others. Unlike a row number it is the
    same whenever a task is run again."""
    return F.xxhash64(F.col(id_col), whole(text_col))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
