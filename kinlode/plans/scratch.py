"""Tables that a query writes down and reads back, in the folder that driver and executors share."""

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and the session has no other machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="kinlode-")
    return _own[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """df from a file of its own; the shuffle files of the steps before it can go, and no later step makes it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    gc.collect()
    spark._jvm.System.gc()  # Spark's cleaner deletes the shuffle files of what the JVM has found to be garbage
    return out


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone: nothing left to ask
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    for path in _own.values():
        shutil.rmtree(path, ignore_errors=True)
