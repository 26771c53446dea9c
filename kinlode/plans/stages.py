"""Stage tables named by what made them, so an unchanged run reads them and a changed rule makes only what follows from it."""

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable, Iterable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession


def fingerprint(**parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:20]


def code_of(modules: Iterable[ModuleType]) -> dict[str, str]:
    return {m.__name__: hashlib.sha256(inspect.getsource(m).encode()).hexdigest() for m in modules}


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def input_state(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of all files at or below the paths."""
    out = []
    for path in paths:
        store, where = _store(spark, path)
        files = store.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


class Stages:
    """The tables of one run. `source` stands for the input; without it no other run finds these tables."""

    def __init__(self, spark: SparkSession, work_dir: str, source: str | None = None):
        self.spark, self.work_dir = spark, work_dir
        self.prints = {"source": source or uuid.uuid4().hex}
        self.made: list[str] = []

    def table(self, name: str, make: Callable[[], DataFrame], after: str, code: Iterable[ModuleType], **settings) -> DataFrame:
        """The stage's table, made only where no finished one has its fingerprint. A write that was broken off has no
        success mark and is done anew."""
        self.prints[name] = own = fingerprint(name=name, after=self.prints[after], code=code_of(code), settings=settings)
        path = f"{self.work_dir}/{name}-{own}"
        store, mark = _store(self.spark, f"{path}/_SUCCESS")
        if not store.exists(mark):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.parquet(path)
