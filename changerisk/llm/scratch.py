"""Tables written between jobs, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from changerisk.session import checkpoint_dir


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables of one operator run.

    ``keep`` writes a frame and reads it back, so that later jobs neither
    repeat its work nor depend on an executor that may be lost. ``drop``
    deletes one that no later job reads; what a returned frame still reads
    stays until the folder is cleared.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._root = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self._count = 0
        self._kept: set[str] = set()

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        self._count += 1
        path = f"{self._root}/{self._count}"
        # The shuffle files of a written table serve nobody any more.
        before = self._spark.conf.get(_CLEANUP, "false")
        self._spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path, compression="zstd")
        finally:
            self._spark.conf.set(_CLEANUP, before)
        self._kept.add(path)
        return self._spark.read.schema(df.schema).parquet(path), path

    def drop_all(self, *but: str) -> None:
        """Deletes the tables of this run except those in ``but``."""
        for path in self._kept - set(but):
            self.drop(path)

    def drop(self, path: str) -> None:
        self._kept.discard(path)
        target = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame) -> DataFrame:
    """The frame, written once to the shared folder and read from there."""
    return Scratch(df.sparkSession).keep(df)[0]
