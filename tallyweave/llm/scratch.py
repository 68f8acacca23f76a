"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset and driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Released:
    """While any table is written, shuffle files of a query are released as it ends; threads that write at once share this."""

    def __init__(self) -> None:
        self.lock, self.writers, self.before = threading.Lock(), 0, "false"

    @contextlib.contextmanager
    def during(self, spark: SparkSession):
        with self.lock:
            if not self.writers:
                self.before = spark.conf.get(CLEANUP, "false")
                spark.conf.set(CLEANUP, "true")
            self.writers += 1
        try:
            yield
        finally:
            with self.lock:
                self.writers -= 1
                if not self.writers:
                    spark.conf.set(CLEANUP, self.before)


RELEASED = Released()


class Scratch:
    """Writes DataFrames as Parquet under one run's own folder, which is deleted when the driver ends.

    A written table cuts the lineage: a lost executor costs only the step that was running. The shuffle
    files of a step are released as soon as its table is written, and ``drop`` frees tables that no result reads.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tallyweave/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.delete)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = f"{self.root}/{name}", df.schema
        with RELEASED.during(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no DataFrame in use reads."""
        for name in names:
            self.remove(f"{self.root}/{name}")

    def delete(self) -> None:
        self.remove(self.root)

    def remove(self, folder: str) -> None:
        with contextlib.suppress(Exception):  # the JVM may have gone before
            jvm, context = self.spark._jvm, self.spark._jsc
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
