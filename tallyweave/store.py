"""Tables that the engine writes: under the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast, and bytes of what they hold.
FEW_ROWS, FEW_BYTES = 200_000, 128 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Work:
    """Tables of one run, under a folder of its own that goes with the driver. A written table cuts the lineage."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/tallyweave/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.delete)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def delete(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may have gone before
            files, path = file_system(self.spark, self.root)
            files.delete(path, True)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it takes it: any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = file_system(spark, path)
    return files.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; of one that isn't there, none."""
    files, at = file_system(spark, path)
    return [status.getPath().getName() for status in files.listStatus(at)] if files.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a text."""
    files, at = file_system(spark, path)
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, body: str) -> bool:
    """Writes a small file where none is of that name; whether it did."""
    files, at = file_system(spark, path)
    try:
        stream = files.create(at, False)
    except Py4JJavaError:
        if files.exists(at):
            return False
        raise
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()
    return True


def delete(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.delete(at, True)


def bytes_in(spark: SparkSession, path: str) -> int:
    files, at = file_system(spark, path)
    return files.getContentSummary(at).getLength()


def content_mark(spark: SparkSession, path: str) -> str:
    """Lengths and times of the files under a path: another mark, another content."""
    files, at = file_system(spark, path)
    out, todo = [], [at]
    while todo:
        for status in files.listStatus(todo.pop()):
            if status.isDirectory():
                todo.append(status.getPath())
            else:
                out.append(f"{status.getPath().getName()}:{status.getLen()}:{status.getModificationTime()}")
    return "|".join(sorted(out))


def held_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds: texts as they are, nested columns as JSON, numbers as eight."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("array", "map", "struct"):
            column = F.to_json(F.struct(column))
        fixed = kind not in ("array", "map", "struct", "string", "binary", "char", "varchar")
        size = size + (F.lit(8) if fixed else F.coalesce(F.octet_length(column), F.lit(0)))
    return size


def is_few(df: DataFrame, most: int = FEW_ROWS, most_bytes: int = FEW_BYTES) -> bool:
    """Whether a table is small enough to be sent to every task, by rows and by bytes; no more than ``most`` rows are looked at."""
    rows, held = df.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(held_bytes(df)), F.lit(0))).first()
    return rows <= most and held <= most_bytes


def few(df: DataFrame, most: int = FEW_ROWS, most_bytes: int = FEW_BYTES) -> DataFrame:
    """The table, to be broadcast if it is counted to have ``most`` rows and ``most_bytes`` bytes at most."""
    return F.broadcast(df) if is_few(df, most, most_bytes) else df


def dealt(df: DataFrame) -> DataFrame:
    """The table as a side of a join that shuffles: Spark would send it by the driver to every task where its files look small, and small files can hold much."""
    return df.hint("merge")
