"""Matching of new sources as they arrive: each micro-batch retrieves only what the ledger hasn't settled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import resume_todo


def match_stream(sources: DataFrame, match: Callable[[DataFrame], DataFrame], ledger_path: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Appends ``match(new sources)`` to the Parquet ledger; a source is settled once its latest status isn't failed.

    A batch that is run again after a failure appends nothing new: its rows carry the batch number, and
    rows of a number that the ledger has already are left out.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], f"{schema}, seq long").write.mode("append").parquet(ledger_path)
        log = spark.read.schema(f"{schema}, seq long").parquet(ledger_path)
        done = log.where(F.col("seq") == number).select("source_id")
        todo = resume_todo(batch.dropDuplicates(["source_id"]), log).join(done, "source_id", "left_anti")
        match(todo).withColumn("seq", F.lit(number).cast("long")).write.mode("append").parquet(ledger_path)

    return sources.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
