"""A pool of vectors that changes in place, as ``TextIndex`` does for terms.

Vectors are rows of a table by id, in buckets with deltas: a change writes what it puts and marks for what it takes out,
and a search answers as a pool would that had been built from what is there now. Vectors are stored at length one, so
the inner product is the cosine; zero vectors stay zero and are like nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import text as tx
from ..sources.delta import DeltaTable
from . import retrieval

#: Commits of a bucket from which on a change merges it.
DELTAS = 8


class VectorPool:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, DeltaTable(spark, path)

    def upsert(self, rows: DataFrame) -> None:
        """Takes vectors (``id``, ``vector``) in, in place of those of the same id; null vectors are left out."""
        new = rows.where("vector is not null").select(F.col("id").cast("long").alias("id"), tx.unit(F.col("vector").cast("array<double>")).alias("vector"))
        before = self.table.version()
        if before is None:
            self.table.create(new, ["id"])
        else:
            self.table.change(new, after=before)
            self.table.compact(DELTAS)

    def remove(self, ids: DataFrame) -> None:
        """Takes the vectors of these ids out; ids that aren't there change no answer."""
        if self.table.version() is not None:
            self.table.change(gone=ids.select(F.col("id").cast("long").alias("id")).distinct())
            self.table.compact(DELTAS)

    def rows(self) -> DataFrame:
        found = self.table.read()
        return found if found is not None else self.spark.createDataFrame([], "id long, vector array<double>")

    def search(self, queries: DataFrame, k: int = 10, exclude: DataFrame | None = None) -> DataFrame:
        """The k nearest of each query (``query_id``, ``vector``) by cosine, ties to the smaller id.

        With ``exclude`` (``id``, for all queries, or ``query_id`` and ``id``) the search goes as much deeper as one query leaves
        out, so that no list is shortened, and ranks are given anew.
        """
        asked = queries.select("query_id", tx.unit(F.col("vector").cast("array<double>")).alias("vector"))
        depth = k
        if exclude is not None:
            out = exclude.distinct()
            per = out.groupBy(*(["query_id"] if "query_id" in out.columns else [])).count()
            depth += per.agg(F.max("count")).first()[0] or 0
        found = retrieval.dense_topk(asked, self.rows(), depth)
        if exclude is not None:
            found = found.join(store.few(out), [c for c in ("query_id", "id") if c in out.columns], "left_anti")
        return retrieval.top(found.select("query_id", "id", "score"), k)
