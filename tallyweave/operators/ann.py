"""Approximate vector search over lists of an inverted file.

Centroids are fitted by k-means on a bounded sample (``SAMPLE`` rows of the least id hashes); every row is then put
into the list of its nearest centroid. A query looks into the ``probes`` lists whose centroids are nearest to it,
and within them exactly. Long lists are cut into slices, so no task holds more than about ``SLICE`` rows of one.
Vectors are compared by inner product, as in the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from . import retrieval

SAMPLE, LISTS, ROUNDS, SLICE = 20_000, 4096, 12, 50_000
#: Share of the lists that are looked into by default: reaches a recall of 0.9 on vectors with next to no clusters.
#: Clustered ones need far fewer; measure with ``recall``.
PROBED = 0.6


def fit(vectors: DataFrame, lists: int | None = None) -> np.ndarray:
    """Centroids, as many as the root of the number of rows, ``LISTS`` at most; none without rows."""
    rows = vectors.where("vector is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(F.col("vector").cast("array<double>").alias("v")).collect()
    x = np.array([r.v for r in rows], float)
    if not len(x):
        return np.zeros((0, 1))
    wanted = min(lists or round(vectors.count() ** 0.5), LISTS, len(x))
    centres = x[np.linspace(0, len(x) - 1, max(1, wanted)).astype(int)]
    for _ in range(ROUNDS):
        own = nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    far = (centres * centres).sum(axis=1) - 2 * x @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :k]


def listed(vectors: DataFrame, key: str, centres: np.ndarray, k: int) -> DataFrame:
    """``key``, ``v`` and ``list``: a row for each of the k nearest lists of each vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # LISTS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = np.array(part.column(1).to_pylist(), float)
                near = nearest(x, shared.value, k)
                at = np.repeat(np.arange(len(x)), near.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(near.reshape(-1).astype(np.int64))], [key, "v", "list"])

    rows = vectors.where("vector is not null").select(F.col(key).cast("long").alias(key), F.col("vector").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"{key} long, v array<double>, list long")


def topk(queries: DataFrame, vectors: DataFrame, k: int = 10, probes: int | None = None, centres: np.ndarray | None = None) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``rank`` of the nearest rows found; ``probes`` lists are looked into, the share ``PROBED`` by default."""
    work = store.Work(vectors.sparkSession, "ann")
    centres = fit(vectors) if centres is None else centres
    if not len(centres):
        return retrieval.dense_topk(queries, vectors, k).select("query_id", "id", "score", "rank")
    rows = work.save(listed(vectors, "id", centres, 1), "rows")
    slices = rows.groupBy("list").agg(F.ceil(F.count("*") / SLICE).cast("long").alias("slices"))  # a row for each list
    asked = listed(queries, "query_id", centres, probes or max(1, math.ceil(PROBED * len(centres))))
    left = asked.join(F.broadcast(slices), "list").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).select("query_id", "v", "list", "slice")
    right = rows.join(F.broadcast(slices), "list").select("id", F.col("id").alias("record"), "v", "list", F.pmod(F.xxhash64("id"), F.col("slices")).alias("slice"))
    found = left.groupBy("list", "slice").cogroup(right.groupBy("list", "slice")).applyInArrow(retrieval.dense_tile(k), "query_id long, id long, best_id long, score double")
    return retrieval.top(found, k).select("query_id", "id", "score", "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many exact hits there are, and the share of them that was found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.count("*").alias("hits"), F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 4).alias("recall"))
