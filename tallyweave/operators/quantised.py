"""A stored vector index of short codes: lists of an inverted file, residual product quantisation, exact re-ranking.

A vector belongs to the list of its nearest centroid; what is left of it is cut into ``PIECES`` equal pieces, and each
piece is named by the nearest of ``WORDS`` entries of its codebook, so a code takes a byte a piece. A search reads the
codes of the lists it looks into, adds up one table lookup a piece, and reads whole vectors only of the lists that hold
its best ``RERANK`` times k codes; these are compared exactly. Lists are folders, so others are not read.

Centroids, codebooks and the number of lists to look into are fitted on ``SAMPLE`` rows of the least id hashes; every
row is coded. That number is the least that holds ``REACHED`` of the sample's own ten nearest: few where vectors form
clusters, many where they don't. ``ann.recall`` measures a search against the exact one.

Vectors that are null, of another length than the first of the sample, or that hold null or non-finite parts are left
out. Ties go to the smaller id; rows that repeat an id are kept as they are; an empty table makes an empty index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from . import retrieval

SAMPLE, LISTS, ROUNDS = 20_000, 4096, 12
PIECES, WORDS = 16, 256
#: Codes looked at exactly for each wanted neighbour, and the share of a sample's neighbours that probed lists must hold.
RERANK, REACHED, TRIED = 20, 0.95, 256
#: Rows of a list, and queries that ask a list, up to which one task takes them.
SLICE, ASKED = 50_000, 20_000
#: Rows that are compared at once in a task.
BLOCK = 1024


@dataclass(frozen=True)
class Model:
    size: int  # length of vectors
    centres: np.ndarray  # lists, size
    books: np.ndarray  # pieces, words, padded size / pieces
    probes: int


def padded(x: np.ndarray, pieces: int) -> np.ndarray:
    """Rows cut into pieces of equal length, filled up with zeros."""
    width = -(-x.shape[1] // pieces)
    return np.pad(x, ((0, 0), (0, width * pieces - x.shape[1]))).reshape(len(x), pieces, width)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less each row's own square: the same order."""
    return (centres * centres).sum(axis=1) - 2 * x @ centres.T


def owner(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + BLOCK], centres).argmin(axis=1) for i in range(0, len(x), BLOCK)] or [np.zeros(0, int)])


def closest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    return np.argsort(distances(x, centres), axis=1, kind="stable")[:, :k]


def means(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of the rows by k-means; one that no row is near to stays where it was."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        own = owner(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=k)[:, None]
        np.add.at(sums, own, x)
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def usable(vector: Column, size: int | None = None) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(vector) == size if size is not None else F.size(vector) > 0), F.lit(False))


def needed_probes(x: np.ndarray, centres: np.ndarray, own: np.ndarray, k: int = 10) -> int:
    """The fewest nearest lists of a row that hold ``REACHED`` of its k nearest among the sample, over ``TRIED`` rows."""
    asked = x[np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(int)]
    best = np.argpartition(-(asked @ x.T), min(k, len(x)) - 1, axis=1)[:, : min(k, len(x))]
    place = np.empty((len(asked), len(centres)), int)
    np.put_along_axis(place, closest(asked, centres, len(centres)), np.arange(len(centres))[None, :], axis=1)
    return int(np.quantile(np.take_along_axis(place, own[best], axis=1), REACHED, method="higher")) + 1


def fit(vectors: DataFrame, lists: int | None = None, pieces: int = PIECES) -> Model:
    """Centroids (as many as the root of the number of rows, ``LISTS`` at most), codebooks and probes, from the sample."""
    v = F.col("vector").cast("array<double>")
    rows = vectors.select("id", v.alias("v")).where(usable(F.col("v"))).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    if not rows:
        return Model(0, np.zeros((0, 1)), np.zeros((pieces, 0, 1)), 0)
    size = len(rows[0].v)
    x = np.array([r.v for r in rows if len(r.v) == size], float)
    wanted = max(1, min(lists or round(vectors.count() ** 0.5), LISTS, len(x)))
    centres = means(x, wanted)
    own = owner(x, centres)
    left = padded(x - centres[own], pieces)
    books = np.stack([means(np.ascontiguousarray(left[:, j]), max(1, min(WORDS, len(x) // 4))) for j in range(pieces)])
    return Model(size, centres, books, needed_probes(x, centres, own))


def coded(vectors: DataFrame, model: Model) -> DataFrame:
    """``id``, ``list``, ``code``, ``vector`` of each vector that the index takes."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # LISTS vectors and WORDS a piece at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m.size)
                own = owner(x, m.centres)
                left = padded(x - m.centres[own], len(m.books))
                code = np.stack([owner(np.ascontiguousarray(left[:, j]), book) for j, book in enumerate(m.books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), part.column(1)], ["id", "list", "code", "vector"])

    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector"), model.size))
    return rows.mapInArrow(run, "id long, list int, code binary, vector array<double>")


def probed(queries: DataFrame, model: Model, probes: int) -> DataFrame:
    """``query_id``, ``v``, ``list``: a row for each list that a query looks into."""
    shared = queries.sparkSession.sparkContext.broadcast(model.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                near = closest(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), shared.value, probes)
                for j in range(0, part.num_rows, max(1, BLOCK // near.shape[1])):  # a row is repeated for each list
                    some = near[j : j + max(1, BLOCK // near.shape[1])]
                    at = pa.array(np.repeat(np.arange(j, j + len(some)), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(some.reshape(-1).astype(np.int32))], ["query_id", "v", "list"])

    return queries.mapInArrow(run, "query_id long, v array<double>, list int")


def code_tile(shared, depth: int):
    """The ``depth`` codes of a list's slice that lie nearest to each query, by tables of inner products."""

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        m, out = shared.value, []
        if queries.num_rows and rows.num_rows:
            own = rows.sort_by("id")
            ids, at = own.column("id").to_numpy(), own.column("list")[0].as_py()
            codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            for i in range(0, queries.num_rows, 64):
                part = queries.slice(i, 64)
                q = np.stack([np.asarray(v, float) for v in part.column("v").to_numpy(zero_copy_only=False)])
                tables = np.einsum("qpw,pkw->pqk", padded(q, len(m.books)), m.books)
                score = np.repeat((q @ m.centres[at])[:, None], len(ids), axis=1)
                for piece, table in enumerate(tables):
                    score += table[:, codes[:, piece]]
                for number, s in zip(part.column("query_id").to_pylist(), score, strict=True):
                    near = np.flatnonzero(s >= np.partition(s, -depth)[-depth]) if len(s) > depth else np.arange(len(s))
                    near = near[np.argsort(-s[near], kind="stable")][:depth]  # rows are in order of ids
                    out.append(pa.table({"query_id": pa.array(np.full(len(near), number), pa.int64()), "id": pa.array(ids[near], pa.int64()), "list": pa.array(np.full(len(near), at, np.int32)), "score": pa.array(s[near])}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "list": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})

    return run


class QuantisedIndex:
    def __init__(self, spark: SparkSession, path: str, model: Model) -> None:
        self.spark, self.path, self.model = spark, path, model

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, pieces: int = PIECES) -> QuantisedIndex:
        """Fits on a sample, codes every row, and writes both; the model comes last and makes the index readable."""
        spark, model = vectors.sparkSession, fit(vectors, lists, pieces)
        index = cls(spark, path, model)
        index.append(vectors, "overwrite")
        flat = [(kind, i, [float(x) for x in row]) for kind, part in (("centre", model.centres), ("word", model.books.reshape(-1, model.books.shape[2]))) for i, row in enumerate(part)]
        spark.createDataFrame(flat, "kind string, at int, row array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        store.delete(spark, f"{path}/index.json")
        store.create_text(spark, f"{path}/index.json", json.dumps({"size": model.size, "pieces": len(model.books), "probes": model.probes}))
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> QuantisedIndex:
        held = json.loads(store.read_text(spark, f"{path}/index.json"))
        rows = spark.read.schema("kind string, at int, row array<double>").parquet(f"{path}/model").orderBy("at").collect()  # LISTS and WORDS a piece at most
        part = lambda kind: np.array([r.row for r in rows if r.kind == kind], float)
        if not held["size"]:
            return cls(spark, path, Model(0, np.zeros((0, 1)), np.zeros((held["pieces"], 0, 1)), 0))
        words = part("word")
        return cls(spark, path, Model(held["size"], part("centre"), words.reshape(held["pieces"], -1, words.shape[1]), held["probes"]))

    def append(self, vectors: DataFrame, mode: str = "append") -> None:
        """Codes rows with the fitted model and adds them to their lists. Long lists are written by several tasks."""
        if not self.model.size:
            return
        work = store.Work(self.spark, "codes")
        rows = work.save(coded(vectors, self.model), "rows")
        slices = rows.groupBy("list").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))  # a row for each list
        dealt = rows.join(F.broadcast(slices), "list").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))
        dealt.repartition("list", "slice").select("id", "code", "vector", "list").write.mode(mode).option("compression", "zstd").partitionBy("list").parquet(f"{self.path}/rows")
        work.delete()

    def rows(self, asked: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the lists that ``asked`` names (``LISTS`` at most): folders of others are not read."""
        rows = self.spark.read.schema("id long, code binary, vector array<double>, list int").parquet(f"{self.path}/rows")
        return rows if asked is None else rows.where(F.col("list").isin(sorted(r[0] for r in asked.select("list").distinct().collect())))

    def candidates(self, queries: DataFrame, depth: int, probes: int | None = None) -> DataFrame:
        """``query_id``, ``id``, ``list``, ``score``, ``rank`` of the ``depth`` best codes of each query (``query_id``, ``v``)."""
        asked = store.Work(self.spark, "probes").save(probed(queries, self.model, max(1, min(probes or self.model.probes, len(self.model.centres)))), "asked")
        parts = asked.groupBy("list").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
        rows = self.rows(parts)
        sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
        deal = F.broadcast(parts.join(sizes, "list"))  # a row for each list
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(deal, "list").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).withColumn("slice", every("slices")).select("query_id", "v", "list", "part", "slice")
        right = rows.join(deal, "list").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).withColumn("part", every("parts")).select("id", "code", "list", "part", "slice")
        keys, shared = ("list", "part", "slice"), self.spark.sparkContext.broadcast(self.model)
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(code_tile(shared, depth), "query_id long, id long, list int, score double")
        return retrieval.top(found, depth)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
        """``query_id``, ``id``, ``score``, ``rank`` of the k largest inner products found with each query (``query_id``, ``vector``)."""
        if not self.model.size:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        work = store.Work(self.spark, "quantised")
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("v")).where(usable(F.col("v"), self.model.size))
        asked = work.save(asked, "queries")
        near = work.save(self.candidates(asked, k * rerank, probes).select("query_id", "id", "list"), "near")
        pairs = self.rows(near).select("list", "id", "vector").join(store.few(near), ["list", "id"]).join(asked, "query_id")
        score = F.aggregate(F.zip_with("v", "vector", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return retrieval.top(pairs.select("query_id", "id", score.alias("score")), k)
