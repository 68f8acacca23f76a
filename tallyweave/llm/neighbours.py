"""Exact nearest neighbours by a block matrix join over int8 tiles.

Every vector is quantised to int8 with a scale of its own, and the length of what the rounding left is
kept. For a tile of queries and candidates the products of the int8 codes give all distances between
quantised vectors; the true distance differs by at most the two lengths. A candidate whose lower bound is
above the k-th best upper bound of a query can't be among its nearest. Surviving pairs are recomputed in
double precision and pushed through a heap of k for each query and task; the tasks' heaps are merged by a
ranking over at most k rows of each.

Queries are a stated set that meets all rows. Both sides are dealt to groups of at most ``TILE_GROUP``
vectors and ``TILE_BYTES`` of components on average, and each pair of groups is a tile of a grid, which one task joins: no side is collected
or broadcast, and a vector is sent once for each group of the other side. Within a tile codes meet in blocks.

Vectors that are null, zero, or hold a null or non-finite component, and rows without an id, take no part;
a query meets only vectors of its own dimension. Components may have any finite size: where a bound can't be
told in doubles the pair survives, and where squares leave their range the distance is computed from scaled
differences. Ties go to the smaller id. Repeated rows are candidates of their own, and a repeated query row
finds its other copies. An empty table gives no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .names import named
from .scratch import Scratch

NEAREST = 10
TILE_GROUP, TILE_BYTES, TILE_ROWS, TILE_QUERIES = 100_000, 64 << 20, 2048, 256
#: float32 adds products of int8 exactly up to this many components.
EXACT_DIMENSIONS = 1024
#: Pairs whose distances are recomputed at once.
PAIRS_AT_ONCE = 1 << 16
#: Below this a distance's squares may have left the range of doubles.
SMALL = 1e-140
FOUND = "query long, query_id long, vec_id long, score double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, squared length of the scaled codes, length of what rounding left."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(np.float64).tiny)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, (near * near).sum(axis=1), np.linalg.norm(x - near, axis=1) * (1 + 1e-9) + 1e-12


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT_DIMENSIONS):
        out += a[:, i : i + EXACT_DIMENSIONS].astype(np.float32) @ b[:, i : i + EXACT_DIMENSIONS].astype(np.float32).T
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of x to the same row of y, squares added in order."""
    d = x - y
    out = np.sqrt(np.cumsum(d * d, axis=1)[:, -1])
    odd = np.flatnonzero(~((out >= SMALL) & (out < np.inf)))
    if len(odd):
        most = np.abs(d[odd]).max(axis=1)
        scaled = d[odd] / np.where((most > 0) & (most < np.inf), most, 1)[:, None]
        out[odd] = np.where(most < np.inf, most * np.sqrt(np.cumsum(scaled * scaled, axis=1)[:, -1]), np.inf)
    return out


class Nearest:
    """The k nearest candidates so far of each of a slice of queries of one dimension."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.numbers, self.ids, self.vectors, self.k = numbers, ids, vectors, k
        self.codes, self.scale, self.square, self.error = quantise(vectors)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]  # of (-distance, -id): the worst on top
        self.worst = np.full(len(ids), np.inf)

    def meet(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        codes, scale, square, error = quantise(vectors)
        for q in range(0, len(self.ids), TILE_QUERIES):
            own = slice(q, q + TILE_QUERIES)
            product = int8_products(self.codes[own], codes) * self.scale[own, None] * scale
            near = np.sqrt(np.maximum(self.square[own, None] + square - 2 * product, 0))
            slack = self.error[own, None] + error + 1e-7 * (1 + near)
            itself = self.numbers[own, None] == numbers
            upper = near + slack
            upper[itself | np.isnan(upper)] = np.inf
            bound = self.worst[own]
            if len(ids) > self.k:
                bound = np.minimum(bound, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
            at, of = np.nonzero(~(near - slack > bound[:, None]) & ~itself)
            self.push(at + q, of, ids, vectors)

    def push(self, at: np.ndarray, of: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(at):
            return
        score = np.concatenate([distances(self.vectors[at[i : i + PAIRS_AT_ONCE]], vectors[of[i : i + PAIRS_AT_ONCE]]) for i in range(0, len(at), PAIRS_AT_ONCE)])
        order = np.lexsort((ids[of], score, at))
        at, of, score = at[order], of[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        keep = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) < self.k
        for q, i, s in zip(at[keep].tolist(), ids[of[keep]].tolist(), score[keep].tolist(), strict=True):
            heap, new = self.heaps[q], (-s, -i)
            if len(heap) < self.k:
                heapq.heappush(heap, new)
            elif new > heap[0]:
                heapq.heapreplace(heap, new)
        for q in np.unique(at).tolist():
            if len(self.heaps[q]) == self.k:
                self.worst[q] = -self.heaps[q][0][0]

    def rows(self) -> Iterator[tuple[int, int, int, float]]:
        for number, own, heap in zip(self.numbers.tolist(), self.ids.tolist(), self.heaps, strict=True):
            for s, i in heap:
                yield number, own, -i, -s


def by_dimension(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, numbers, ids, vectors) of the table's rows, at most ``TILE_ROWS`` at a time."""
    for batch in table.select(["number", "vec_id", "v"]).to_batches(max_chunksize=TILE_ROWS):
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        for n in np.unique(sizes).tolist():
            some = batch.filter(pa.array(sizes == n))
            yield n, some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2).flatten().to_numpy().reshape(-1, n)


def tile(k: int):
    def run(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        parts: dict[int, list] = {}
        for n, *some in by_dimension(queries):
            parts.setdefault(n, []).append(some)
        with np.errstate(over="ignore", invalid="ignore"):
            state = {n: Nearest(*(np.concatenate(x) for x in zip(*some, strict=True)), k) for n, some in parts.items()}
            for n, numbers, ids, vectors in by_dimension(candidates):
                if n in state:
                    state[n].meet(numbers, ids, vectors)
        cols = list(zip(*(r for s in state.values() for r in s.rows()), strict=True)) or [[], [], [], []]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: str, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEAREST) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean) of the k nearest of each row where ``is_query`` holds.

    ``is_query`` is a SQL condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = vectors.select(named(vec_id).cast("long").alias("vec_id"), named(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))
    rows = scratch.save(rows.withColumn("number", F.monotonically_increasing_id()).withColumn("asks", F.expr(f"coalesce({is_query}, false)")), "vectors")
    n, asking, parts = rows.agg(F.count("*"), F.count_if("asks"), F.sum(F.size("v"))).first()
    held = max(1, min(TILE_GROUP, TILE_BYTES * n // (8 * parts))) if n else TILE_GROUP
    query_groups = max(1, -(-asking // held))
    row_groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // held))

    def grouped(df: DataFrame, own_groups: int, own_name: str, other_groups: int, other_name: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("number"), F.lit(own_groups)).cast("int").alias(own_name)
        return df.select("number", "vec_id", "v", mine).withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other_groups - 1))))

    asked = grouped(rows.where("asks"), query_groups, "qg", row_groups, "rg").groupBy("qg", "rg")
    met = grouped(rows, row_groups, "rg", query_groups, "qg").groupBy("qg", "rg")
    found = asked.cogroup(met).applyInArrow(tile(k), FOUND)
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
