"""Sharding by a hypergeometric communication matrix.

The law is ``rows``: shard sizes differ by one at most. Rows are taken by partition of a written table. How
many rows of each partition go to each shard is drawn exactly, from the multivariate hypergeometric law:
the counts that a uniform shuffle of all rows would give. Then each partition is permuted locally and cut
by its counts, rows are exchanged, and each shard is permuted again. All orders and counts depend on the
seed only, so a rerun of any task gives the same rows.

The matrix is drawn on the driver: a row of ``shards`` numbers for each partition, not each document. A
shard is permuted by random keys: ranges of keys with some ten thousand rows are ranked alone and placed
by a prefix sum over their counts, so no task holds a whole shard. Counts are drawn for any number of rows.

An empty table gives no rows. Very long texts are rows like others. Null texts have one byte of size (no
text plus 1) and the CRC-32 of nothing. Null and repeated ids are rows like others. Equal texts are dealt
apart like any rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SHARDS, SEED = 8, 42
RANGE_ROWS = 20_000
#: Standard deviations on either side of the mode within which a count is drawn: the rest is below 1e-30.
REACH = 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows out of ``good + bad`` are good, for numbers of any size.

    The law's ratios of neighbouring values are summed outwards from its mode, as far as ``REACH`` standard
    deviations, where less is left than a double can tell; one uniform number is looked up in their sums.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = (drawn + 1) * (good + 1) // (total + 2)
    spread = math.sqrt(drawn * (good / total) * (bad / total) * max(0.0, (total - drawn) / max(1, total - 1)))
    reach = int(REACH * spread) + 40
    low, high = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(low, high, dtype=np.float64)  # of each value to the next
    steps = np.log(good - x) + np.log(drawn - x) - np.log(x + 1) - np.log(float(bad - drawn + 1) + x)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], "right").clip(0, len(sums) - 1))


def communication_matrix(rows: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """How many of each partition's ``rows`` each shard gets, drawn so that shard sizes are exact."""
    rng, total = np.random.default_rng(seed), int(rows.sum())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(rows), shards), np.int64)
    for i, n in enumerate(rows.tolist()):
        left, rest = n, sum(room)
        for s in range(shards):  # the number for a shard, given those for the shards before it
            rest -= room[s]
            out[i, s] = hypergeometric(rng, room[s], rest, left) if left else 0
            left -= int(out[i, s])
        room = [r - int(x) for r, x in zip(room, out[i], strict=True)]
    return out


def shuffle_to_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` for each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("uid"))
    slim = scratch.save(slim, "rows")
    counts = slim.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a number for each partition
    matrix = communication_matrix(np.array([r.n for r in counts], np.int64), shards, seed)
    cuts = spark.createDataFrame([(r.part, row) for r, row in zip(counts, np.cumsum(matrix, axis=1).tolist(), strict=True)], "part int, cuts array<long>")

    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "uid"), "uid")
    sent = slim.withColumn("place", F.row_number().over(local)).join(cuts, "part").withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("place"))).cast("int"))
    ranges = max(1, sum(r.n for r in counts) // (shards * RANGE_ROWS))
    keyed = sent.withColumn("key", F.xxhash64(F.lit(seed + 1), "uid")).withColumn("range", F.shiftright(F.shiftrightunsigned("key", 32) * F.lit(ranges), 32).cast("int"))
    keyed = scratch.save(keyed.select("doc_id", "size", "text_crc32", "uid", "shard", "range", "key"), "sent")
    order = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("shard", "range").agg(F.count("*").alias("n"))  # a row for each RANGE_ROWS rows
    first = sizes.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0))).select("shard", "range", "first")
    within = Window.partitionBy("shard", "range").orderBy(F.shiftrightunsigned("key", 1), "key", "uid")
    slots = keyed.withColumn("place", F.row_number().over(within) - 1).join(first, ["shard", "range"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
