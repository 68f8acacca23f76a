"""Substring dedup by level-wise doubling.

A window is ``length`` consecutive words of one document. Every word that a window covers whose word
sequence also starts anywhere else is removed. Windows are first compared at a quarter of the length;
only windows repeated there are extended to twice that length, and so on, until the full length is
reached or no candidate survives.

Plan. Documents are written once as *blocks* (some MB of text, compressed, one row each). For each level
a block sorts the hashes of its candidate windows, drops repeats of its own, and sends each bucket of
the hash space one sorted run. A bucket finds the hashes that two or more blocks sent and answers each
block with a bit per hash. So a window that occurs in a third of all documents reaches its bucket once
per block, and no group of copies is ever collected. With its hashes a block also sends which of its words
are candidates, so that the next level starts from there; where none is left anywhere, no further level
runs. The short levels compare 48-bit hashes, where a collision only keeps a candidate; the last one
compares 128 bits.

Null or empty texts have no words: nothing is removed and the kept text is empty. Repeated rows are
documents of their own, so all windows of both go. Very long texts are blocks of their own, and an empty
table gives no rows. Extra columns, whatever their names, are carried in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .bytetext import WordHash, give_back, splitmix, text_bytes, word_spans
from .names import carried, named
from .scratch import Scratch

BLOCK_BYTES = 4 << 20
BUCKET_WINDOWS = 4_000_000
RUNS = "bucket int, block long, n int, run binary"
REPLIES = "block long, bucket int, n int, bits binary"
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def levels(length: int) -> list[int]:
    """Window lengths to compare: halves of ``length`` from a quarter of it (at least 4 words) up."""
    out = [length]
    while len(out) < 3 and out[0] > 7:
        out.insert(0, (out[0] + 1) // 2)
    return out


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def to_blocks(text: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + block_bytes, "right")) - 1)
                part = batch.slice(i, j - i)
                words = int(len(word_spans(data[at[i] : at[j]], at[i : j + 1] - at[i])[0]))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([words], pa.int64()), pa.array([pack(part)], pa.binary())], ["block", "n_words", "payload"])
                number, i = number + 1, j

    return run


class Candidates:
    """The windows of one block that are still repeated at a level: all, or those among the words that the bits name."""

    def __init__(self, batch: pa.RecordBatch, text: str, steps: list[int], buckets: int, level: int = 0, bits: bytes = b"") -> None:
        self.steps, self.buckets = steps, buckets
        self.data, self.at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        self.starts, self.ends, self.first = word_spans(self.data, self.at)
        n = len(self.starts)
        self.stop = np.repeat(self.first[1:], np.diff(self.first))  # the word after the last of each word's text
        self.one = self.word_hashes(1)
        self.level, self.alive, self.prior = level, np.arange(n), np.ones(n + 1, bool)
        if level:
            self.prior = np.unpackbits(np.frombuffer(bits, np.uint8), count=n + 1).astype(bool)
            self.alive = np.flatnonzero(self.prior[:-1])
        self.enter()

    def word_hashes(self, seed: int) -> np.ndarray:
        return WordHash(seed).spans(self.data, self.starts, self.ends)

    def of(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows of this level's length that start at these words."""
        out = np.zeros(len(at), np.uint64)
        for k in range(self.steps[self.level]):
            out = out * STEP + words[at + k]
        return splitmix(out)

    def enter(self) -> None:
        k = self.steps[self.level]
        self.alive = self.alive[self.alive + k <= self.stop[self.alive]]
        if self.level:  # both halves, which overlap in an odd length, were repeated
            self.alive = self.alive[self.prior[self.alive] & self.prior[self.alive + k - self.steps[self.level - 1]]]
        last = self.level == len(self.steps) - 1
        one = self.of(self.one, self.alive)
        two = self.of(self.word_hashes(2), self.alive) if last and len(self.alive) else np.zeros(len(one), np.uint64)
        if not last:
            one >>= np.uint64(16)
        self.order = np.lexsort((two, one)) if last else np.argsort(one, kind="stable")
        one, two = one[self.order], two[self.order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.group = np.cumsum(new) - 1
        self.keys, self.second, self.wide = one[new], two[new], last
        self.own = np.bincount(self.group, minlength=len(self.keys)) > 1
        top = self.keys >> np.uint64(32 if last else 16)
        self.cuts = np.searchsorted((top * np.uint64(self.buckets)) >> np.uint64(32), np.arange(self.buckets + 1, dtype=np.uint64))

    def runs(self) -> Iterator[tuple[int, int, bytes]]:
        for b in np.flatnonzero(np.diff(self.cuts)):
            i, j = self.cuts[b], self.cuts[b + 1]
            planes = self.keys[i:j].view(np.uint8).reshape(-1, 8)[:, : 8 if self.wide else 6].T.tobytes()
            yield int(b), int(j - i), planes + (self.second[i:j].tobytes() if self.wide else b"")

    def leave(self, replies: dict[int, bytes]) -> np.ndarray:
        """Takes the answers for this level: which of all words start a repeated window."""
        again = self.own.copy()
        for b, bits in replies.items():
            i, j = self.cuts[b], self.cuts[b + 1]
            again[i:j] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(j - i)).astype(bool)
        self.prior = np.zeros(len(self.starts) + 1, bool)
        self.prior[self.alive[self.order[again[self.group]]]] = True
        return self.prior

    def take(self, rows: list[dict]) -> None:
        self.leave({r["bucket"]: r["bits"] for r in rows if r["bucket"] >= 0})
        self.alive = np.flatnonzero(self.prior[:-1])
        self.level += 1
        self.enter()


NO_RUNS = pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "run": pa.array([], pa.binary())})


def emit(block: int, found: Candidates) -> pa.Table:
    """A block's runs, and after the first level, under a bucket below zero, the words that it came with."""
    rows = list(found.runs())
    if found.level:
        rows.append((-1 - block % 1000, len(found.alive), np.packbits(found.prior).tobytes()))
    return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=NO_RUNS.schema)


def resumed(batch: pa.RecordBatch, text: str, steps: list[int], buckets: int, level: int, rows: list[dict]) -> Candidates:
    """A block's candidates at a level, from what it sent then."""
    return Candidates(batch, text, steps, buckets, level, next((r["bits"] for r in rows if r["bucket"] < 0), b""))


def answer(wide: bool):
    def of(key, table):
        if key[0].as_py() < 0:
            return table.select(["block", "bucket", "n", "run"]).rename_columns(["block", "bucket", "n", "bits"])
        runs, counts = table.column("run").to_pylist(), table.column("n").to_pylist()
        ones, twos = [], []
        for raw, n in zip(runs, counts, strict=True):
            width, raw = 8 if wide else 6, np.frombuffer(raw, np.uint8)
            keys = np.zeros((n, 8), np.uint8)
            keys[:, :width] = raw[: width * n].reshape(width, n).T
            ones.append(keys.reshape(-1).view(np.uint64))
            twos.append(np.frombuffer(raw[width * n :].tobytes(), np.uint64) if wide else None)
        one, cuts = np.concatenate(ones), np.cumsum([0, *counts])
        if wide:
            two = np.concatenate(twos)
            order = np.lexsort((two, one))
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            twice = np.zeros(len(one), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
        else:
            ranked = np.sort(one)
            often = ranked[1:][ranked[1:] == ranked[:-1]]
            twice = np.zeros(len(one), bool)
            if len(often):
                at = np.minimum(np.searchsorted(often, one), len(often) - 1)
                twice = often[at] == one
        hit = [k for k in range(len(runs)) if twice[cuts[k] : cuts[k + 1]].any()]
        blocks = table.column("block").to_pylist()
        return pa.table({"block": pa.array([blocks[k] for k in hit], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(hit), pa.int32()), "n": pa.array([counts[k] for k in hit], pa.int32()), "bits": pa.array([np.packbits(twice[cuts[k] : cuts[k + 1]]).tobytes() for k in hit], pa.binary())})

    return of


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 35, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (struct of the ``carry`` columns, all by default), ``n_words``, ``n_removed``, ``kept_text``.

    ``kept_text`` is the kept words joined by one space.
    """
    spark, steps = docs.sparkSession, levels(length)
    scratch = Scratch(spark, "substring_dedup")
    carry = docs.columns if carry is None else carry
    held = carried(docs, carry, [])
    taken = docs.select(*held.columns, *([] if text in carry else [named(text).alias("text_read")]))
    kept_schema = T.StructType([f for f in taken.schema.fields if f.name in held.inner])
    names = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(held.names, kept_schema.fields, strict=True)])
    text = held.inner[carry.index(text)] if text in carry else "text_read"
    blocks = scratch.save(taken.mapInArrow(to_blocks(text, block_bytes), "block long, n_words long, payload binary"), "blocks")
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_WINDOWS))
    payloads = blocks.select("block", "payload")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from emit(block, Candidates(unpack(payload.as_py()), text, steps, buckets)).to_batches()
        give_back()

    def later(level: int):
        def run(key, left, right):
            rows, tables = right.select(["bucket", "bits"]).to_pylist(), [NO_RUNS]
            for block, payload in zip(left.column("block").to_pylist(), left.column("payload"), strict=True):
                found = resumed(unpack(payload.as_py()), text, steps, buckets, level - 1, rows)
                found.take(rows)
                tables.append(emit(block, found))
                del found
            give_back()
            return pa.concat_tables(tables)

        return run

    replies, reached = None, 0
    for level in range(len(steps)):
        if replies is None:
            runs = payloads.mapInArrow(first, RUNS)
        else:
            runs = payloads.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(later(level), RUNS)
        replies, reached = scratch.save(runs.groupBy("bucket").applyInArrow(answer(level == len(steps) - 1), REPLIES), f"level{level}"), level
        scratch.drop(f"level{level - 1}")
        if level and not replies.where("bucket < 0 AND n > 0").limit(1).count():
            break  # no window of this length is a candidate anywhere

    out = T.StructType([T.StructField("row", kept_schema), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    arrow = to_arrow_schema(out)

    def last(key, left, right):
        return pa.concat_tables([finish(unpack(p.as_py()), right) for p in left.column("payload")] or [arrow.empty_table()])

    def finish(batch: pa.RecordBatch, right: pa.Table) -> pa.Table:
        rows = right.select(["bucket", "bits"]).to_pylist()
        found = resumed(batch, text, steps, buckets, reached, rows)
        again = found.leave({r["bucket"]: r["bits"] for r in rows if r["bucket"] >= 0})[:-1]
        begins = np.flatnonzero(again) if reached == len(steps) - 1 else np.zeros(0, np.int64)
        n = len(found.starts)
        edge = np.bincount(begins, minlength=n + 1) - np.bincount(begins + length, minlength=n + 1)[: n + 1]
        gone = np.cumsum(edge)[:n] > 0
        n_words, n_gone = np.diff(found.first), np.diff(np.concatenate([[0], np.cumsum(gone)])[found.first])
        raw, kept = found.data.tobytes(), []
        for k in range(batch.num_rows):
            words = raw[found.at[k] : found.at[k + 1]].split()
            if n_gone[k]:
                words = [w for w, x in zip(words, gone[found.first[k] : found.first[k + 1]].tolist(), strict=True) if not x]
            kept.append(b" ".join(words))
        fields = arrow.field("row").type
        row = pa.StructArray.from_arrays([batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in fields], fields=list(fields)) if len(fields) else pa.array([{}] * batch.num_rows, fields)
        return pa.table([row, pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=arrow)

    kept = payloads.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(last, out)
    return kept.withColumn("row", F.col("row").cast(names))
