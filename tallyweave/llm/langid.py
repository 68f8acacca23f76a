"""Language ID by language-bitmask n-gram filters.

Learning counts byte n-grams of letters over a bounded sample of labelled texts of each language and keeps
each language's most frequent ones. They go into one bit-sliced Bloom filter: a slot is a word with a bit
for each language, so the AND of an n-gram's slots names all languages that contain it in one look-up.
Each language's popcount over a text's n-grams is corrected by its filter's false-positive rate, and the
highest corrected share decides. Longer n-grams weigh more; ties go to the language with more sampled rows.

The sample has one id, the one of the least hash, of each of ``SAMPLE`` parts of a language's ids, so it is
an aggregate that each task begins on its own rows, and no task ranks a language.

A null text, or one without a letter, is ``und`` with score 0. Null languages and ids teach nothing; without
any labelled row all is ``und``. Each 64 languages have a filter of their own. Very long texts are read whole,
repeated rows are judged each, an empty table gives no rows. Extra columns are carried as they are; one named
like a result column gets an underscore after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import splitmix
from .names import carried, named, source

#: Labelled ids of a language that are learned, at most, and languages of a filter.
SAMPLE, LANGUAGES = 2000, 64
#: Bytes of an n-gram, and what a hit of that size counts.
SIZES = {3: 1.0, 4: 1.5, 5: 2.0}
#: N-grams of a language that are kept, seen this often at least.
KEPT, SEEN = 20_000, 3
SLOTS, HASHES = 1 << 20, 3
CHUNK_BYTES = 1 << 20
LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def letters_only(text: str) -> bytes:
    """Lower-case words of letters, a space around each; empty if there is no letter."""
    words = text.lower().encode("utf-8", "replace").translate(LETTERS).split()
    line = b" " + b" ".join(words) + b" " if words else b""
    return line if line.isascii() or any(map(str.isalpha, text)) else b""


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The n-gram that starts at each byte, as a number that is its own for each size."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out <<= np.uint64(8)
        out |= data[k : k + n]
    return out


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets) of some MB at a time."""
    at, i = np.cumsum([0, *map(len, texts)]), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
        yield i, j, np.frombuffer(b"".join(texts[i:j]), np.uint8), at[i : j + 1] - at[i]
        i = j


class MaskFilter:
    """A bit-sliced Bloom filter from n-grams to sets of languages."""

    def __init__(self, names: list[str], kept: dict[str, np.ndarray]) -> None:
        self.names = names
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= len(names))
        self.slots = np.zeros(SLOTS, kind)
        for bit, name in enumerate(names):
            for slot in self.places(kept[name]):
                self.slots[slot] |= kind(1 << bit)
        self.false = np.array([((self.slots >> kind(bit)) & kind(1)).mean() ** HASHES for bit in range(len(names))])

    def places(self, numbers: np.ndarray) -> Iterator[np.ndarray]:
        mixed = splitmix(numbers)
        for k in range(HASHES):
            yield (mixed >> np.uint64(21 * k)) & np.uint64(SLOTS - 1)

    def masks(self, numbers: np.ndarray) -> np.ndarray:
        found = None
        for slot in self.places(numbers):
            found = self.slots[slot] if found is None else found & self.slots[slot]
        return found

    def shares(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Corrected share of each text's n-grams in each language."""
        n, out, weight = len(at) - 1, np.zeros((len(at) - 1, len(self.names))), np.zeros(len(at) - 1)
        for size, factor in SIZES.items():
            masks = self.masks(grams(data, size))
            ends = np.maximum(at[1:] - size + 1, at[:-1])
            count = ends - at[:-1]
            for bit in range(len(self.names)):
                sums = np.concatenate([[0], np.cumsum((masks >> masks.dtype.type(bit)) & masks.dtype.type(1), dtype=np.int64)])
                sums = np.append(sums, np.full(max(0, len(data) + 1 - len(sums)), sums[-1]))
                out[:, bit] += factor * np.maximum(0, (sums[ends] - sums[at[:-1]] - count * self.false[bit]) / (1 - self.false[bit]))
            weight += factor * count
        return out / np.maximum(weight, 1)[:, None] if n else out


class MaskFilters:
    """Filters of ``LANGUAGES`` languages each, asked as one."""

    def __init__(self, names: list[str], kept: dict[str, np.ndarray]) -> None:
        self.names = names
        self.filters = [MaskFilter(names[i : i + LANGUAGES], kept) for i in range(0, len(names), LANGUAGES)]

    def shares(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.hstack([f.shares(data, at) for f in self.filters])


def fit(docs: DataFrame, teaches: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> MaskFilters | None:
    """Learns from rows with a language where the SQL condition ``teaches`` on ``doc_id`` holds."""
    rows = docs.select(named(doc_id).cast("long").alias("doc_id"), named(lang).alias("lang"), named(text).cast("string").alias("text")).where("doc_id is not null and lang is not null").where(teaches)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(SAMPLE))
    first = F.min(F.struct(F.xxhash64("doc_id").alias("hash"), F.col("doc_id").alias("doc_id")))
    sample = rows.groupBy("lang", part.alias("part")).agg(first.alias("first")).select("lang", "first.doc_id")
    sizes = {r.lang: r["count"] for r in sample.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not sizes:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(letters_only(value or ""))
            for name, texts in by.items():
                for _, _, data, _ in chunks(texts):
                    for size in SIZES:
                        number, count = np.unique(grams(data, size), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(number)), pa.array([size] * len(number), pa.int32()), pa.array(number.view(np.int64)), pa.array(count)], ["lang", "size", "gram", "n"])

    taught = rows.join(F.broadcast(sample), ["doc_id", "lang"])  # SAMPLE ids of a language at most
    counts = taught.select("lang", "text").mapInArrow(run, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN)
    top = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    kept = counts.withColumn("place", F.row_number().over(top)).where(F.col("place") <= KEPT).groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()  # KEPT numbers for each language and size at most
    return MaskFilters(list(sizes), {n: np.zeros(0, np.uint64) for n in sizes} | {r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in kept})


def identify(docs: DataFrame, model: MaskFilters | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all by default), ``lang_pred`` and ``score`` for each row."""
    held = carried(docs, carry, ["lang_pred", "score"])
    inner = held.inner
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.select(*held.columns).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            lines = [letters_only(x or "") for x in batch.column(batch.num_columns - 1).to_pylist()]
            names, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for i, j, data, at in chunks(lines) if judge else ():
                shares = judge.shares(data, at)
                some = np.diff(at) > 0
                names[i:j][some] = np.array(judge.names, object)[shares.argmax(axis=1)[some]]
                scores[i:j] = np.where(some, shares.max(axis=1) / np.maximum(shares.sum(axis=1), 1e-9), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], [*inner, "lang_pred", "score"])

    return docs.select(*held.columns, source(docs, text).cast("string").alias("text_read")).mapInArrow(run, schema).toDF(*held.names, "lang_pred", "score")
