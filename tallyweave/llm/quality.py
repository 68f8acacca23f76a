"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Terms of a text are its words, in lower case, and pairs of them, hashed; the shapes of its words (runs of
letters, capitals, digits and each mark) alone and in pairs; and whether a word is new, seen before in the
text, or equal to the word before it. Square roots of term shares, weighted by inverse document frequency,
are reduced by a truncated SVD that is fitted on a bounded sample of labelled rows; words and shapes have
the same length before it, so neither outweighs the other. That sample's vectors are broadcast: at most
``SAMPLE`` rows a class times ``RANK`` floats, whatever the corpus holds. Every document meets all of them in
exact blocked cosine products; the labels of its ``NEIGHBOURS`` nearest, and of all as near as the last of
these (to six decimals), are weighted by similarity, and by the share of their class among all labelled rows
over that in the sample.

Null, empty and white-space texts have no terms and get the share of label 1. Without labelled rows every
score is 0.5. Very long texts are read whole. Null labels and null ids teach nothing; of repeated labels of
an id the largest counts, and of repeated rows of an id one teaches (the one whose term shares are the
smallest bytes). Repeated rows are scored each, and an empty table gives no rows. Extra columns are carried
as they are; one named like a result column gets an underscore after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import SPACE, WordHash, give_back, splitmix, text_bytes, word_spans
from .names import carried, named, source

#: Labelled rows of each class that are fitted and vote, at most.
SAMPLE = 2048
#: Hashed terms: of words, pairs of words, shapes, pairs of shapes, and the repetition terms after them.
WORDS, WORD_PAIRS, SHAPES, PAIRS, EXTRA = 1024, 512, 384, 384, 4
LEXICAL = WORDS + WORD_PAIRS
TERMS = LEXICAL + SHAPES + PAIRS + EXTRA
RANK, NEIGHBOURS, SHARPNESS = 64, 25, 8
BLOCK_ROWS, CHUNK_BYTES = 256, 1 << 20

CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[97:123] = CLASSES[128:] = ord("a")
CLASSES[65:91] = ord("A")
CLASSES[48:58] = ord("0")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def term_shares(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of the share of each hashed term, a row for each text."""
    n = len(at) - 1
    out = np.zeros((n, TERMS), np.float32)
    starts, ends, first = word_spans(data, at)
    if not len(starts):
        return out
    doc = np.repeat(np.arange(n), np.diff(first))
    words, low = WordHash(11).spans(data, starts, ends), WordHash(13).spans(LOWER[data], starts, ends)
    kinds = CLASSES[data]
    keep = ~SPACE[data]
    keep[1:] &= kinds[1:] != kinds[:-1]
    keep[starts] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    shapes = WordHash(12).spans(kinds[keep], upto[starts], upto[ends])
    follows = np.flatnonzero(doc[1:] == doc[:-1])
    pairs, word_pairs = (splitmix(x[follows] * np.uint64(31) + x[follows + 1]) for x in (shapes, low))
    twin = words[follows] == words[follows + 1]
    order = np.lexsort((words, doc))
    seen = np.zeros(len(words), bool)
    seen[1:] = (words[order][1:] == words[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    cells = [
        doc * TERMS + (low % np.uint64(WORDS)).astype(np.int64),
        doc[follows] * TERMS + WORDS + (word_pairs % np.uint64(WORD_PAIRS)).astype(np.int64),
        doc * TERMS + LEXICAL + (shapes % np.uint64(SHAPES)).astype(np.int64),
        doc[follows] * TERMS + LEXICAL + SHAPES + (pairs % np.uint64(PAIRS)).astype(np.int64),
        doc[follows] * TERMS + LEXICAL + SHAPES + PAIRS + twin,
        doc[order] * TERMS + LEXICAL + SHAPES + PAIRS + 2 + seen,
    ]
    counts = np.bincount(np.concatenate(cells), minlength=n * TERMS).reshape(n, TERMS)
    return np.sqrt(counts / np.maximum(1, np.diff(first))[:, None]).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def sparse(row: np.ndarray) -> bytes:
    """The terms of one text that are not zero, and their shares."""
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes()


def dense(raw: bytes) -> np.ndarray:
    n, out = len(raw) // 6, np.zeros(TERMS, np.float32)
    out[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return out


def blocks(shares: np.ndarray | list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Some rows after the others, with the place of the first."""
    for i in range(0, len(shares), BLOCK_ROWS):
        some = shares[i : i + BLOCK_ROWS]
        yield i, some if isinstance(some, np.ndarray) else np.array([dense(r) for r in some])


class Voters:
    """The fitted space and the labelled vectors in it."""

    def __init__(self, shares: np.ndarray | list[bytes], labels: np.ndarray, class_sizes: dict[int, int]) -> None:
        """``shares`` as an array, or as ``sparse`` rows: then one dense table of them is held at a time, and none beside the eigenvectors' work."""
        total = sum(class_sizes.values())
        self.prior = class_sizes.get(1, 0) / total if total else 0.5
        self.idf = np.log((1 + len(shares)) / (1 + sum(((x > 0).sum(axis=0) for _, x in blocks(shares)), np.zeros(TERMS, np.int64)))).astype(np.float32) + 0.1
        self.axes = self.fitted(shares)
        self.labels = labels.astype(np.float32)
        self.vectors = unit(self.all_weighted(shares) @ self.axes).astype(np.float32)
        taken = np.bincount(labels, minlength=2)
        self.weights = np.array([class_sizes.get(int(y), 0) / taken[y] for y in labels], np.float32)

    def fitted(self, shares: np.ndarray | list[bytes]) -> np.ndarray:
        x = self.all_weighted(shares)
        products = x.T @ x
        del x
        values, vectors = np.linalg.eigh(products)
        return vectors[:, np.argsort(-values)[:RANK]].astype(np.float32)

    def all_weighted(self, shares: np.ndarray | list[bytes]) -> np.ndarray:
        out = np.empty((len(shares), TERMS), np.float32)
        for i, x in blocks(shares):
            out[i : i + len(x)] = self.weighted(x)
        return out

    def weighted(self, shares: np.ndarray) -> np.ndarray:
        """Shares times inverse document frequency, the words and the shapes of a text of one length each."""
        x = shares * self.idf
        return np.hstack([unit(x[:, :LEXICAL]), unit(x[:, LEXICAL:])])

    def scores(self, shares: np.ndarray) -> np.ndarray:
        out = np.full(len(shares), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(shares) if k else 0, BLOCK_ROWS):
            block = shares[i : i + BLOCK_ROWS]
            near = np.round(unit(self.weighted(block) @ self.axes) @ self.vectors.T, 6)
            last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            at, of = np.nonzero(near >= last[:, None])
            votes = np.clip(near[at, of], 0, 1).astype(np.float64) ** SHARPNESS * self.weights[of]
            total = np.bincount(at, votes, len(block))
            ok = block.any(axis=1) & (total > 0)
            out[i : i + len(block)][ok] = np.clip(np.bincount(at, votes * self.labels[of], len(block))[ok] / total[ok], 0, 1)
        return out


def fit(docs: DataFrame, labels: DataFrame, teaches: str, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Voters:
    """Fits on labelled rows where the SQL condition ``teaches`` on their ``doc_id`` holds."""
    known = labels.select(named(doc_id).cast("long").alias("doc_id"), named(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(teaches).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]))  # 2 * SAMPLE pairs of numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = term_shares(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([sparse(s) for s in shares], pa.binary())], ["label", "doc_id", "shares"])

    taught = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text")).join(sample, "doc_id").select("label", "text", "doc_id")
    # A row for each id: at most SAMPLE of a class, however often an id is repeated.
    each = taught.mapInArrow(run, "label int, doc_id long, shares binary").groupBy("label", "doc_id").agg(F.min("shares").alias("shares"))
    rows = each.orderBy("label", "shares").collect()
    voters = Voters([r.shares for r in rows], np.array([r.label for r in rows], np.int64), sizes)
    give_back()
    return voters


def score(docs: DataFrame, voters: Voters, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all by default), ``score`` and ``predicted`` for each row."""
    held = carried(docs, carry, ["score", "predicted"])
    inner = held.inner
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    schema = T.StructType([*docs.select(*held.columns).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, at = text_bytes(batch.column(batch.num_columns - 1))
            scores, i = np.empty(batch.num_rows), 0
            while i < batch.num_rows:
                j = min(batch.num_rows, i + BLOCK_ROWS, max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1))
                scores[i:j] = model.scores(term_shares(data[at[i] : at[j]], at[i : j + 1] - at[i]))
                i = j
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*inner, "score", "predicted"])
        give_back()

    return docs.select(*held.columns, source(docs, text).cast("string").alias("text_read")).mapInArrow(run, schema).toDF(*held.names, "score", "predicted")
