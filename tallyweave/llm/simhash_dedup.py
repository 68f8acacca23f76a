"""SimHash near-dedup through a Gray-order hierarchical index.

A fingerprint bit is 1 where over half of a text's shingle hashes have it set. Fingerprints link at
``radius`` or fewer differing bits; components of links are the groups of near copies.

Plan. Equal fingerprints become one row first. Two fingerprints within ``radius`` bits agree on all bits of
at least one of the plan's blocks (of ``radius + m`` chunks, ``m`` agree), so each is dealt to the bucket of
its bits in each block. Which ``m`` is taken depends on the number of rows and changes no result.
For a Jaccard similarity (0.8 of sets of shingles) that bound is of no use; there, blocks are fixed random
bits of a longer fingerprint, as many as a stated chance to meet in one of them asks for, whatever the
corpus holds, and a link within the radius only proposes: components of such links meet whole, and pairs in
them link if their sets of shingles (told by 64-bit hashes) have the similarity. Equal sets become one row
first. What is lost are pairs whose fingerprints lie beyond the radius, and those that meet in no bucket nor
through others.

Sets of shingles are held by bytes of text, so long documents make small slices. A bucket of more than ``TILE_ROWS`` is cut into slices, and each pair of slices meets in a tile of its own.
A task holds many tiles in one index: rows in order of tile and of Gray rank, where neighbours differ in few
bits. Groups of neighbours get a node with the bits that all share and their mask, and the tiles they span.
A self-join walks pairs of nodes from the top: nodes without a common tile are pruned, and the shared bits
that differ bound the distance of all pairs below, so whole groups are pruned; where even all open bits
together stay within the radius, two groups link at once. Only links between parts that are not yet connected
are written, at most one less than a tile's fingerprints, so a group of copies never gives all its pairs.
Components come from alternating large-star and small-star rounds.

A text without words has fingerprint zero and links like any other; null texts are empty ones, very long ones
are taken whole, an empty table gives no rows. A null doc_id is kept as a row, but can't be a component's id
unless its whole component has none. Repeated rows are rows of one fingerprint; where one of each group is
kept, the least row stays. Columns other than the two named, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import give_back, splitmix, text_bytes
from .names import named
from .scratch import Scratch

FAN_OUT = 8
#: Fingerprints of one slice of a bucket, and of one task on average.
TILE_ROWS, TASK_ROWS = 20_000, 50_000
PAIRS_AT_ONCE = 1 << 13
#: Bytes of text whose sets of shingles are in one slice of a proposed component, of one task on average, and hashed at once.
SET_BYTES, TASK_BYTES, HASHED_BYTES = 12 << 20, 24 << 20, 4 << 20
#: Rows of a table of hot buckets up to which it is broadcast.
FEW_ROWS = 100_000
#: What comparing two fingerprints costs, where sending one is 1: decides between exact plans only.
COMPARE = 0.01
EDGES = "a long, b long"
MIX = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Plan:
    """What is compared: words of a shingle, 64-bit words of a fingerprint, the radius, the bits of each bucket, and the
    Jaccard similarity (numerator and denominator) that sets of shingles must have, if any."""

    shingle: int
    words: int
    radius: int
    blocks: tuple[tuple[int, ...], ...]
    similarity: tuple[int, int] | None = None


def exact_plan(rows: int, shingle: int = 4, radius: int = 4) -> Plan:
    """64 bits in ``radius + m`` chunks: by pigeonhole, ``m`` of them agree, so no pair within the radius is missed.

    Of m = 1, 2, 3 the one that costs least for so many rows: more chunks give more buckets, and smaller ones.
    """

    def blocks(m: int) -> tuple[tuple[int, ...], ...]:
        n = radius + m
        cuts = [64 * i // n for i in range(n + 1)]
        return tuple(tuple(x for c in some for x in range(cuts[c], cuts[c + 1])) for some in itertools.combinations(range(n), m))

    def cost(own: tuple[tuple[int, ...], ...]) -> float:
        return sum(1 + rows / 2 ** len(bits) / 2 * COMPARE for bits in own)

    return Plan(shingle, 1, radius, min(map(blocks, (1, 2, 3)), key=cost))


def similarity_plan(shingle: int = 5, similarity: tuple[int, int] = (4, 5), missed: float = 0.001, deviations: float = 3.5, bits: int = 13) -> Plan:
    """256 bits and the radius of a Jaccard similarity (of sets of shingles), with a margin of some deviations.

    Two sets of similarity J have a cosine of at least 2J / (1 + J), and differ in each bit with the chance of
    their angle over pi. A pair at the similarity agrees in none of the buckets, of ``bits`` each, with the chance
    ``missed``; there are as many buckets as that takes.
    """
    words = 4
    differ = math.acos(2 * similarity[0] / sum(similarity)) / math.pi
    radius = int(64 * words * differ + deviations * math.sqrt(64 * words * differ * (1 - differ)))
    blocks = math.ceil(math.log(missed) / math.log(1 - (1 - differ) ** bits))
    rng = np.random.default_rng(7)
    return Plan(shingle, words, radius, tuple(tuple(sorted(rng.choice(64 * words, bits, replace=False).tolist())) for _ in range(blocks)), similarity)


def shingles(raw: bytes, shingle: int) -> np.ndarray:
    """The XXH64 (seed 42) of each run of ``shingle`` lower-cased words, repeats included; of fewer words, of all."""
    line = b" ".join(raw.lower().split())
    if not line:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    n = max(1, len(gaps) + 2 - shingle)
    starts = [0, *(gaps[: n - 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(line)] if len(gaps) >= shingle - 1 else [len(line)]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)]), ">u8")


def simhash(hashes: np.ndarray, words: int = 1) -> bytes:
    """SimHash of shingle hashes. Words of a fingerprint after the first use a mix of the same hashes."""
    n = len(hashes)
    if not n:
        return bytes(8 * words)
    hashes = hashes.astype(">u8")
    if words > 1:
        own = hashes.astype(np.uint64)
        hashes = np.stack([own, *(splitmix(own + np.uint64(k * MIX % 2**64)) for k in range(1, words))], axis=1).astype(">u8")
    rows, ones = hashes.view(np.uint8).reshape(n, 8 * words), np.zeros(64 * words, np.int64)
    for i in range(0, n, 248):  # counts of up to 248 fit a byte
        ones += np.unpackbits(rows[i : i + 248], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n).tobytes()


def fingerprint(raw: bytes, shingle: int = 4, words: int = 1) -> bytes:
    """SimHash of the shingles of a text, repeats included."""
    return simhash(shingles(raw, shingle), words)


def fingerprints(docs: DataFrame, plan: Plan, carry: list[str], text: str = "text") -> DataFrame:
    """The ``carry`` columns and ``fp``, the fingerprint's bytes, for each row; with a similarity those of the set of
    shingles, followed by 128 bits that tell the set."""
    schema = T.StructType([*docs.select(*carry).schema.fields, T.StructField("fp", T.BinaryType())])

    def of_set(raw: bytes) -> bytes:
        own = np.unique(shingles(raw, plan.shingle).astype(np.uint64))
        return simhash(own, plan.words) + xxhash.xxh3_128_digest(own.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(batch.num_columns - 1))
            raw, at = data.tobytes(), at.tolist()
            marks = [of_set(raw[a:b]) if plan.similarity else fingerprint(raw[a:b], plan.shingle, plan.words) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, pa.binary())], [*carry, "fp"])
        give_back()

    return docs.select(*carry, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def as_codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(column), -1)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence, as words from the highest on."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    for w in range(1, codes.shape[1]):  # an odd number of ones above reflects the rest
        rank[:, w] ^= np.uint64(0) - (rank[:, w - 1] & np.uint64(1))
    return rank


def ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


class Forest:
    """Connected parts of the rows of one bucket; joins give the links that connect two parts."""

    def __init__(self, n: int) -> None:
        self.part = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.part[a], self.part[b]
            new = x != y
            a, b = a[new], b[new]
            low, high = np.minimum(x, y)[new], np.maximum(x, y)[new]
            np.minimum.at(self.part, high, low)
            while True:
                up = self.part[self.part]
                if (up == self.part).all():
                    break
                self.part = up


class GrayIndex:
    """Nodes over codes in order of tile and Gray rank: level 0 has the codes, each level above a node for ``FAN_OUT`` below.

    A node has the bits that all its codes hold, those that any holds, and its first and last tile.
    """

    def __init__(self, codes: np.ndarray, tiles: np.ndarray) -> None:
        self.codes = codes
        self.all, self.any, self.low, self.high = [codes], [codes], [tiles], [tiles]
        while len(self.all[-1]) > 1:
            cuts = np.arange(0, len(self.all[-1]), FAN_OUT)
            self.all.append(np.bitwise_and.reduceat(self.all[-1], cuts, axis=0))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], cuts, axis=0))
            self.low.append(self.low[-1][cuts])
            self.high.append(self.high[-1][np.append(cuts[1:], len(self.high[-1])) - 1])

    def gap(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewest and most bits in which a code under node a differs from one under node b."""
        pattern_a, pattern_b = self.all[level][a], self.all[level][b]
        if not level:
            exact = ones(pattern_a ^ pattern_b)
            return exact, exact
        mask = ~(pattern_a ^ self.any[level][a]) & ~(pattern_b ^ self.any[level][b])
        least = ones((pattern_a ^ pattern_b) & mask)
        return least, least + ones(~mask)

    def links(self, radius: int) -> np.ndarray:
        """The connected part of each code, where codes of one tile within ``radius`` bits are linked."""
        forest = Forest(len(self.codes))
        top = len(self.all) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        near = np.flatnonzero((ones(self.codes[1:] ^ self.codes[:-1]) <= radius) & (self.low[0][1:] == self.low[0][:-1]))
        forest.join(near, near + 1)
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS_AT_ONCE:
                stack += [(level, a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]) for i in range(0, len(a), PAIRS_AT_ONCE)]
                continue
            least, most = self.gap(level, a, b)
            meet = (self.low[level][b] <= self.high[level][a]) & (least <= radius)
            whole = meet & (most <= radius) & (self.low[level][a] == self.high[level][b])
            for x, y in ((a[whole], b[whole]), (a[whole], a[whole]), (b[whole], b[whole])):
                self.link_nodes(forest, level, x, y)
            rest = meet & ~whole
            if level and rest.any():
                a, b = a[rest], b[rest]
                apart = ~self.joined(forest, level, a, b)
                stack.append((level - 1, *self.expand(level, a[apart], b[apart])))
        return forest.part

    def link_nodes(self, forest: Forest, level: int, a: np.ndarray, b: np.ndarray) -> None:
        if not level:
            forest.join(a, b)
            return
        size = FAN_OUT**level
        for step in range(size if len(a) else 0):  # all codes of both nodes are within the radius of each other
            for node in (a, b):
                at = node * size + step
                ok = (at < len(self.codes)) & (at < (node + 1) * size)
                forest.join(a[ok] * size, at[ok])

    def joined(self, forest: Forest, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        cuts = np.arange(0, len(self.codes), FAN_OUT**level)
        low, high = np.minimum.reduceat(forest.part, cuts), np.maximum.reduceat(forest.part, cuts)
        return (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])

    def expand(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children that may have a tile in common."""
        n = len(self.all[level - 1])
        i, j = np.divmod(np.arange(FAN_OUT * FAN_OUT), FAN_OUT)
        x, y = (a * FAN_OUT)[:, None] + i, (b * FAN_OUT)[:, None] + j
        ok = (x < n) & (y < n) & (x <= y)
        x, y = x[ok], y[ok]
        ok = self.low[level - 1][y] <= self.high[level - 1][x]
        return x[ok], y[ok]


def spanning_links(codes: np.ndarray, numbers: np.ndarray, radius: int, tiles: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each fingerprint of a tile to the first one of its part, by their numbers."""
    tiles = np.zeros(len(codes), np.int64) if tiles is None else tiles
    order = np.lexsort((*gray_rank(codes).T[::-1], tiles))
    part = GrayIndex(codes[order], tiles[order]).links(radius)
    child = np.flatnonzero(part != np.arange(len(codes)))
    return numbers[order[part[child]]], numbers[order[child]]


def deal(classes: DataFrame, plan: Plan) -> DataFrame:
    """A row for each fingerprint and block: ``bucket`` (the block and its bits there), ``number``, ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                bits = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1).astype(np.int64)
                for block, own_bits in enumerate(plan.blocks):
                    value = bits[:, own_bits] @ (np.int64(1) << np.arange(len(own_bits), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array((block << 48) + value), part.column(0), part.column(1)], ["bucket", "number", "fp"])

    return classes.select("number", "fp").mapInArrow(run, "bucket long, number long, fp binary")


def cut(rows: DataFrame, sizes: DataFrame, key: str, size: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """``rows`` with ``low`` and ``high``, and the weight of all of them: groups of a ``key`` that weigh over ``size`` are cut
    into slices, and each row stands once for each pair of slices with its own. ``sizes`` has the weight ``n`` of each key;
    rows have a ``number``."""
    slices = F.ceil(F.col("n") / size)
    total = sizes.agg(F.sum(F.col("n") * slices)).first()[0] or 0
    hot = scratch.save(sizes.where(F.col("n") > size).select(key, slices.cast("int").alias("slices")), f"hot_{key}")
    many = hot.count()
    if not many:
        return rows.withColumn("low", F.lit(0)).withColumn("high", F.lit(0)), int(total)
    found = rows.join(F.broadcast(hot) if many <= FEW_ROWS else hot, key, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    found = found.withColumn("own", F.pmod(F.xxhash64("number"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return found.select(*rows.columns, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")), int(total)


def near_links(classes: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """Links ``a``, ``b`` between the numbers of distinct fingerprints that connect all those within the radius."""
    spark, dealt = classes.sparkSession, deal(classes, plan)
    tiles, rows = cut(dealt, scratch.save(dealt.groupBy("bucket").agg(F.count("*").alias("n")), "buckets"), "bucket", TILE_ROWS, scratch)
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS)
    keyed = tiles.withColumn("part", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(parts)).cast("int"))

    def run(table):
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("bucket", "low", "high")])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        tile = np.cumsum(np.concatenate([[0], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        a, b = spanning_links(as_codes(table.column("fp"))[order], table.column("number").to_numpy()[order], plan.radius, tile)
        give_back()
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return keyed.groupBy("part").applyInArrow(run, EDGES).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for each node that has a link."""
    edges, before, turn = scratch.save(links.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges0"), None, 0
    while True:
        turn += 1
        # Large star: the larger neighbours of a node are linked to its smallest neighbour.
        both = edges.union(edges.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = edges.join(least, edges.b == least.n).selectExpr("a", "m as b").where("a <> b").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        large = scratch.save(large, f"large{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, large.a == least.n).selectExpr("b as a", "m as b").where("a <> b").union(least.selectExpr("n as a", "m as b")).distinct()
        edges = scratch.save(small, f"edges{turn}")
        scratch.drop(f"edges{turn - 1}", f"large{turn}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.selectExpr("a as node", "b as root").union(edges.selectExpr("b as node", "b as root").distinct())
        before = now


def rooted_classes(marks: DataFrame, plan: Plan | None, scratch: Scratch, least: Column) -> DataFrame:
    """``fp``, ``root`` (the same for all fingerprints of a component) and ``least``, of the rows of a fingerprint."""
    classes = scratch.save(marks.groupBy("fp").agg(F.min(least).alias("least")).withColumn("number", F.monotonically_increasing_id()), "classes")
    plan = plan or exact_plan(classes.count())
    roots = components(near_links(classes, plan, scratch), scratch)
    return scratch.save(classes.join(roots, classes.number == roots.node, "left").select("fp", "least", F.coalesce("root", "number").alias("root")), "rooted")


def set_links(codes: np.ndarray, sets: list[np.ndarray], plan: Plan) -> np.ndarray:
    """The connected part of each set, where sets within the radius that have the similarity are linked."""
    num, den = plan.similarity
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    codes, size, at = codes[order], size[order], np.concatenate([[0], np.cumsum(size[order])])
    ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    flag, part = np.zeros(int(ids.max(initial=0)) + 1, bool), np.arange(len(sets))
    for i in range(len(sets)):
        end = int(np.searchsorted(size, size[i] * den // num, "right"))  # larger ones can't have the similarity
        near = i + 1 + np.flatnonzero((part[i + 1 : end] != part[i]) & (ones(codes[i + 1 : end] ^ codes[i]) <= plan.radius))
        if not len(near):
            continue
        flag[ids[at[i] : at[i + 1]]] = True
        common = np.array([np.count_nonzero(flag[ids[at[j] : at[j + 1]]]) for j in near])
        flag[ids[at[i] : at[i + 1]]] = False
        for j in near[common * (num + den) >= num * (size[i] + size[near])]:
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
    out = np.empty(len(sets), np.int64)
    out[order] = order[part]
    return out


def verified_links(texts: DataFrame, proposed: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """Links ``a``, ``b`` that connect all pairs of the similarity within each root of ``proposed`` (``key``, ``number``,
    ``size`` (bytes of its text), ``fp``, ``root``), whose texts are those of ``texts`` (``key``, ``text``). Large roots are cut into slices that meet in tiles."""
    spark = texts.sparkSession
    hashed = T.StructType([T.StructField(n, t) for n, t in (("root", T.LongType()), ("number", T.LongType()), ("fp", T.BinaryType()), ("hashes", T.BinaryType()))])

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            data, at = text_bytes(batch.column(3))
            first = []
            for k, number in enumerate(batch.column(1).to_pylist()):  # rows of one id and text: one stays
                if number not in seen:
                    seen.add(number)
                    first.append(k)
            i, upto = 0, np.concatenate([[0], np.cumsum([at[k + 1] - at[k] for k in first])])
            while i < len(first):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + HASHED_BYTES, "right")) - 1)
                some, i = first[i:j], j
                sets = [np.unique(shingles(data[at[k] : at[k + 1]].tobytes(), plan.shingle).astype(np.uint64)).tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some, pa.int64())) for c in range(3)), pa.array(sets, pa.binary())], hashed.names)
        give_back()

    rows = texts.join(proposed, "key").select("root", "number", "fp", F.col("text").cast("string").alias("text")).mapInArrow(hash_texts, hashed)
    sizes = scratch.save(proposed.groupBy("root").agg(F.sum("size").alias("n")), "sizes")
    rows, weight = cut(rows, sizes, "root", SET_BYTES, scratch)
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-weight // TASK_BYTES))
    keyed = rows.withColumn("part", F.pmod(F.xxhash64("root", "low", "high"), F.lit(parts)).cast("int"))

    def run(table):
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("root", "low", "high", "number")])
        codes, order = as_codes(table.column("fp")), np.lexsort(keys[::-1])
        raw, at = text_bytes(table.column("hashes"))
        keys = keys[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        order, keys = order[new], keys[:, new]
        a, b = [], []
        for own in np.split(np.arange(len(order)), np.flatnonzero((keys[:3, 1:] != keys[:3, :-1]).any(axis=0)) + 1):
            part = set_links(codes[order[own]], [raw[at[k] : at[k + 1]].view(np.uint64) for k in order[own]], plan)
            child = np.flatnonzero(part != np.arange(len(own)))
            a.append(keys[3, own[child]])
            b.append(keys[3, own[part[child]]])
        a, b = np.concatenate(a), np.concatenate(b)
        give_back()
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return keyed.groupBy("part").applyInArrow(run, EDGES).distinct()


def alike_classes(texts: DataFrame, marks: DataFrame, plan: Plan, scratch: Scratch, least: Column) -> DataFrame:
    """``root`` and ``least`` as in ``rooted_classes``, where components are of pairs whose sets have the plan's similarity."""
    classes = marks.groupBy("fp").agg(F.min(least).alias("least")).select(F.expr(f"substring(fp, 1, {8 * plan.words})").alias("fp"), "least", F.monotonically_increasing_id().alias("number"))
    classes = scratch.save(classes, "classes")
    roots = components(near_links(classes, plan, scratch), scratch)
    proposed = scratch.save(classes.join(roots, classes.number == roots.node).select(F.col("least.key").alias("key"), F.col("least.size").alias("size"), "number", "fp", "root"), "proposed")
    links = components(verified_links(texts, proposed, plan, scratch), Scratch(scratch.spark, "simhash_verified"))
    return classes.join(links, classes.number == links.node, "left").select("least", F.coalesce("root", "number").alias("root"))


def orderable(kind: T.DataType) -> bool:
    """Whether rows of the type can be compared."""
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Plan | None = None) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex digits), ``component_id`` (its smallest doc_id) for each row of ``docs``."""
    scratch, shape = Scratch(docs.sparkSession, "simhash"), plan or exact_plan(0)
    ids = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))
    marks = scratch.save(fingerprints(ids, shape, ["doc_id"]), "fingerprints")
    rooted = rooted_classes(marks, plan, scratch, F.col("doc_id"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = scratch.save(rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "whole")
    return marks.join(whole, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Plan | None = None) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near copies: that of the smallest doc_id stays."""
    scratch, plan = Scratch(docs.sparkSession, "simhash_keep"), plan or similarity_plan()
    # A row is told by id and text, not by a number of its own: so only narrow tables are written.
    body = named(text).cast("string")
    key = F.sha2(F.concat_ws("\x00", F.coalesce(named(doc_id).cast("string"), F.lit("none")), F.coalesce(body, F.lit("")), body.isNull().cast("string")), 256)
    rows = docs.select(named(doc_id).alias("id"), key.alias("key"), F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("size"), named(text).alias("text"))
    marks = scratch.save(fingerprints(rows, plan, ["id", "key", "size"]), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key", "size")
    rooted = alike_classes(rows.select("key", "text"), marks, plan, scratch, order) if plan.similarity else rooted_classes(marks, plan, scratch, order)
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("key"))
    # Rows of one id and text: the least one stays. They meet before the shuffle already, however many they are.
    least = F.min("row") if orderable(docs.schema) else F.min_by("row", F.to_json("row"))
    found = docs.select(F.struct(*map(named, docs.columns)).alias("row"), key.alias("key")).groupBy("key").agg(least.alias("row"))
    return found.join(kept, "key", "left_semi").select("row.*")
