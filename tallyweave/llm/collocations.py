"""Phrase collocation mining: words that stand together more often than their parts would.

Words that occur often in their language are encoded as the numbers of a dictionary; pieces break at all others.
Runs of numbers are packed into keys of fixed width, one or more 64-bit words, each n-gram of 2 to ``max_words``
words filled up with zeros. A task sorts the keys of a block and writes each with its count, so that a phrase
which holds much of the corpus is one row of a block; then keys are range-partitioned, sorted (Spark sorts keys of one
word by radix) and run lengths are summed. No phrase of ``least`` occurrences holds a rarer word, so none is lost.

Words are told by a 64-bit hash with their language. Counting sees each word's text, so it is known whether two
words share a hash; if any do, all is hashed anew by another seed. The number of a word is the place of its hash
among those of all frequent words. Up to ``BROADCAST_WORDS`` words that is one sorted array for all tasks;
beyond, blocks ask for their distinct words by a join and get numbers back, and nothing is broadcast.

Counts of parts are joined to candidates by their numbers. Parts with over a ``1 / HOT`` share of all words could
be hot keys: these are fewer than ``HOT`` of a length by definition, and are broadcast; the rest shuffle.

Null and empty texts have no words; a null language is ``und``. Very long texts are taken whole, repeated rows
count each, ties are broken by the phrase's UTF-8 bytes, an empty table gives no rows. Only the two named columns
are read. Scores are exact while a count stays below 10^16.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytetext import WordHash, give_back, splitmix, text_bytes, word_spans
from .names import named
from .scratch import Scratch

#: Bytes of text that are one block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 22
#: Frequent words up to which all tasks get the sorted hashes (8 bytes each).
BROADCAST_WORDS = 2_000_000
HOT = 10_000
#: Groups that a language's candidates are dealt to before its first ones are taken.
DEALT = 64
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
BREAKS, GAPS = np.zeros(256, bool), np.zeros(256, bool)
BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
GAPS[[9, 32]] = True
GAPS |= BREAKS


def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Lower-cased bytes, offsets and languages of runs of texts of about ``BLOCK_BYTES``."""
    data, at = text_bytes(batch.column(1))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, "right")) - 1)
        yield ASCII_LOWER[data[at[i] : at[j]]], at[i : j + 1] - at[i], batch.column(0).slice(i, j - i)
        i = j


class Tokens:
    """The words of a block: spans, hashes with the language, and whether each starts a piece."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: pa.Array, hasher: WordHash) -> None:
        self.data = data
        self.starts, self.ends, firsts = word_spans(data, at, GAPS)
        text = np.repeat(np.arange(len(langs)), np.diff(firsts))
        coded = langs.dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        marks = np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in self.names], np.uint64)
        self.lang = coded.indices.to_numpy()[text]
        self.hash = splitmix(hasher.spans(data, self.starts, self.ends) ^ splitmix(marks)[self.lang]) if len(text) else np.zeros(0, np.uint64)
        self.new = np.ones(len(text), bool)
        if len(text):
            pieces = np.cumsum(BREAKS[data], dtype=np.int32)[self.starts]
            self.new[1:] = (pieces[1:] != pieces[:-1]) | (text[1:] != text[:-1])

    def counted(self) -> pa.RecordBatch:
        """A row of each distinct word."""
        hashes, first, n = np.unique(self.hash, return_index=True, return_counts=True)
        raw, spans = self.data.tobytes(), zip(self.starts[first].tolist(), self.ends[first].tolist(), strict=True)
        words = pa.array([raw[a:b] for a, b in spans], pa.binary())
        lang = pa.array(self.names, pa.string()).take(pa.array(self.lang[first], pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), lang, words, pa.array(n)], ["hash", "lang", "word", "n"])

    def run(self, numbers: np.ndarray) -> np.ndarray:
        """The words' ``numbers`` with a zero before each piece."""
        out = np.zeros(len(numbers) + int(self.new.sum()), np.int64)
        out[np.arange(len(numbers)) + np.cumsum(self.new)] = numbers
        return out


class Packing:
    """How n-grams of numbers up to ``most`` become keys: so many bits a number, so many numbers in a 64-bit word."""

    def __init__(self, most: int, max_words: int) -> None:
        self.bits, self.max_words = max(1, int(most).bit_length()), max_words
        self.each = min(63 // self.bits, max_words)
        self.columns = [f"k{i}" for i in range(-(-max_words // self.each))]

    def shift(self, place: int) -> tuple[str, int]:
        word, k = divmod(place, self.each)
        return self.columns[word], self.bits * (self.each - 1 - k)

    def counted(self, run: np.ndarray) -> list[np.ndarray]:
        """Sorted distinct keys of all n-grams of a run (a zero breaks it), and the count of each."""
        found = []
        for n in range(2, self.max_words + 1):
            whole = np.ones(max(0, len(run) - n + 1), bool)
            for k in range(n):
                whole &= run[k : len(run) - n + 1 + k] > 0
            at = np.flatnonzero(whole)
            keys = np.zeros((len(self.columns), len(at)), np.int64)
            for k in range(n):
                column, shift = self.shift(k)
                keys[self.columns.index(column)] |= run[at + k] << shift
            found.append(keys)
        keys = np.concatenate(found, axis=1)
        keys = np.sort(keys, axis=1) if len(keys) == 1 else keys[:, np.lexsort(keys[::-1])]
        return run_lengths(keys, np.ones(keys.shape[1], np.int64))

    def unpacked(self) -> list[Column]:
        """The numbers of a key, as columns w1, w2, ..."""
        out = []
        for k in range(self.max_words):
            column, shift = self.shift(k)
            out.append(F.shiftrightunsigned(column, shift).bitwiseAND((1 << self.bits) - 1).alias(f"w{k + 1}"))
        return out


def run_lengths(keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Each distinct key of sorted ``keys`` and the sum of its counts."""
    if not keys.shape[1]:
        return [*keys, counts]
    first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    return [*keys[:, first], np.add.reduceat(counts, first)]


def counted_words(texts: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash(seed)
        for batch in batches:
            for block in blocks_of(batch):
                yield Tokens(*block, hasher).counted()
        give_back()

    rows = texts.mapInArrow(run, "hash long, lang string, word binary, n long")
    return rows.groupBy("hash", "lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``words`` with ``number``, from 1, in the order of unsigned hashes: ranked in 4,096 ranges, placed by their sizes."""
    ranges = words.withColumn("range", F.shiftrightunsigned("hash", 52).cast("int"))
    ranked = scratch.save(ranges.withColumn("number", F.row_number().over(Window.partitionBy("range").orderBy("hash")).cast("long")), "ranked")
    sizes = np.zeros(4096, np.int64)
    for r in ranked.groupBy("range").count().collect():  # 4,096 rows at most
        sizes[r[0]] = r[1]
    before = F.lit((np.cumsum(sizes) - sizes).tolist())
    return ranked.withColumn("number", F.col("number") + before[F.col("range")]).drop("range")


def grams_by_array(texts: DataFrame, hashes: np.ndarray, seed: int, packing: Packing) -> DataFrame:
    """Keys and counts of each block's n-grams, with the sorted ``hashes`` of all frequent words at each task."""
    shared = texts.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = WordHash(seed), shared.value
        for batch in batches:
            for block in blocks_of(batch):
                tokens = Tokens(*block, hasher)
                distinct, where = np.unique(tokens.hash, return_inverse=True)
                place = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
                numbers = np.where(known[place] == distinct, place + 1, 0) if len(known) else np.zeros(len(distinct), np.int64)
                yield pa.RecordBatch.from_arrays(list(map(pa.array, packing.counted(tokens.run(numbers[where])))), [*packing.columns, "n"])
        give_back()

    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in [*packing.columns, "n"]))


def grams_by_join(texts: DataFrame, words: DataFrame, seed: int, packing: Packing, scratch: Scratch) -> DataFrame:
    """The same without a broadcast: blocks are written with their distinct hashes, which are joined to the words' numbers."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash(seed)
        for batch in batches:
            for block in blocks_of(batch):
                tokens = Tokens(*block, hasher)
                distinct, where = np.unique(tokens.hash, return_inverse=True)
                run = tokens.run(where + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([distinct.tobytes()], pa.binary()), pa.array([run.tobytes()], pa.binary())], ["hashes", "run"])
        give_back()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), block)), pa.array(np.arange(len(hashes))), pa.array(hashes)], ["block", "place", "hash"])

    def answered(own: pa.Table, replies: pa.Table) -> pa.Table:
        raw = own.column("run").to_pylist()
        run = np.frombuffer(raw[0], np.int32) if raw else np.zeros(0, np.int32)
        numbers = np.zeros(int(run.max(initial=0)) + 1, np.int64)
        numbers[replies.column("place").to_numpy() + 1] = replies.column("number").to_numpy()
        give_back()
        return pa.table(dict(zip([*packing.columns, "n"], packing.counted(numbers[run]), strict=True)))

    blocks = scratch.save(texts.mapInArrow(write, "hashes binary, run binary").withColumn("block", F.monotonically_increasing_id()), "blocks")
    replies = blocks.select("block", "hashes").mapInArrow(asked, "block long, place long, hash long").join(words.select("hash", "number"), "hash").select("block", "place", "number")
    both = blocks.select("block", "run").groupBy("block").cogroup(replies.groupBy("block"))
    return both.applyInArrow(answered, ", ".join(f"{c} long" for c in [*packing.columns, "n"]))


def counted_grams(grams: DataFrame, packing: Packing, least: int) -> DataFrame:
    """The n-grams with ``least`` occurrences: numbers w1, w2, ... and ``n``. ``grams`` is a written table, as ranges are drawn from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last run, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if held:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            found = run_lengths(np.stack(columns[:-1]), columns[-1])
            held, whole = [c[-1:] for c in found], [c[:-1] for c in found]
            yield pa.RecordBatch.from_arrays([pa.array(c[whole[-1] >= least]) for c in whole], [*packing.columns, "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c[held[-1] >= least]) for c in held], [*packing.columns, "n"])

    ranged = grams.repartitionByRange(*packing.columns).sortWithinPartitions(*packing.columns)
    return ranged.mapInArrow(run, grams.schema).select(*packing.unpacked(), "n")


def with_counts(rows: DataFrame, counts: DataFrame, keys: list[str], values: dict[str, str], total: int) -> DataFrame:
    """``rows`` with the ``values`` (name in counts: name given) of the part that ``keys`` name; ``counts`` has columns w1, ... and ``n``."""
    own, names = [f"w{k + 1}" for k in range(len(keys))], list(values.items())
    part = counts.select(*(F.col(o).alias(f"_{k}") for k, o in enumerate(own)), *(F.col(v).alias(f"_{g}") for v, g in names), (F.col("n") * HOT > total).alias("_hot"))

    def equal(left: DataFrame, right: DataFrame, lefts: list[str], rights: list[str]) -> Column:
        on = F.lit(True)
        for a, b in zip(lefts, rights, strict=True):
            on = on & (left[a] == right[b])
        return on

    hot = part.where("_hot").select(*(F.col(f"_{k}").alias(f"_h{k}") for k in range(len(keys))), *(F.col(f"_{g}").alias(f"_h{g}") for _, g in names))
    first = rows.join(F.broadcast(hot), equal(rows, hot, keys, [f"_h{k}" for k in range(len(keys))]), "left")
    # A row that has its answer asks for a number that no part has, another each time, so that these spread.
    spread = -1 - F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30))
    first = first.withColumns({f"_a{k}": F.when(F.col("_h0").isNull(), F.col(c)).otherwise(spread) for k, c in enumerate(keys)})
    cold = part.where("not _hot")
    both = first.join(cold, equal(first, cold, [f"_a{k}" for k in range(len(keys))], [f"_{k}" for k in range(len(keys))]), "left")
    return both.select(*(F.col(c) for c in rows.columns), *(F.coalesce(f"_h{g}", f"_{g}").alias(g) for _, g in names))


def scored(grams: DataFrame, counts: dict[int, DataFrame], length: int, total: int) -> DataFrame:
    """Candidates of ``length`` words with ``lang``, ``phrase`` (bytes), and ``best``: the lowest score of a cut, and its parts' counts."""
    ids, rows = [f"w{k + 1}" for k in range(length)], grams.select(*(f"w{k + 1}" for k in range(length)), F.col("n").alias("a"))
    for k, c in enumerate(ids):
        rows = with_counts(rows, counts[1], [c], {"word": f"word{k}", "n": f"n{k}"} | ({"lang": "lang"} if not k else {}), total)
    cuts = []
    for k in range(1, length):
        parts = []
        for name, some in ((f"l{k}", ids[:k]), (f"r{k}", ids[k:])):
            if len(some) == 1:
                parts.append(f"n{ids.index(some[0])}")
            else:
                rows = with_counts(rows, counts[len(some)], some, {"n": name}, total)
                parts.append(name)
        left, right = parts
        score = F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))
    phrase = F.concat(*(x for k in range(length) for x in ([F.lit(b" ")] if k else []) + [F.col(f"word{k}")]))
    return rows.select(*ids, "lang", phrase.alias("phrase"), "a", F.array_min(F.array(*cuts)).alias("best"))


def inside(longer: list[tuple[int, DataFrame]], length: int) -> DataFrame:
    """Runs of ``length`` words in longer candidates, with the greatest count of one that holds them."""
    runs = [g.select(*(F.col(f"w{at + k + 1}").alias(f"w{k + 1}") for k in range(length)), "n") for own, g in longer for at in range(own - length + 1)]
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    return both.groupBy(*(f"w{k + 1}" for k in range(length))).agg(F.max("n").alias("held"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 3, least: int = 10, share: tuple[int, int] = (50, 100), top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (its words) and ``score``.

    Candidates lying inside a longer one that has at least ``share`` (numerator and denominator) of their count are dropped.
    """
    if max_words < 2 or least < 1:
        raise ValueError("phrases have two words at least and occur at least once")
    scratch = Scratch(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(named(lang).cast("string"), F.lit("und")).alias("lang"), named(text).cast("string").alias("text"))
    for seed in itertools.count(11):
        words = scratch.save(counted_words(texts, seed), f"words{seed}")
        if words.groupBy("hash").count().where("count > 1").isEmpty():
            break
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = scratch.save(numbered(words.where(F.col("n") >= least), scratch).withColumn("w1", F.col("number")), "frequent")
    size = frequent.count()
    packing = Packing(size, max_words)
    if size <= BROADCAST_WORDS:
        hashes = np.sort(frequent.select("hash").toArrow().column(0).to_numpy().view(np.uint64))
        grams = grams_by_array(texts, hashes, seed, packing)
    else:
        grams = grams_by_join(texts, frequent, seed, packing, scratch)
    found = scratch.save(counted_grams(scratch.save(grams, "grams"), packing, least), "phrases")
    scratch.drop("grams", "blocks", "ranked")
    lengths = {n: found.where((F.col(f"w{n}") > 0) & (F.col(f"w{n + 1}") == 0 if n < max_words else F.lit(True))) for n in range(2, max_words + 1)}
    counts, kept = {1: frequent} | lengths, []
    for n in range(2, max_words + 1):
        own = lengths[n]
        if n < max_words:
            held = inside([(m, lengths[m]) for m in range(n + 1, max_words + 1)], n)
            own = own.join(held, [f"w{k + 1}" for k in range(n)], "left").where(f"held is null or {share[1]} * held < {share[0]} * n")
        kept.append(scored(own, counts, n, total).select("lang", "phrase", "a", "best.score", "best.l", "best.r"))
    candidates = kept[0]
    for k in kept[1:]:
        candidates = candidates.unionByName(k)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = candidates.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    columns = ("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
    return scratch.save(ranked.join(totals, "lang").select(*columns), "ranked_phrases")
