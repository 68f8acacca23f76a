"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents become token ids and an end id; only those longer than a sequence are cut. Whole pieces fill a
sequence each. The rest are dealt at random to shards of some thousands, and each shard is packed on
several islands. An island keeps a population of packings that starts from best-fit decreasing and from bins
filled one after the other as tightly as a longest document and pairs allow. Crossover injects whole
well-filled bins of one parent into another and removes the bins that held the same documents. Displaced
documents first change places with one or two documents of a bin that they fill better (dominance), then
best-fit, and what is left fills new bins. After each epoch the best packings of an island migrate to the
next one. A population that has reached the lower bound stops. The loosest bins of all shards are then pooled
and packed again, over fewer shards each time, until a single shard has had them, so the number of shards
costs next to no sequences.

Null and empty texts are one end id; very long texts are cut into pieces. Repeated rows are packed each, an
empty table gives no rows, and extra columns, whatever their names, are not read. The ids of a word don't
depend on its neighbours across ASCII white space, so each worker keeps a bounded word-to-ids table in front
of the tokenizer; a text that holds a special token's string is given to the tokenizer as it is. So ids equal
those of the tokenizer on the whole text.
"""

from __future__ import annotations

import bisect
import itertools
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import give_back, text_bytes
from .names import named
from .scratch import Scratch

#: Fixed values of the contract.
SEQUENCE, END_ID = 4096, 1
SHARD_ITEMS, ISLANDS, EPOCHS, ELITES = 6000, 2, 2, 2
POPULATION, GENERATIONS = 5, 8
#: Displaced documents that may change places at once, and documents of a bin up to which its pairs may go.
SWAPPED, PAIRED = 192, 12
#: Share of a shard's bins, the loosest, that are packed again with those of other shards.
LOOSE = 0.1
TABLE_WORDS = 400_000
#: Not white space, not a letter, and one id of its own: stands between words that are encoded in one call.
MARK = "\x1f"
CHUNK_BYTES = 2 << 20
#: 1 for ASCII letters and digits, 2 for marks that are a token run of their own after one of them.
KINDS = np.zeros(256, np.uint8)
KINDS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = 1
KINDS[np.frombuffer(b".,;:!?*%&$#|", np.uint8)] = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ELITE = "shard long, island int, score double, bins binary"


class WordTable:
    """Ids of words, bounded; kept for all tasks of a worker process."""

    def __init__(self, tokenizer_json: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        #: Strings that are tokens of their own wherever they stand, and what would become one when lowered.
        self.special = sorted({t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        found = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = found[0] if len(found) == 1 else -1  # no such id: then each word is encoded alone
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts, self.lengths, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.used = 0

    @classmethod
    def of_worker(cls, tokenizer_json: str) -> WordTable:
        kept = sys.modules.setdefault("_tallyweave_word_tables", types.ModuleType("_tallyweave_word_tables")).__dict__
        key = zlib.crc32(tokenizer_json.encode())
        if key not in kept:
            kept[key] = cls(tokenizer_json)
        return kept[key]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has; one call takes many words with a mark between."""
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 2000):
            some = [w.decode("utf-8", "replace") for w in words[i : i + 2000]]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            if self.mark >= 0 and len(marks) == len(some) - 1 and not any(MARK in w for w in some):
                flat.append(np.delete(ids, marks))
                lengths.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
            else:
                each = [e.ids for e in self.tokenizer.encode_batch(some, add_special_tokens=False)]
                flat.append(np.fromiter(itertools.chain.from_iterable(each), np.uint32))
                lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(flat), np.concatenate(lengths)

    def words(self, texts: list[bytes]) -> list[list[bytes]]:
        """Words of each text, with a run of marks after a letter or digit as a word of its own; ASCII capitals lowered.

        Lowering first could change how a letter composes with a combining mark, so texts with one keep theirs.
        """
        flat = np.frombuffer(b"".join(t if b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts), np.uint8)
        kinds = KINDS[flat]
        marks = np.flatnonzero((kinds[1:] == 2) & (kinds[:-1] == 1)) + 1
        at = np.cumsum([0, *map(len, texts)])
        at += np.searchsorted(marks, at)  # a mark at a text's begin has its space in the text before
        raw = np.insert(flat, marks, 32).tobytes()
        return [raw[a:b].split() for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]

    def learn(self, words: list[bytes]) -> None:
        flat, lengths = self.encode(words)
        k, n, total = len(self.place), len(words), len(flat)
        while k + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = flat
        self.starts[k : k + n], self.lengths[k : k + n] = self.used + np.cumsum(lengths) - lengths, lengths
        self.place.update(zip(words, range(k, k + n), strict=True))
        self.used += total

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (and the end)."""
        whole = {k for k, t in enumerate(texts) if self.special and any(map(t.lower().__contains__, self.special))}
        if not whole:
            return self.ids_of_words(self.words(texts))
        flat, cuts = self.ids_of_words(self.words([b"" if k in whole else t for k, t in enumerate(texts)]))
        each = [self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids if k in whole else flat[cuts[k] : cuts[k + 1]] for k, t in enumerate(texts)]
        return np.concatenate([np.asarray(x, np.uint32) for x in each]), np.cumsum([0, *map(len, each)])

    def ids_of_words(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without special tokens, by their words."""
        words = list(itertools.chain.from_iterable(split))
        at = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown, used, new = np.flatnonzero(at < 0).tolist(), self.used, []
        if unknown:
            new = list(dict.fromkeys(map(words.__getitem__, unknown)))
            self.learn(new)
            at[unknown] = list(map(self.place.__getitem__, map(words.__getitem__, unknown)))
        lengths = self.lengths[at]
        first = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.flat[np.repeat(self.starts[at] - first[:-1], lengths) + np.arange(first[-1])]
        if len(self.place) > TABLE_WORDS:  # full: words that are new now are forgotten, the frequent ones came early
            for w in new:
                del self.place[w]
            self.used = used
        return flat, first[np.cumsum([0, *map(len, split)])]


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer's file, read on the driver; the default is the public 49k word BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def token_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE) -> DataFrame:
    """Per piece: its document, number, start among the document's ids, length and CRC-32 of its ids."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # one file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable.of_worker(shared.value)
        for batch in batches:
            ids, (data, at) = batch.column(0).cast(pa.int64()), text_bytes(batch.column(1))
            i, raw = 0, data.tobytes()
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
                flat, cuts = table.ids([raw[at[k] : at[k + 1]] for k in range(i, j)])
                rows: list[tuple[int, int, int, int, int]] = []
                for k in range(i, j):
                    own = np.append(flat[cuts[k - i] : cuts[k - i + 1]], np.uint32(END_ID)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), size)):
                        part = own[s : s + size]
                        rows.append((k, p, s, len(part), zlib.crc32(part.tobytes())))
                cols = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *map(pa.array, cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])
                i = j
        give_back()

    return docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("text")).mapInArrow(run, PIECES)


class Packer:
    """Packings of one shard: an array with the bin of each item."""

    def __init__(self, lengths: np.ndarray, size: int, seed: int) -> None:
        self.lengths, self.size, self.rng = lengths, size, np.random.default_rng(seed)
        self.bound = -(-int(lengths.sum()) // size)

    def best_fit(self, bins: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Puts the items, longest first, into the fullest bin of ``bins`` that has room, or a new one."""
        used = bins >= 0
        n = int(bins.max(initial=-1)) + 1
        free = self.size - np.bincount(bins[used], self.lengths[used], n).astype(np.int64)
        room = sorted(zip(free.tolist(), range(n), strict=True))
        for item in items[np.argsort(-self.lengths[items], kind="stable")].tolist():
            need = int(self.lengths[item])
            k = bisect.bisect_left(room, (need, -1))
            left, b = room.pop(k) if k < len(room) else (self.size, n)
            n += b == n
            bins[item] = b
            if left > need:
                bisect.insort(room, (left - need, b))
        return bins

    def compact(self, bins: np.ndarray) -> np.ndarray:
        return np.unique(bins, return_inverse=True)[1]

    def score(self, bins: np.ndarray) -> float:
        """Mean square fill: of two packings with as many bins, the one with emptier odd bins is better."""
        return float(((np.bincount(bins, self.lengths) / self.size) ** 2).mean()) if len(bins) else 0.0

    def tight(self, bins: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Puts the items into new bins, one bin after the other: the longest item left, then what fills the room best.

        While two items can't fill the room, the longest that fits is next; then the best pair or single one is.
        """
        n = int(bins.max(initial=-1)) + 1
        left = items[np.argsort(self.lengths[items], kind="stable")]
        sizes = self.lengths[left]
        while len(left):
            room, chosen = self.size - int(sizes[-1]), [len(left) - 1]
            free, names = sizes[:-1], np.arange(len(left) - 1)
            while len(free) and room >= free[0]:
                end = int(np.searchsorted(free, room, "right"))
                if room > 2 * int(free[end - 1]) + int(free[0]):
                    take = [end - 1]
                else:
                    mate = np.minimum(np.searchsorted(free, room - free[:end], "right") - 1, np.arange(end) - 1)
                    sums = np.where(mate >= 0, free[:end] + free[np.maximum(mate, 0)], free[:end])
                    best = int(sums.argmax())
                    take = [best] if mate[best] < 0 else [int(mate[best]), best]
                room -= int(free[take].sum())
                chosen += names[take].tolist()
                free, names = np.delete(free, take), np.delete(names, take)
            bins[left[chosen]] = n
            left, sizes = np.delete(left, chosen), np.delete(sizes, chosen)
            n += 1
        return bins

    def swapped(self, bins: np.ndarray) -> bool:
        """Lets displaced items (bin -1) take the place of one or two items of a bin that they fill better."""
        out = np.flatnonzero(bins < 0)
        if len(out) > SWAPPED:
            out = self.rng.choice(out, SWAPPED, replace=False)
        held = np.flatnonzero(bins >= 0)
        if not len(out) or not len(held):
            return False
        order = held[np.argsort(bins[held], kind="stable")]
        own, size = bins[order], self.lengths[order]
        free = self.size - np.bincount(own, size, int(own[-1]) + 1).astype(np.int64)
        last = np.searchsorted(own, own, "right") - np.arange(len(own)) - 1  # items of the bin after each
        crowd = np.bincount(own)[own]
        last = np.where((crowd <= PAIRED) & (free[own] > 0), last, 0)
        one = np.flatnonzero(free[own] > 0)
        a = np.repeat(np.arange(len(own)), last)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(last) - last, last)
        first, second = np.concatenate([one, a]), np.concatenate([np.full(len(one), -1), b])
        taken = size[first] + np.where(second >= 0, size[second], 0)
        i, j = np.triu_indices(len(out), 1)
        come = np.concatenate([self.lengths[out], self.lengths[out[i]] + self.lengths[out[j]]])
        rank = np.argsort(come, kind="stable")
        at = np.searchsorted(come[rank], taken + free[own[first]], "right") - 1
        better = np.flatnonzero((at >= 0) & (come[rank[at]] > taken))
        after = taken[better] + free[own[first[better]]] - come[rank[at[better]]]
        better = better[np.lexsort((-(come[rank[at[better]]] - taken[better]), after))]
        left, done, moved = np.ones(len(out), bool), set(), False
        for k in better.tolist():
            c = int(rank[at[k]])
            inward = [c] if c < len(out) else [int(i[c - len(out)]), int(j[c - len(out)])]
            number = int(own[first[k]])
            if number in done or not left[inward].all():
                continue
            done.add(number)
            left[inward] = False
            bins[order[first[k]]] = -1
            if second[k] >= 0:
                bins[order[second[k]]] = -1
            bins[out[inward]] = number
            moved = True
        return moved

    def repaired(self, bins: np.ndarray) -> np.ndarray:
        """Puts displaced items (bin -1) by exchange, then into bins with room, then into new ones."""
        while self.swapped(bins):
            if self.rng.random() < 0.2:
                break
        kept = bins >= 0
        bins[kept] = self.compact(bins[kept])
        n, items = int(bins.max(initial=-1)) + 1, np.flatnonzero(bins < 0)
        placed = self.best_fit(bins.copy(), items)
        late = np.flatnonzero(placed >= n)
        tight = placed.copy()
        tight[late] = -1
        tight = self.tight(tight, late)
        return max(placed, tight, key=self.score)

    def cross(self, host: np.ndarray, donor: np.ndarray) -> np.ndarray:
        fill = np.bincount(donor, self.lengths)
        full = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
        chosen = self.rng.choice(full, max(1, len(fill) // 5), replace=False) if len(full) >= len(fill) // 5 > 0 else full
        injected = np.isin(donor, chosen)
        hit = np.isin(host, host[injected])
        child = np.where(hit, -1, host)
        child[injected] = int(host.max(initial=-1)) + 1 + donor[injected]
        return self.repaired(child)

    def shaken(self, bins: np.ndarray) -> np.ndarray:
        """Empties the loosest bins and some others, and puts their items anew."""
        fill = np.bincount(bins, self.lengths)
        loose = np.argsort(fill, kind="stable")[: max(2, len(fill) // 50)]
        out = np.isin(bins, np.concatenate([loose, self.rng.integers(0, len(fill), max(2, len(fill) // 20))]))
        return self.repaired(np.where(out, -1, bins))

    def evolve(self, given: list[np.ndarray], generations: int) -> list[np.ndarray]:
        """The best packings after some generations, best first; stops at the lower bound."""
        none, every = np.full(len(self.lengths), -1, np.int64), np.arange(len(self.lengths))
        people = [*given, self.best_fit(none.copy(), every)]
        if not self.done(people):
            people.append(self.tight(none.copy(), every))
        people = sorted(people, key=self.score, reverse=True)
        while len(people) < POPULATION and not self.done(people):
            people.append(self.shaken(people[0]))
        for _ in range(generations):
            people = sorted(people, key=self.score, reverse=True)[:POPULATION]
            if self.done(people):
                break
            for a in range(len(people) - 1):
                people.append(self.cross(people[a], people[self.rng.integers(a + 1, len(people))]))
            people.append(self.shaken(people[0]))
        return sorted(people, key=self.score, reverse=True)[:ELITES]

    def done(self, people: list[np.ndarray]) -> bool:
        return any(int(p.max(initial=-1)) + 1 <= self.bound for p in people)


def pack_level(items: DataFrame, shards: int, level: int, size: int, scratch: Scratch) -> DataFrame:
    """``uid``, ``length``, ``bin`` (a number of its own over all levels), ``fill`` of each item of ``items``.

    ``items`` has ``bin`` too: the packing so far, null at first, which is one of the first packings.
    """
    dealt = scratch.save(items.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), F.coalesce("bin", "uid")), F.lit(shards)).cast("long")), f"dealt{level}")
    on_islands = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by("uid")

    def evolved(key, table, elites):
        table = ordered(table)
        shard, island = (k.as_py() for k in key)
        packer = Packer(table.column("length").to_numpy(), size, hash((shard, island, level)) & 0x7FFFFFFF)
        given = [np.frombuffer(x, "<u4").astype(np.int64) for x in (elites or [])]
        before = table.column("bin")
        if before.null_count == 0 and len(before):
            given.append(packer.compact(before.to_numpy()))
        best = packer.evolve(given, GENERATIONS)
        return pa.Table.from_arrays([pa.array([shard] * len(best), pa.int64()), pa.array([island] * len(best), pa.int32()), pa.array([packer.score(b) for b in best]), pa.array([b.astype("<u4").tobytes() for b in best], pa.binary())], ["shard", "island", "score", "bins"])

    def begin(key, table):
        return evolved(key, table, None)

    def go_on(key, table, arrived):
        return evolved(key, table, arrived.column("bins").to_pylist()) if table.num_rows else arrived.slice(0, 0).select(["shard", "island", "score", "bins"])

    elites = scratch.save(on_islands.groupBy("shard", "island").applyInArrow(begin, ELITE), f"epoch{level}_0")
    for epoch in range(1, EPOCHS):
        settled = elites.union(elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS))).select(*elites.columns))
        elites = scratch.save(on_islands.groupBy("shard", "island").cogroup(settled.groupBy("shard", "island")).applyInArrow(go_on, ELITE), f"epoch{level}_{epoch}")
    best = elites.groupBy("shard").agg(F.max_by("bins", F.struct("score", -F.col("island"))).alias("bins"))

    def settle(key, table, chosen):
        table = ordered(table)
        bins = np.frombuffer(chosen.column("bins")[0].as_py(), "<u4").astype(np.int64)
        lengths = table.column("length").to_numpy()
        fill = np.bincount(bins, lengths).astype(np.int64)
        rank = np.empty(len(fill), np.int64)
        rank[np.argsort(fill, kind="stable")] = np.arange(len(fill))
        loose = rank[bins] < max(2, int(len(fill) * LOOSE))
        number = (level << 56) + (key[0].as_py() << 24) + bins
        return pa.Table.from_arrays([table.column("uid"), table.column("length"), pa.chunked_array([pa.array(number)]), pa.chunked_array([pa.array(loose)])], ["uid", "length", "bin", "loose"])

    packed = dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(settle, "uid long, length long, bin long, loose boolean")
    return scratch.save(packed, f"packed{level}")


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``pieces`` (with a ``length``) with ``sequence_id`` and ``offset``."""
    scratch = Scratch(pieces.sparkSession, "packing")
    pieces = scratch.save(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") >= size).select("uid", "length", (-F.col("uid") - 1).alias("bin"))
    todo, done, level = pieces.where(F.col("length") < size).select("uid", "length", F.lit(None).cast("long").alias("bin")), [whole], 0
    while True:
        shards = max(1, round(todo.count() / SHARD_ITEMS))
        packed = pack_level(todo, shards, level, size, scratch)
        if shards == 1:
            done.append(packed.select("uid", "length", "bin"))
            break
        done.append(packed.where("not loose").select("uid", "length", "bin"))
        todo, level = packed.where("loose").select("uid", "length", "bin"), level + 1
    placed = done[0]
    for part in done[1:]:
        placed = placed.union(part)

    offset = F.sum("length").over(Window.partitionBy("bin").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("offset", F.coalesce(offset, F.lit(0))).select("uid", F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(placed, "uid").drop("uid")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer_path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    return pack(token_pieces(docs, tokenizer_text(tokenizer_path), doc_id, text, size), size)
