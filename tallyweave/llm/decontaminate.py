"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and every run of other than letters and digits becomes one space. A region that is
within ``k`` edits of an item of ``m`` bytes shares at least ``(m - q + 1) - k * q`` of its q-grams, all
on diagonals at most ``k`` apart. So an item is looked for only in texts that hold as many of its q-grams
anywhere, and there shared q-grams are counted in diagonal bands that overlap by half, which hold any such
region whole in one band; bands below the bound can't match. What is left is measured by Myers' bit vectors,
and where those stay within ``k`` by banded alignment, which gives the region and its edits exactly.

Places of a q-gram in a text times its places in an item are counted some at a time, and where both are many
by one product of polynomials over the diagonals: so memory and time are bounded for repetitive texts too.

The benchmark is a stated query set. Its texts, not their indexes, are broadcast, at most some ``PASS_BYTES`` in one
scan; a task indexes a slice of some ``SLICE_BYTES`` (about 50 bytes for one of text), meets the texts of a batch
with it and frees it before the next. A larger benchmark takes several scans, each written before the next. Items
shorter than q are looked up as whole words, all of a slice in one pass. Null or empty items match nothing, null or empty documents are clean, very long ones are read
whole, repeated rows are judged each, and an empty table gives no rows. Of equal edits the first region is
given. Extra columns are carried as they are; one named ``hits`` gets an underscore after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import give_back, text_bytes
from .names import carried, named, source
from .scratch import Scratch

Q = 8
#: Edits allowed, as a share of the item's length. At q = 8 the lemma's bound is positive for all of it from 32 bytes on.
EDITS = 0.1
SLICE_BYTES, PASS_BYTES = 1 << 20, 32 << 20
CHUNK_BYTES = 1 << 20
GATE_BITS = 20
#: Pairs of places that are counted at once, and of one q-gram from which on they are counted by a product.
PAIRS_AT_ONCE = 1 << 20
KEEP = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(KEEP).split())


def grams(line: np.ndarray) -> np.ndarray:
    """The q-gram at each byte, as the number that its 8 bytes spell."""
    n = len(line) - Q + 1
    return np.ndarray(n, "<u8", line.tobytes(), strides=(1,)) if n > 0 else np.zeros(0, np.uint64)


def budget(m: int) -> int:
    """Edits for an item of m bytes: its share, as far as the lemma's bound stays positive."""
    return max(0, min(int(EDITS * m), (m - Q) // Q))


def best_region(item: np.ndarray, region: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(edits, end) of the best match of the item in the region, on diagonals low to high only."""
    m, n, far = len(item), len(region), 1 << 30
    at = np.arange(low, high + 1)  # column of row 0 for each diagonal
    row = np.where((at >= 0) & (at <= n), 0, far)
    for i in range(1, m + 1):
        at = at + 1
        inside = (at >= 1) & (at <= n)
        same = np.zeros(len(at), bool)
        same[inside] = region[at[inside] - 1] == item[i - 1]
        step = row + ~same
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        step = np.where(inside, step, np.where(at == 0, i, far))
        row = np.minimum.accumulate(step - np.arange(len(at))) + np.arange(len(at))
        row = np.where((at >= 0) & (at <= n), np.minimum(row, far), far)
    k = int(row.argmin())
    return int(row[k]), int(at[k])


def fewest_edits(item: bytes, region: bytes) -> tuple[int, int]:
    """(edits, end) of the item's best match anywhere in the region (Myers' bit vectors), the first of equals."""
    m = len(item)
    all_, top, where = (1 << m) - 1, 1 << (m - 1), [0] * 256
    for i, c in enumerate(item):
        where[c] |= 1 << i
    up, down, edits, best, end = all_, 0, m, m, 0
    for at, c in enumerate(region, 1):
        same = where[c]
        across = (((same & up) + up) ^ up) | same
        more, less = down | (all_ & ~(across | up)), up & across
        if more & top:
            edits += 1
        elif less & top:
            edits -= 1
            if edits < best:
                best, end = edits, at
        more, same = more << 1, same | down
        up, down = ((less << 1) | ~(same | more)) & all_, more & same & all_
    return best, end


class ShortItems:
    """Items shorter than q, by one automaton over the words around them."""

    def __init__(self, lines: list[tuple[int, bytes]]) -> None:
        self.automaton = ahocorasick.Automaton()
        by: dict[bytes, list[int]] = {}
        for number, line in lines:
            by.setdefault(line, []).append(number)
        for line, numbers in by.items():
            self.automaton.add_word(f" {line.decode('latin-1')} ", (numbers, len(line)))
        if by:
            self.automaton.make_automaton()

    def __len__(self) -> int:
        return len(self.automaton)

    def places(self, raw: bytes) -> dict[int, tuple[int, int]]:
        """The first place of each item in a text, and its size."""
        found: dict[int, tuple[int, int]] = {}
        for end, (numbers, size) in self.automaton.iter(f" {raw.decode('latin-1')} "):
            for number in numbers:
                found.setdefault(number, (end - size - 1, size))
        return found


class Items:
    """A slice of the benchmark: its texts and the places of each q-gram."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        lines = [(i, plain(t or "")) for i, t in rows]
        self.short = ShortItems([(i, line) for i, line in lines if 0 < len(line) < Q])
        self.lines = [(i, np.frombuffer(line, np.uint8)) for i, line in lines if len(line) >= Q]
        keys = [grams(line) for _, line in self.lines]
        item = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
        flat = np.concatenate([np.zeros(0, np.uint64), *keys])
        order = np.argsort(flat, kind="stable")
        place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(k), dtype=np.int32) for k in keys)])
        self.item, self.place = item[order], place[order]  # of each place, in order of the q-grams
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        rank = np.searchsorted(self.keys, flat).astype(np.int32)
        cuts = np.cumsum([0, *map(len, keys)])
        self.ranks = [rank[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]  # of each item's q-grams, by place
        self.gate = np.zeros(1 << GATE_BITS, bool)
        self.gate[self.slot(self.keys)] = True
        self.size = np.array([len(line) for _, line in self.lines], np.int64)
        self.edits = np.array([budget(n) for n in self.size], np.int64)
        self.bound = self.size - Q + 1 - self.edits * Q
        self.least = self.bound.min(initial=1 << 30)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - GATE_BITS)

    def bands(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, band) where the lemma's bound is met."""
        if not len(self.keys):
            return
        found = grams(data)
        where = np.flatnonzero(self.gate[self.slot(found)])
        k = np.minimum(np.searchsorted(self.keys, found[where]), len(self.keys) - 1)
        doc = np.searchsorted(at, where, "right") - 1
        ok = (self.keys[k] == found[where]) & (where + Q <= at[doc + 1])
        ok[ok] = np.bincount(doc[ok], minlength=len(at))[doc[ok]] >= min(self.least, 1 << 30)  # fewer than any item asks for
        where, k, doc = where[ok], k[ok], doc[ok]
        cells, pairs = self.likely(doc, k)
        n, few = len(self.size), cells[pairs <= PAIRS_AT_ONCE]
        yield from self.bands_of_few(few, doc, k, where - at[doc])
        cuts = np.searchsorted(doc, np.arange(len(at)))
        for cell in cells[pairs > PAIRS_AT_ONCE].tolist():
            own = slice(cuts[cell // n], cuts[cell // n + 1])
            for band in self.bands_of(cell % n, k[own], where[own] - at[cell // n]):
                yield cell // n, cell % n, band

    def pieces(self, ranks: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Some of the q-grams at a time: which, how many places in items each has, and all these places."""
        times = self.count[ranks]
        upto = np.concatenate([[0], np.cumsum(times)])
        i = 0
        while i < len(ranks):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS_AT_ONCE, "right")) - 1)
            yield slice(i, j), times[i:j], np.repeat(self.first[ranks[i:j]] - upto[i:j], times[i:j]) + np.arange(upto[i], upto[j])
            i = j

    def likely(self, doc: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text times items + item) where the item has at least its bound of places whose q-grams are among those of the
        text, and how many pairs of places the two have."""
        pairs, often = np.unique(doc * len(self.keys) + k, return_counts=True)
        doc, n = pairs // len(self.keys), len(self.size)
        cells, held, total = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        for some, times, flat in self.pieces(pairs % len(self.keys)):
            cells, back = np.unique(np.concatenate([cells, np.repeat(doc[some], times) * n + self.item[flat]]), return_inverse=True)
            held = np.bincount(back, np.concatenate([held, np.ones(len(flat))]), len(cells))
            total = np.bincount(back, np.concatenate([total, np.repeat(often[some], times)]), len(cells))
            last = doc[some.stop] * n if some.stop < len(doc) else n * int(doc[-1] + 1)  # texts before that are counted whole
            keep = (held >= self.bound[cells % n]) | (cells >= last)
            cells, held, total = cells[keep], held[keep], total[keep]
        return cells, total

    def bands_of_few(self, few: np.ndarray, doc: np.ndarray, k: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, band) that meet the bound, of the cells ``few``, all counted together."""
        if not len(few):
            return
        n = len(self.size)
        low = -int(self.size.max()) - 2  # no diagonal is lower, no band either
        span = int(places.max()) - low + 2
        cells, counts = np.zeros(0, np.int64), np.zeros(0)
        for some, times, flat in self.pieces(k):
            item = self.item[flat]
            cell = np.repeat(doc[some] * n, times) + item
            at = np.minimum(np.searchsorted(few, cell), len(few) - 1) if len(few) > 1 else np.zeros(len(cell), np.int64)
            ok = few[at] == cell
            band = (np.repeat(places[some], times)[ok] - self.place[flat][ok]) // (self.edits[item[ok]] + 1) - low
            own = at[ok] * span + band
            cells, back = np.unique(np.concatenate([cells, own, own - 1]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, np.ones(2 * len(own))]), len(cells))
        enough = counts >= self.bound[few[cells // span] % n]
        for c in cells[enough].tolist():
            yield int(few[c // span] // n), int(few[c // span] % n), c % span + low

    def bands_of(self, item: int, k: np.ndarray, places: np.ndarray) -> list[int]:
        """Bands of one text whose count of the item's q-grams meets the bound; the text has q-grams ``k`` at ``places``."""
        own = self.ranks[item]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        low, high = np.searchsorted(ranked, k, "left"), np.searchsorted(ranked, k, "right")
        times = high - low
        keep = times > 0
        k, places, low, times = k[keep], places[keep], low[keep], times[keep]
        width, shift = int(self.edits[item]) + 1, len(own)  # a diagonal may be as low as -shift
        counts = np.zeros((int(places.max(initial=0)) + shift) // width + 3, np.int64)
        zero = -(-shift // width)  # the cell of band 0
        often = np.bincount(k, minlength=0)
        pairs = often[k] * times
        hot = pairs > PAIRS_AT_ONCE
        for rank in np.unique(k[hot]).tolist():
            text, line = np.zeros(int(places.max()) + 1), np.zeros(shift)
            text[places[k == rank]], line[order[np.searchsorted(ranked, rank) : np.searchsorted(ranked, rank, "right")]] = 1, 1
            size = 1 << int(len(text) + shift).bit_length()
            by_diagonal = np.rint(np.fft.irfft(np.fft.rfft(text, size) * np.fft.rfft(line[::-1], size), size)).astype(np.int64)[: len(text) + shift - 1]
            cell = (np.arange(len(by_diagonal)) - (shift - 1)) // width + zero
            counts += np.bincount(cell, by_diagonal, minlength=len(counts)).astype(np.int64)
        places, low, times = places[~hot], low[~hot], times[~hot]
        upto = np.concatenate([[0], np.cumsum(times)])
        i = 0
        while i < len(places):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS_AT_ONCE, "right")) - 1)
            at = order[np.repeat(low[i:j] - upto[i:j], times[i:j]) + np.arange(upto[i], upto[j])]
            counts += np.bincount((np.repeat(places[i:j], times[i:j]) - at) // width + zero, minlength=len(counts))
            i = j
        both = counts.copy()
        both[:-1] += counts[1:]  # a band holds its own diagonals and the next one's
        return (np.flatnonzero(both >= self.bound[item]) - zero).tolist()

    def regions(self, of: list[tuple[int, int]], size: int) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the bands in a text of that size, where those that overlap are one."""
        last = None
        for item, band in of:
            k, m = int(self.edits[item]), int(self.size[item])
            a, b = max(0, band * (k + 1) - k), min(size, (band + 2) * (k + 1) + m + k)
            if last and last[0] == item and a <= last[2]:
                last = (item, last[1], b)
                continue
            if last:
                yield last
            last = (item, a, b)
        if last:
            yield last

    def hits(self, line: np.ndarray, of: list[tuple[int, int]]) -> list[dict]:
        """The best region of each item in one text, from the bands that met the bound."""
        best: dict[int, tuple[int, int, int]] = {}
        raw = line.tobytes()
        for item, a, b in self.regions(sorted(of), len(line)):
            number, text = self.lines[item]
            k, m = int(self.edits[item]), len(text)
            if best.get(number, (1, 0, 0))[0] == 0:  # regions rise: the first place without edits has been found
                continue
            exact = raw.find(text.tobytes(), a, b)
            if exact >= 0:
                best[number] = min(best.get(number, (k + 1, 0, 0)), (0, exact, exact + m))
                continue
            edits, end = fewest_edits(text.tobytes(), raw[a:b])
            if edits > k:
                continue
            first = max(a, a + end - m - k)
            edits, size = best_region(text, line[first : a + end], -k, max(0, a + end - first - m) + k)
            if edits <= k:
                end = first + size
                back, size = best_region(text[::-1], line[first:end][::-1], -k, k)
                best[number] = min(best.get(number, (k + 1, 0, 0)), (edits, end - size if back <= edits else max(first, end - m), end))
        if len(self.short):
            best.update((number, (0, place, place + size)) for number, (place, size) in self.short.places(raw).items())
        return [{"item_id": i, "edits": e, "start": s, "end": t} for i, (e, s, t) in sorted(best.items())]


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all by default) and ``hits``: for each item found its edits and its region.

    Regions are byte ranges of the normalised text. An item that occurs several times gives its best region.
    """
    held = carried(docs, carry, ["hits"])
    spark, out = docs.sparkSession, docs.select(*held.columns, source(docs, text).cast("string").alias("text_read"), F.array().cast(HIT).alias("hits"))
    items = benchmark.select(named(item_id).cast("long").alias("item_id"), named(item_text).cast("string").alias("text")).where("item_id is not null and text is not null")
    passes = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES))
    scratch = Scratch(spark, "decontaminate") if passes > 1 else None
    for number in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).orderBy("item_id", "text").toArrow()
        schema = out.schema
        out = out.mapInArrow(scan(spark.sparkContext.broadcast(sliced(rows)), schema), schema)
        if scratch:
            out = scratch.save(out, f"pass{number}")
            scratch.drop(f"pass{number - 1}")
    return out.drop("text_read").toDF(*held.names, "hits")


def sliced(rows: pa.Table) -> list[tuple[list[int], list[str]]]:
    """Items in runs of about ``SLICE_BYTES``; a longer one is a run of its own."""
    ids, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
    upto = np.cumsum([0, *(len(t.encode()) for t in texts)])
    out, i = [], 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + SLICE_BYTES, "right")) - 1)
        out.append((ids[i:j], texts[i:j]))
        i = j
    return out


def scan(shared, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    hit_type = to_arrow_type(HIT)

    def read(items: Items, lines: list[bytes]) -> list[list[dict]]:
        """The hits of each normalised text."""
        of: dict[int, list[tuple[int, int]]] = {}
        for doc, item, band in items.bands(np.frombuffer(b"".join(lines), np.uint8), np.cumsum([0, *map(len, lines)])):
            of.setdefault(doc, []).append((item, band))
        return [items.hits(np.frombuffer(line, np.uint8), of.get(k, [])) if line and (k in of or len(items.short)) else [] for k, line in enumerate(lines)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, only = shared.value, None
        for batch in batches:
            data, at = text_bytes(batch.column(batch.num_columns - 2))
            cuts, i = [0], 0
            while i < batch.num_rows:
                i = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
                cuts.append(i)
            hits = batch.column(batch.num_columns - 1).to_pylist()
            for own in slices:
                items = only or Items(list(zip(*own, strict=True)))
                only = items if len(slices) == 1 else None
                for a, b in zip(cuts, cuts[1:], strict=False):
                    lines = [plain(data[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace")) for k in range(a, b)]
                    for k, new in enumerate(read(items, lines), a):
                        hits[k] = [*hits[k], *new]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, hit_type)], names=batch.schema.names)
        give_back()

    return run
