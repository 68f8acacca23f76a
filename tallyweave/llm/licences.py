"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and reduced to its words of letters, digits and other than ASCII characters,
with one space between. Rules are regular expressions over that line, written by hand in ``licence_rules``:
tags, grants, headers, bodies and clauses of licenses. Each has keywords, long strings of which every match
holds one, read off the expression itself; one automaton finds the keywords of all rules in one pass, and
a rule runs only on texts that hold one of its own. Detections are ordered by priority, then length, then place; one
that lies within the interval of a detection before it is suppressed. Base phrases have the highest priority
and are never suppressed.

Null and empty texts have no words and no labels. Very long texts are read whole, in time that grows with
their length and detections. Repeated rows are scanned each, and an empty table gives no rows. Extra columns
are carried as they are; one named ``found`` gets an underscore after it.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytetext import text_bytes
from .licence_rules import RULES
from .names import carried, source

#: Fixed values of the contract: phrase and label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_PRIORITY, BASE_SURE = 100, 0.9


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    sure: float
    #: Bytes of a match that stands in a lookahead, as places of base phrases may overlap.
    size: int = 0


def keywords(pattern) -> tuple[str, ...]:
    """Strings of which every match of a parsed expression holds one, as long as they can be; none if there are no such."""
    best, run = (), ""

    def better(some: tuple[str, ...]) -> tuple[str, ...]:
        return max(best, some, key=lambda x: min(map(len, x), default=0))

    for kind, value in pattern:
        if kind == re._constants.LITERAL:
            run += chr(value)
            continue
        best, run = better((run,)), ""
        if kind == re._constants.SUBPATTERN:
            best = better(keywords(value[-1]))
        elif kind == re._constants.MAX_REPEAT and value[0] > 0:
            best = better(keywords(value[2]))
        elif kind == re._constants.BRANCH:
            each = [keywords(x) for x in value[1]]
            best = better(tuple(k for x in each for k in x)) if all(each) else best
    best = better((run,))
    return best if min(map(len, best), default=0) else ()


def rules() -> list[Rule]:
    """The base phrases, then all rules by priority."""
    out = [Rule(label, (f" {phrase} ",), re.compile(rf"(?= {phrase} )".encode()), BASE_PRIORITY, BASE_SURE, len(phrase) + 1) for phrase, label in BASE.items()]
    for line in RULES.strip().split("\n"):
        label, priority, sure, pattern = line.split(" | ")
        whole = f" {pattern.replace('_', ' ?')}(?= )"
        out.append(Rule(label, keywords(re._parser.parse(whole)), re.compile(whole.encode()), int(priority), float(sure)))
    return sorted(out, key=lambda r: -r.priority)


WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else (c + 32 if 65 <= c <= 90 else 32) for c in range(256))


def words_line(raw: bytes) -> bytes:
    """The words with a space around each."""
    words = raw.translate(WORD_BYTES).split()
    return b" " + b" ".join(words) + b" " if words else b""


class Intervals:
    """Intervals of which none lies within another, in order: of those that do, only the wider one is asked for."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def hold(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.starts, start) - 1
        return at >= 0 and self.ends[at] >= end

    def add(self, start: int, end: int) -> None:
        if self.hold(start, end):
            return
        i, j = bisect.bisect_left(self.starts, start), bisect.bisect_right(self.ends, end)
        self.starts[i : max(i, j)], self.ends[i : max(i, j)] = [start], [end]


class Scanner:
    def __init__(self) -> None:
        self.rules = rules()
        self.always = [k for k, r in enumerate(self.rules) if not r.keywords]
        self.automaton = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for k, r in enumerate(self.rules):
            for word in r.keywords:
                by.setdefault(word, []).append(k)
        for word, numbers in by.items():
            self.automaton.add_word(word, numbers)
        self.automaton.make_automaton()

    def detections(self, line: bytes) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) in the line, without those suppressed."""
        asked = set(self.always)
        for _, numbers in self.automaton.iter(line.decode("latin-1")):
            asked.update(numbers)
        found = []
        for rule in map(self.rules.__getitem__, sorted(asked)):
            found += [(m.start(), m.start() + rule.size if rule.size else m.end(), rule) for m in rule.pattern.finditer(line)]
        kept: list[tuple[int, int, Rule]] = []
        taken = Intervals()
        for start, end, rule in sorted(found, key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label)):
            if rule.priority == BASE_PRIORITY or not taken.hold(start, end):
                kept.append((start, end, rule))
                taken.add(start, end)
        return kept


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all by default) and ``found``: words, base places, labels, score, detections."""
    held = carried(docs, carry, ["found"])
    inner = held.inner
    detection = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("priority", T.IntegerType())])
    found = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
        + [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("detections", T.ArrayType(detection))]
    )
    schema = T.StructType([*docs.select(*held.columns).schema.fields, T.StructField("found", found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        scanner, kind = Scanner(), to_arrow_type(found)
        for batch in batches:
            data, at = text_bytes(batch.column(batch.num_columns - 1))
            raw, rows = data.tobytes(), []
            for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
                line = words_line(raw[a:b])
                kept = scanner.detections(line)
                spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) if kept else np.zeros(0, np.int64)
                first, after = (np.searchsorted(spaces, [x[k] for x in kept]).tolist() for k in (0, 1))  # a word starts after each space
                base = [(w, r.label) for w, (_, _, r) in zip(first, kept, strict=True) if r.priority == BASE_PRIORITY]
                rows.append(
                    {
                        "n_words": max(0, line.count(b" ") - 1), "n_base": len(base), "first_word": min((x for x, _ in base), default=None), "last_word": max((x for x, _ in base), default=None),
                        "base_labels": ",".join(sorted({x for _, x in base})), "labels": ",".join(sorted({r.label for _, _, r in kept})), "score": max((r.sure for _, _, r in kept), default=0.0),
                        "detections": [{"label": r.label, "first_word": w, "n_words": x - w, "priority": r.priority} for w, x, (_, _, r) in zip(first, after, kept, strict=True)],
                    }
                )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], [*inner, "found"])

    return docs.select(*held.columns, source(docs, text).cast("string").alias("text_read")).mapInArrow(run, schema).toDF(*held.names, "found")
