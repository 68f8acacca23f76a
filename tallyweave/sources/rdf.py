"""Ontology classes from N-Triples and Turtle: triples as rows, gathered by subject with one shuffle.

N-Triples are read line by line, by as many tasks as there are splits, with built-in functions alone. Turtle is read by
splits as well, whose lines are joined to pieces. What a piece says depends on what is open where it starts (a statement,
a long string) and on the prefixes before it: a first step notes for each case what the piece ends with, a file's notes
(not its text) are then gone through in their order, and so each piece is known to be whole statements between a head
and a tail, which meet those of their neighbours. A task holds a batch of lines, a piece or a statement at a time, never
a file; a line and a statement are one cell each. Where a class has several labels, the first of the file counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import text as tx

# Public namespaces.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "obo": "http://purl.obolibrary.org/obo/",
    "oboInOwl": "http://www.geneontology.org/formats/oboInOwl#",
}
TRIPLE = "subject string, predicate string, object string, is_iri boolean"
RDF = NAMESPACES["rdf"]
#: Statements of a Turtle file whose triples a task sends on at once.
STATEMENTS = 2000
#: Characters of a piece of Turtle: of whole lines, so the last line of a piece may exceed them. Spark reads a row group of stored pieces at once, whose size in bytes is one after compression, so its rows are bounded.
PIECE, ROW_GROUP = 1 << 16, 64


def address(name: str, namespaces: dict[str, str] | None = None) -> str:
    """The address of ``prefix:local``; one without a known prefix is an address already."""
    prefix, _, local = name.partition(":")
    known = NAMESPACES | (namespaces or {})
    return known[prefix] + local if prefix in known else name


def unescaped(text: Column) -> Column:
    """Escapes of a literal as the characters they stand for. A pair of backslashes is one, whatever follows it."""
    odd = r"(?<=(?<!\\)(?:\\\\){0,64})\\"
    pieces = F.split(text, odd + r"U(?=[0-9A-Fa-f]{8})")
    code = lambda x: F.conv(F.substring(x, 1, 8), 16, 10).cast("long")
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.hex(n), 4, "0"))
    wide = lambda c: F.concat(unit(F.lit(0xD800) + F.floor((c - 0x10000) / 1024)), unit(F.lit(0xDC00) + F.pmod(c - 0x10000, F.lit(1024))))
    units = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), F.element_at(pieces, 1), lambda out, x: F.concat(out, F.when(code(x) < 0x10000, unit(code(x))).otherwise(wide(code(x))), F.substr(x, F.lit(9))))
    body = F.regexp_replace(F.regexp_replace(units, odd + "'", "'"), r'(?<=(?<!\\)(?:\\\\){0,64})"', r'\\"')
    read = F.from_json(F.concat(F.lit('{"s":"'), body, F.lit('"}')), "s string", {"mode": "FAILFAST", "allowUnquotedControlChars": "true"})
    return F.when(text.contains("\\"), read["s"]).otherwise(text)


def n_triples(spark: SparkSession, path: str) -> DataFrame:
    """``place`` and the triple of each line; blank lines and comments are left out, a broken line fails the read."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
    empty = (F.col("line") == "") | F.startswith("line", F.lit("#"))
    shape = r'^(<[^>]*>|_:\S+)\s*<([^>]*)>\s*(?:<([^>]*)>|(_:[^\s.]\S*?)|"((?:[^"\\]|\\.)*)"(?:@[A-Za-z0-9-]+|\s*\^\^\s*<[^>]*>)?)\s*\.\s*(?:#.*)?$'
    part = lambda n: F.regexp_extract("line", shape, n)
    good = F.regexp_like("line", F.lit(shape))
    subject = F.when(empty, None).when(good, F.regexp_replace(part(1), "^<|>$", "")).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.substring("line", 1, 200))))
    is_iri = F.regexp_like("line", F.lit(r'^(<[^>]*>|_:\S+)\s*<[^>]*>\s*<'))
    literal = ~is_iri & (part(4) == "")
    return lines.select("place", unescaped(subject).alias("subject"), unescaped(part(2)).alias("predicate"), F.when(is_iri, unescaped(part(3))).when(literal, unescaped(part(5))).otherwise(part(4)).alias("object"), is_iri.alias("is_iri")).where("subject is not null")


#: The rest of a long string after its opening quotes, or after a line in it.
CLOSE = {q: rf"(?:[^{q[0]}\\]++|\\.|{q[0]}{{1,2}}(?!{q[0]}))*+{q}" for q in ('"""', "'''")}
#: The kinds of tokens of Turtle, tried in this order. Only a long string goes over the end of a line.
KINDS = {
    "skip": r"\s+|\#[^\n]*",
    "long": "|".join(q + rest for q, rest in CLOSE.items()),
    "short": r"""(?!"{3}|'{3})(?:"(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\[^\n])*')""",
    "iri": r'<[^<>"\s]*>',
    "tag": r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*",
    "kind": r"\^\^",
    "number": r"[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)(?![\w:])",
    "blank": r"_:[\w](?:[\w.-]*[\w-])?",
    "name": r"(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[^\n])(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\[^\n])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[^\n]))?)?",
    "word": r"[A-Za-z]+",
    "mark": r"[.;,\[\]()]",
}
TOKEN = re.compile("|".join(f"(?P<{kind}>{shape})" for kind, shape in KINDS.items()), re.DOTALL)
#: Tokens up to the next mark that may end a statement.
REST = re.compile(f"(?:{'|'.join((KINDS | {'mark': r'[;,\[\]()]'}).values())})*+", re.DOTALL)
CLOSING = {q: re.compile(rest, re.DOTALL) for q, rest in CLOSE.items()}
DIRECTIVES = ("@prefix", "@base", "prefix", "base")
#: Stands for the tokens of a statement that is no directive.
OTHER = ("other", "")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
#: Characters that one letter stands for after a backslash.
LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def plain(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else LETTERS.get(m[3], m[3]), text)


def tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        found = TOKEN.match(text, at)
        if not found:
            raise ValueError(f"not Turtle: {text[at:at + 60]!r}")
        at = found.end()
        if found.lastgroup != "skip":
            yield found.lastgroup, found.group()


def resolved(base: str, iri: str) -> str:
    from urllib.parse import urljoin

    return urljoin(base, iri) if base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else iri


def is_directive(own: list) -> bool:
    return own[0][0] in ("tag", "word") and own[0][1].lower() in DIRECTIVES


def is_whole(own: list) -> bool:
    """Whether the last token ends the statement."""
    kind, token = own[-1]
    return (kind, token) == ("mark", ".") if not is_directive(own) or own[0][1][0] == "@" else kind == "iri"


def declared(own: list, base: str, known: dict[str, str]) -> tuple[str, dict[str, str]]:
    """The base and the prefixes after a directive."""
    names = "prefix" in own[0][1].lower()
    kinds = ["name"] * names + ["iri"] + ["mark"] * (own[0][1][0] == "@")
    if [k for k, _ in own[1:]] != kinds or names and not own[1][1].endswith(":"):
        raise ValueError(f"not Turtle: {' '.join(t for _, t in own)[:60]!r}")
    iri = resolved(base, plain(own[1 + names][1][1:-1]))
    return (base, known | {own[1][1][:-1]: iri}) if names else (iri, known)


def walked(text: str, at: int, known: dict | None = None) -> tuple[dict[int, list | None], list, str]:
    """From inside a statement on: where statements end (with the tokens of directives), what is open after the last one, and the quotes of an open long string. Stops at an end that is among the ``known``."""
    ends, own = {}, [OTHER]
    while at < len(text):
        if own and not is_directive(own):
            at = REST.match(text, at).end()
        found = TOKEN.match(text, at)
        if not found:
            if text[at:at + 3] in CLOSING:
                return ends, own or [OTHER], text[at:at + 3]
            own, at = own or [OTHER], at + 1  # a start inside of a string was supposed wrongly, or reading this will fail
            continue
        at = found.end()
        if found.lastgroup == "skip":
            continue
        own.append((found.lastgroup, found.group()))
        if is_whole(own):
            ends[at], own = own if is_directive(own) else None, []
            if known and at in known:
                break
        elif not is_directive(own) or len(own) > 4:
            own = [OTHER]
    return ends, own, ""


def opening(text: str) -> tuple[list, bool]:
    """The first tokens, and where each ends, as far as they may be of directives; and whether others follow before a statement's end."""
    out, at = [], 0
    while at < len(text):
        found = TOKEN.match(text, at)
        if found and found.lastgroup != "skip":
            kind, token = found.lastgroup, found.group()
            if kind not in ("tag", "iri", "name") and token != "." and not (kind == "word" and token.lower() in DIRECTIVES):
                return out, True
            out.append((kind, token, found.end()))
            if token == ".":
                return out, False
        elif not found:
            return out, True
        at = found.end()
    return out, False


def noted(text: str) -> str:
    """What a piece of Turtle does, for each of the quotes of a long string that may be open before it (JSON)."""

    def note(ends, own, quote, words=(), others=True):
        places = list(ends)
        return {"first": places[0] if places else -1, "last": places[-1] if places else -1, "found": [ends[at] for at in places[1:] if ends[at]], "own": own, "quote": quote, "words": words, "others": others}

    ends, own, quote = walked(text, 0)
    out = {"": note(ends, own, quote, *opening(text))}
    for q, closing in CLOSING.items():
        closed = closing.match(text)
        if not closed:
            out[q] = note({}, [OTHER], q)
            continue
        inner = walked(text, closed.end(), ends)
        met = next(reversed(inner[0]), None)
        if met in ends:
            inner = ({at: x for at, x in inner[0].items()} | {at: x for at, x in ends.items() if at > met}, own, quote)
        out[q] = note(*inner)
    return json.dumps(out)


def pieces(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``file``, ``block`` (a split's first byte), ``number``, ``text``, ``notes``: lines of a split in their order, joined to pieces."""
    at, number, held, length = None, 0, [], 0

    def piece():
        text = "".join(held)
        return pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "number": number, "text": text, "notes": noted(text)}])

    for batch in batches:
        for file, block, line in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held and (length >= size or (file, block) != at):
                yield piece()
                number, held, length = number + 1, [], 0
            at = (file, block)
            held.append(line + "\n")
            length += len(line) + 1
    if held:
        yield piece()


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the pieces of files in their order: the place in the file, the prefixes after its head, where the statements end that are whole in it, and the place of the piece where its head began (none: no head)."""
    file, out = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["file"] != file:
                file, seq, began, quote, own, base, known = row["file"], 0, None, "", [], "", {}
            note = json.loads(row["notes"])[quote]
            ends, open_before, after = [], bool(own), None

            def ended(at):
                nonlocal base, known, own, after
                if is_directive(own):
                    base, known = declared(own, base, known)
                ends.append(at)
                after, own = after or (base, known), []

            if not own:
                after = (base, known)
            for kind, token, at in note["words"]:
                own.append((kind, token))
                if is_whole(own):
                    ended(at)
                elif not is_directive(own) or len(own) > 4:
                    own = [OTHER]
            if note["others"]:
                own = [OTHER]
                if note["first"] >= 0:
                    ended(note["first"])
            if note["first"] >= 0:
                for directive in note["found"]:
                    base, known = declared(directive, base, known)
                ends.append(note["last"])
                own = [tuple(x) for x in note["own"]]
            quote = note["quote"]
            head = (ends[0] if ends else -1) if open_before else 0
            out.append({k: row[k] for k in ("file", "block", "number")} | {"seq": seq, "prefixes": json.dumps(after or (base, known)), "head": head, "last": ends[-1] if ends else head, "began": began if open_before else None, "opens": bool(own) and head >= 0})
            if own and head >= 0:
                began = seq
            seq += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, PLACES)
            out = []


PLACES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("seq", pa.int64()), ("prefixes", pa.string()), ("head", pa.int64()), ("last", pa.int64()), ("began", pa.int64()), ("opens", pa.bool_())])


class Statement:
    """The triples of one statement; blank nodes without a name are named by the statement."""

    def __init__(self, own: list, base: str, known: dict[str, str], mark: str) -> None:
        self.own, self.at, self.base, self.known, self.mark, self.blanks, self.out = own, 0, base, known, mark, 0, []

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.own[self.at - 1]

    def peek(self) -> str:
        return self.own[self.at][1]

    def blank(self) -> str:
        self.blanks += 1
        return f"_:{self.mark}.{self.blanks}"

    def node(self) -> tuple[str, bool]:
        """The next term, and whether it is an address."""
        kind, token = self.take()
        if kind == "iri":
            return resolved(self.base, plain(token[1:-1])), True
        if kind == "name":
            prefix, _, local = token.partition(":")
            return self.known[prefix] + re.sub(r"\\(.)", r"\1", local), True
        if kind in ("long", "short"):
            cut = 3 if kind == "long" else 1
            if self.own[self.at][0] == "tag":
                self.take()
            elif self.own[self.at][0] == "kind":
                self.at += 2
            return plain(token[cut:-cut]), False
        if token == "[":
            name = self.blank()
            if self.peek() != "]":
                self.predicates(name)
            self.take()
            return name, False
        if token == "(":
            items = []
            while self.peek() != ")":
                items.append(self.node())
            self.take()
            names = [self.blank() for _ in items]
            for i, item in enumerate(items):
                self.out.append((names[i], RDF + "first", *item))
                self.out.append((names[i], RDF + "rest", names[i + 1] if i + 1 < len(items) else RDF + "nil", i + 1 == len(items)))
            return (names[0], False) if items else (RDF + "nil", True)
        if kind in ("number", "blank") or token in ("true", "false"):
            return token, False
        raise ValueError(f"not Turtle: {token!r}")

    def predicates(self, subject: str) -> None:
        while True:
            if tuple(self.own[self.at]) == ("word", "a"):
                self.take()
                predicate = RDF + "type"
            else:
                predicate = self.node()[0]
            while True:
                place = len(self.out)
                value = self.node()
                self.out.insert(place, (subject, predicate, *value))
                if self.peek() != ",":
                    break
                self.take()
            while self.peek() == ";":
                self.take()
            if self.peek() in (".", "]"):
                return

    def triples(self) -> list[tuple]:
        subject, _ = self.node()
        if self.peek() != ".":
            self.predicates(subject)
        return self.out


def read_statements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triples of texts that are whole statements, each with the prefixes before it."""
    out = []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out, strict=True), TRIPLES, strict=True)], schema=TRIPLES)

    for batch in batches:
        for i in range(batch.num_rows):
            file, unit, prefixes, text = (column[i].as_py() for column in batch.columns)
            (base, known), own, number = json.loads(prefixes), [], 0
            for kind, token in tokens(text):
                own.append((kind, token))
                if not is_whole(own):
                    continue
                if is_directive(own):
                    base, known = declared(own, base, known)
                else:
                    out.extend((file, unit, number, at, *triple) for at, triple in enumerate(Statement(own, base, known, f"{file}.{unit}.{number}").triples()))
                    number += 1
                    if number % STATEMENTS == 0 and out:
                        yield rows()
                        out = []
                own = []
            if own:
                raise ValueError(f"{file}: the last statement has no end")
            if out:
                yield rows()
                out = []


TRIPLES = pa.schema([("file", pa.string()), ("unit", pa.int64()), ("number", pa.int64()), ("at", pa.int64()), ("subject", pa.string()), ("predicate", pa.string()), ("object", pa.string()), ("is_iri", pa.bool_())])


def turtle(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """``place`` and each triple of Turtle files; broken Turtle and unknown prefixes fail the read. The pieces are written before, with their places."""
    lines = spark.read.text(path, lineSep="\n").select(F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("block"), "value")
    work = store.Work(spark, "turtle")
    cut = lines.mapInArrow(partial(pieces, piece), "file string, block long, number long, text string, notes string")
    cut.write.option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP).parquet(f"{work.root}/pieces")
    cut = spark.read.schema(cut.schema).parquet(f"{work.root}/pieces")
    notes = cut.drop("text").repartition("file").sortWithinPartitions("file", "block", "number")
    places = work.save(notes.mapInArrow(placed, "file string, block long, number long, seq long, prefixes string, head long, last long, began long, opens boolean"), "places")
    cut = cut.drop("notes").join(store.few(places), ["file", "block", "number"])
    part = lambda start, length: F.substring("text", start + 1, length)
    head, last = F.col("head"), F.col("last")
    whole = cut.where("last > head and head >= 0").select("file", (F.col("seq") * 2).alias("unit"), "prefixes", part(head, last - head).alias("text"))
    heads = cut.where("began is not null").select("file", F.col("began").alias("seq"), F.col("seq").alias("next"), "prefixes", F.when(head < 0, F.col("text")).otherwise(part(F.lit(0), head)).alias("text"))
    tails = cut.where("opens").select("file", "seq", F.col("seq").alias("next"), F.lit(None).cast("string").alias("prefixes"), F.substr("text", last + 1).alias("text"))
    over = heads.unionByName(tails).groupBy("file", "seq").agg(F.coalesce(F.max("prefixes"), F.lit('["", {}]')).alias("prefixes"), F.array_sort(F.collect_list(F.struct("next", "text"))).alias("parts"))
    joined = over.select("file", (F.col("seq") * 2 + 1).alias("unit"), "prefixes", F.array_join("parts.text", "").alias("text"))
    units = whole.unionByName(joined).repartition(spark.sparkContext.defaultParallelism, "file", "unit")
    rows = units.mapInArrow(read_statements, f"file string, unit long, number long, at long, {TRIPLE}")
    return rows.select(F.struct("file", "unit", "number", "at").alias("place"), "subject", "predicate", "object", "is_iri")


READERS = {"nt": n_triples, "turtle": turtle}


def classes(
    triples: DataFrame, id_prefix: str = "", include_obsolete: bool = False, label: str = "rdfs:label", synonyms: tuple[str, ...] = ("oboInOwl:hasExactSynonym",),
    definition: str = "obo:IAO_0000115", deprecated: str = "owl:deprecated", namespaces: dict[str, str] | None = None,
) -> DataFrame:
    """Classes that have an address, one row each, as ``owl_records`` gives them; triples of a class may be anywhere."""
    at = lambda name: address(name, namespaces)
    p, o = F.col("predicate"), F.trim("object")
    literal = ~F.col("is_iri") & (o != "")
    wanted = {at(n) for n in (label, *synonyms, definition, deprecated, "rdf:type", "rdfs:subClassOf")}
    first = lambda name: F.coalesce(F.min_by(F.when((p == at(name)) & literal, o), F.when((p == at(name)) & literal, F.col("place"))), F.lit(""))
    rows = triples.where(p.isin(*wanted) & ~F.startswith("subject", F.lit("_:"))).groupBy("subject").agg(
        F.bool_or((p == at("rdf:type")) & (o == at("owl:Class"))).alias("is_class"),
        first(label).alias("label"),
        F.array_sort(F.collect_set(F.when(p.isin(*map(at, synonyms)) & literal, o))).alias("synonyms"),
        first(definition).alias("definition"),
        F.array_sort(F.collect_set(F.when((p == at("rdfs:subClassOf")) & F.col("is_iri"), tx.curie(o)))).alias("parents"),
        F.lower(first(deprecated)).isin("true", "1").alias("obsolete"),
    )
    out = rows.where("is_class").select(tx.curie(F.col("subject")).alias("id"), "label", "synonyms", "definition", "parents", "obsolete").where(F.startswith("id", F.lit(id_prefix)))
    return out if include_obsolete else out.where("not obsolete")


def rdf_records(spark: SparkSession, path: str, syntax: str, **how) -> DataFrame:
    """Classes of ``nt`` or ``turtle`` files."""
    if syntax not in READERS:
        raise ValueError(f"unknown syntax {syntax!r}: {', '.join(READERS)}")
    return classes(READERS[syntax](spark, path), **how)
