"""Personal data by weak supervision: labelers vote on candidate spans, and what they agree on trains a span classifier.

Candidates are wider than what is reported for sure: addresses, written-out addresses (``name (at) host (dot) org``),
dotted and colon-separated numbers, runs of 13 to 19 digits, national numbers, and credentials. Five labelers vote
for, against or not at all on each: the strict pattern of its kind, a gazetteer (top-level domains, issuers, calling
codes, key prefixes), the words before it, the characters at its edges, and its inner form. Expectation-maximisation
over the counts of vote patterns (at most 3^5 of a kind, whatever the corpus holds) gives each labeler's chances to
vote either way on true and false spans of a kind, and each pattern's chance to be true. A logistic classifier over
hashed features of a span and its surroundings is fitted to those chances, on at most ``most`` distinct feature rows of a kind
(those of the smallest hashes), weighted by how often they occur; it decides on all candidates.

The ``base`` spans (exact rules of four kinds) always stay; the classifier adds others where they overlap neither a
base span nor an added one of a higher chance. All work is linear in a text's length, runs of one character included.

A null text is an empty one and has no spans; very long texts are taken whole; repeated rows give equal rows; an
empty table gives none, and a kind without candidates adds none. Ties in the chance go to the span that starts first.
Columns to carry may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import give_back
from .names import carried, named
from .scratch import Scratch

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELERS = ("pattern", "gazetteer", "context", "edges", "form")
#: Characters of surroundings that labelers and features look at, bytes of text read at once, and hashed features of a kind.
AROUND, BLOCK_BYTES, FEATURES = 48, 1 << 23, 1 << 12

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AT = re.compile(r" ?[(\[{] ?at ?[)\]}] ?", re.I)
WRITTEN_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[A-Za-z0-9-]{1,63}){1,5}", re.I)
COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
CALLED = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])")
GROUPED = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z])")
ASSIGNED = re.compile(r"[:=][ \t]{0,3}[\"']?([^\s\"'=:]{6,200})")
TOKEN = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_-]{16,200}(?![A-Za-z0-9_-])")
WORD = re.compile(r"[^\W_]+")

# Gazetteers and context words.
DOMAINS = frozenset("com org net edu gov mil int info biz io ai app dev eu de fr es it uk us ca au ch at nl be pl pt br mx ar cl jp cn in ru se no fi dk ie cz gr hu ro tr kr za nz".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "380", "420", "421")
ISSUERS = re.compile(r"4|5[1-5]|2(?:2[2-9]|[3-6]|7[01]|720)|3[47]|3[0689]|35|6(?:011|4[4-9]|5)|62")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ")
CONTEXT = {
    "email": "mail email e-mail contact kontakt contacto courriel correo write schreiben escribir adresse address reply from to cc",
    "ip": "ip ipv4 ipv6 host server address adresse dirección client login gateway router ping dns from",
    "card": "card visa mastercard amex credit debit kreditkarte karte carte tarjeta pay payment paid account",
    "phone": "phone tel telephone telefon téléphone teléfono mobile cell handy móvil portable call fax contact whatsapp anrufen appelez llame",
    "secret": "password passwd pwd passwort secret token key apikey api_key access credential contraseña clave passe bearer auth",
}
AGAINST = {
    "email": "", "ip": "version release build section firmware v", "card": "order invoice isbn tracking serial id ticket commit sha rechnung factura facture bestellung",
    "phone": "order invoice isbn version page pages pp serial id no nr date datum fecha am vom", "secret": "sha sha1 sha256 md5 commit checksum hash digest isbn doi uuid version",
}
CONTEXT, AGAINST = ({k: frozenset(v.split()) for k, v in d.items()} for d in (CONTEXT, AGAINST))
CANDIDATES = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("votes", T.IntegerType()), T.StructField("features", T.BinaryType())]))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(int("0246813579"[int(d)]) for d in digits[-2::-2])
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(filter(str.isdigit, s)) if len(s) <= 64 else re.sub("[^0-9]", "", s)


def byte_parts(s: str) -> bool:
    """Whether all parts of a dotted number are at most 255."""
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in s.split(".")))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from one @ to the next."""
    end, at = 0, text.find("@")
    while at >= 0:
        host, start = HOST.match(text, at + 1), at
        if host:
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = host.end()
                yield start, end
        at = text.find("@", max(at + 1, end))


def matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """Kind, start, end of each match of a base pattern, and whether it also meets the kind's condition."""
    for a, b in addresses(text):
        yield 0, a, b, True
    for m in IP.finditer(text):
        yield 1, *m.span(), byte_parts(m.group())
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13:
            digits = only_digits(m.group())
            if 13 <= len(digits) <= 19:
                yield 2, *m.span(), len(digits) >= 16 and luhn(digits)
            if len(digits) > 19:  # numbers side by side are one match of the pattern; each is a candidate
                for own in GROUPED.finditer(text, *m.span()):
                    yield 2, *own.span(), False
    for m in PHONE.finditer(text):
        digits = len(only_digits(m.group()))
        yield 3, *m.span(), 8 <= digits <= 15
        own = CALLED.match(text, m.start()) if digits > 15 else None
        if own:
            yield 3, *own.span(), False


def wider(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """Further candidates, as ``matches`` gives them: the last tells whether the strict pattern of a further form holds."""
    for m in AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in LOCAL and m.start() - start < 64:
            start -= 1
        host = WRITTEN_HOST.match(text, m.end())
        if start < m.start() and host:
            yield 0, start, host.end(), True
    last = 0
    for m in COLONS.finditer(text):
        if m.start() < last:
            continue
        start = end = m.start()
        while start > max(last, m.start() - 4) and text[start - 1] in "0123456789abcdefABCDEF":
            start -= 1
        while end < len(text) and end - start <= 45 and text[end] in "0123456789abcdefABCDEF:":
            end += 1
        last, groups = end, text[start:end].split(":")
        yield 1, start, end, all(len(g) <= 4 for g in groups) and (len(groups) == 8 and "" not in groups or "::" in text[start:end] and len(groups) <= 8 and any(groups))
    for m in NATIONAL.finditer(text):
        digits = len(only_digits(m.group()))
        if 7 <= digits <= 12:
            yield 3, *m.span(), "(" in m.group() and ")" in m.group() and digits >= 10
    for m in ASSIGNED.finditer(text):
        before = WORD.findall(text[max(0, m.start() - 24) : m.start()].lower())
        if before and before[-1] in CONTEXT["secret"]:
            yield 4, *m.span(1), True
    for m in TOKEN.finditer(text):
        s = m.group()
        if any(map(str.isdigit, s)) and any(map(str.isalpha, s)):
            yield 4, *m.span(), s.startswith(KEY_PREFIXES)


def spread(s: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def kind_of(c: str) -> str:
    return "" if not c else "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else " " if c.isspace() else c


def gazetteer(kind: int, s: str, digits: str) -> int:
    if kind == 0:
        return 1 if re.split(r"[^A-Za-z0-9-]+", s.rstrip(")]} "))[-1].lower() in DOMAINS else -1
    if kind == 1:
        return -1 if s.startswith(("0.", "1.0.", "2.0.", "3.0.")) else 0
    if kind == 2:
        return 1 if ISSUERS.match(digits) else -1
    if kind == 3:
        return (1 if digits.startswith(CALLING) else -1) if s.startswith("+") else 0
    return 1 if s.startswith(KEY_PREFIXES) else 0


def form(kind: int, s: str, digits: str) -> int:
    if kind == 0:
        return 1 if any(map(str.isalpha, s.split("@")[0][:64])) else -1
    if kind == 1:
        return 1 if len(s) >= 7 and len(set(s)) > 3 else -1
    if kind == 2:
        return -1 if len(set(digits)) < 4 else 1 if len(digits) == 16 and luhn(digits) else 0
    if kind == 3:
        return -1 if re.fullmatch(r"(?:19|20)\d\d[./ -]\d\d[./ -]\d\d|\d\d[./ -]\d\d[./ -](?:19|20)\d\d", s) or len(set(digits)) < 3 else 1 if re.search(r"\(\d+\) ?\d|\d[ .-]\d{3,4}[ .-]?\d{3,4}$", s) else 0
    mixed = any(map(str.isdigit, s)) and any(map(str.isalpha, s))
    return 1 if mixed and spread(s[:64]) >= 2.8 else -1


def candidate(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, bytes]:
    """The votes (digits to base 3: against, none, for) and the hashed features of a span."""
    name, s = KINDS[kind], text[start:end] if end - start <= 256 else text[start : start + 256]
    digits, before, after = only_digits(s), text[max(0, start - AROUND) : start], text[end : end + AROUND]
    words = WORD.findall(before.lower())[-4:]
    context = 1 if any(w in CONTEXT[name] for w in words) else -1 if any(w in AGAINST[name] for w in words) else 0
    edges = -1 if before[-1:].isalnum() or after[:1].isalnum() or before[-1:] in ("_", "/") or (after[:1] in (".", "-") and after[1:2].isdigit()) else 1
    votes = (1 if strict else -1, gazetteer(kind, s, digits), context, edges, form(kind, s, digits))
    shape = re.sub(r"(.)\1+", r"\1", "".join(map(kind_of, s[:64])))
    found = (
        f"strict{strict}", f"shape{shape}", f"digits{min(len(digits), 20)}", f"length{int(math.log2(end - start + 1) * 2)}", f"before{kind_of(before[-1:])}", f"after{kind_of(after[:1])}",
        f"word{words[-1] if words else ''}", f"second{words[-2] if len(words) > 1 else ''}", f"head{s[:2]}", f"spread{int(spread(s[:64]) * 2)}", f"context{context}", f"list{votes[1]}",
    )
    code = sum((v + 1) * 3**k for k, v in enumerate(votes))
    return code, np.array([xxhash.xxh32_intdigest(f, kind) % FEATURES for f in found], np.uint16).tobytes()


def found_in(text: str) -> tuple[list[list[tuple[int, int]]], list[dict]]:
    """The base spans of each kind, and all candidates."""
    base: list[list[tuple[int, int]]] = [[] for _ in BASE_KINDS]
    out: dict[tuple[int, int, int], bool] = {}
    for kind, a, b, strict in matches(text):
        out[kind, a, b] = strict
        if strict:
            base[kind].append((a, b))
    for kind, a, b, strict in wider(text):
        out[kind, a, b] = out.get((kind, a, b), False) or strict
    rows = []
    for (kind, a, b), strict in out.items():
        if kind in (2, 3) and not strict and b - a <= 40:
            digits = only_digits(text[a:b])
            strict = luhn(digits) and 13 <= len(digits) <= 19 if kind == 2 else text[a] == "+" and 8 <= len(digits) <= 15
        votes, features = candidate(text, kind, a, b, strict)
        rows.append({"kind": kind, "start": a, "end": b, "votes": votes, "features": features})
    return base, rows


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, own in zip(KINDS, spans, strict=False) for a, b in sorted(own))


def scan(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all by default), ``n_`` of each base kind, ``base`` (its spans) and ``candidates``."""
    counts = [f"n_{k}" for k in BASE_KINDS]
    own = carried(docs, carry, [*counts, "base", "candidates", "base_sha256", "spans"])
    rows = docs.select(*own.columns, named(text).cast("string").alias("t"))
    schema = T.StructType([*rows.drop("t").schema.fields, *(T.StructField(c, T.LongType()) for c in counts), T.StructField("base", T.StringType()), T.StructField("candidates", CANDIDATES)])
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("features", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, sizes = 0, np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + BLOCK_BYTES, "right")))
                part, i = batch.slice(i, j - i), j
                found = [found_in(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
                numbers = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in range(len(BASE_KINDS))]
                arrays = [*part.columns[:-1], *numbers, pa.array([joined(b) for b, _ in found], pa.string()), pa.array([c for _, c in found], kind)]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)
        give_back()

    found = rows.mapInArrow(run, schema)
    return found.select(*(F.col(i).alias(n) for i, n in zip(own.inner, own.names, strict=True)), *counts, "base", "candidates")


@dataclass(frozen=True)
class Model:
    """Of each kind: the share of true candidates, ``chances[labeler, vote, true]`` and the classifier's weights (bias last)."""

    prior: np.ndarray
    chances: np.ndarray
    weights: np.ndarray

    def chance(self, kind: np.ndarray, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[kind[:, None], features].sum(axis=1) + self.weights[kind, -1], -30, 30)))


def unpack(votes: np.ndarray) -> np.ndarray:
    return votes[:, None] // 3 ** np.arange(len(LABELERS)) % 3


def maximised(votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """The share of true spans, each labeler's chances and each pattern's chance to be true, by expectation-maximisation.

    It starts from the majority, and a few pseudo-counts say that labelers are rather right, so that true stays true.
    """
    true = 1 / (1 + np.exp(-(votes - 1).sum(axis=1).astype(float)))
    held = np.array([[3.0, 1.0], [2.0, 2.0], [1.0, 3.0]])  # of votes against, none, for: on false and on true spans
    prior, chances = 0.5, np.zeros((votes.shape[1], 3, 2))
    for _ in range(rounds):
        both = np.stack([1 - true, true], axis=1) * n[:, None]
        prior = (both[:, 1].sum() + 1) / (n.sum() + 2)
        for k in range(votes.shape[1]):
            own = held + np.stack([both[votes[:, k] == v].sum(axis=0) for v in range(3)])
            chances[k] = own / own.sum(axis=0)
        log = np.log([1 - prior, prior]) + sum(np.log(chances[k][votes[:, k]]) for k in range(votes.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - true).max(initial=0) < 1e-9:
            break
        true = new
    return prior, chances, true


def fitted(features: np.ndarray, true: np.ndarray, n: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic classifier fitted to chances, by steps with a memory of past gradients; a small penalty keeps them bounded."""
    weights, memory = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    share = np.minimum(n, 100) / np.minimum(n, 100).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(weights[features].sum(axis=1) + weights[-1], -30, 30)))
        miss = (p - true) * share
        step = np.append(np.bincount(features.ravel(), np.repeat(miss, features.shape[1]), FEATURES), miss.sum()) + 1e-5 * weights
        memory += step**2
        weights -= 0.3 * step / np.sqrt(memory)
    return weights


def fit(found: DataFrame, most: int = 20_000) -> Model:
    """The model of the ``candidates`` of ``scan``. ``most`` bounds the distinct feature rows of a kind that the classifier is fitted on."""
    spans = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    kinds, size = len(KINDS), len(LABELERS)
    prior, chances, weights = np.full(kinds, 0.5), np.full((kinds, size, 3, 2), 1 / 3), np.zeros((kinds, FEATURES + 1))
    patterns = np.array([tuple(r) for r in spans.groupBy("kind", "votes").count().collect()], np.int64).reshape(-1, 3)  # 5 * 3^5 rows at most
    rows = spans.groupBy("kind", "votes", "features").count()
    for kind in np.unique(patterns[:, 0]).tolist():
        own = patterns[patterns[:, 0] == kind]
        prior[kind], chances[kind], true = maximised(unpack(own[:, 1]), own[:, 2].astype(float))
        known = dict(zip(own[:, 1].tolist(), true.tolist(), strict=True))
        some = rows.where(F.col("kind") == kind).orderBy(F.xxhash64("features", "votes"), "features", "votes").limit(most).select("votes", "features", "count").collect()
        features = np.frombuffer(b"".join(r.features for r in some), np.uint16).reshape(len(some), -1).astype(np.int64)
        weights[kind] = fitted(features, np.array([known[r.votes] for r in some]), np.array([r["count"] for r in some], float))
    return Model(prior, chances, weights)


def without_overlaps(base: list[list[tuple[int, int]]], added: list[tuple[float, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Base spans, and of the added (chance, kind, start, end) the likeliest that overlap nothing kept before."""
    from bisect import bisect_left, insort

    spans = [list(own) for own in base] + [[] for _ in KINDS[len(base) :]]
    taken: list[tuple[int, int]] = []  # disjoint, in order: base spans of different kinds may overlap and are merged
    for a, b in sorted(s for own in base for s in own):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(b, taken[-1][1])
        else:
            taken.append((a, b))
    for _, kind, a, b in sorted(added, key=lambda x: (-x[0], x[2], x[3], x[1])):
        k = bisect_left(taken, (a, b))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
            insort(taken, (a, b))
            spans[kind].append((a, b))
    return spans


def classify(found: DataFrame, model: Model) -> DataFrame:
    """``found`` of ``scan`` with ``base_sha256`` and ``spans`` (all spans: base ones and those that the classifier adds)."""
    keep = [c for c in found.columns if c not in ("base", "candidates")]
    inner = found.select(*(named(c).alias(f"c{k}") for k, c in enumerate(keep)), "base", "candidates")
    schema = T.StructType([*inner.drop("base", "candidates").schema.fields, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, listed = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)
            flat, counts = pa.compute.list_flatten(listed), np.diff(listed.offsets.to_numpy())
            kind, start, end = (flat.field(c).to_numpy() for c in ("kind", "start", "end"))
            chance = np.zeros(0)
            if len(flat):
                chance = model.chance(kind.astype(np.int64), np.frombuffer(b"".join(flat.field("features").to_pylist()), np.uint16).reshape(len(flat), -1).astype(np.int64))
            at, out = 0, []
            for text, n in zip(base, counts.tolist(), strict=True):
                own, at = slice(at, at + n), at + n
                spans: list[list[tuple[int, int]]] = [[] for _ in BASE_KINDS]
                for part in filter(None, text.split(",")):
                    name, a, b = part.split(":")
                    spans[BASE_KINDS.index(name)].append((int(a), int(b)))
                known = {(k, a, b) for k, some in enumerate(spans) for a, b in some}
                rows = [x for x in zip(chance[own].tolist(), kind[own].tolist(), start[own].tolist(), end[own].tolist(), strict=True) if x[0] >= 0.5 and x[1:] not in known]
                out.append(joined(without_overlaps(spans, rows)) if rows else text)
            digests = [hashlib.sha256(text.encode()).hexdigest() for text in base]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(digests, pa.string()), pa.array(out, pa.string())], schema.names)
        give_back()

    scored = inner.mapInArrow(run, schema)
    return scored.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(keep)), "base_sha256", "spans")


def find_personal_data(docs: DataFrame, text: str = "text", carry: list[str] | None = None, most: int = 20_000) -> DataFrame:
    """The ``carry`` columns (all by default), ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256`` and ``spans``
    (``kind:start:end`` in code points, by kind and start) of each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "personal_data")
    found = scratch.save(scan(docs, text, carry), "found")
    return classify(found, fit(found, most))
