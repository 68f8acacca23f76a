"""Collocations against counting in Python."""

import collections
import re

import numpy as np
import pytest

from tallyweave.llm import bytetext, collocations
from tallyweave.llm.collocations import Packing

DOCS = "doc_id long, text string, lang string, hash long, n long, `w.1` int, rank int"


def brute(docs, max_words, least, top):
    f, total = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in docs:
        lang, text = lang if lang is not None else "und", re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, max_words + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = collections.Counter()
    for (lang, p), a in found.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                held[lang, p[i : i + n]] = max(held[lang, p[i : i + n]], a)
    rows = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * held[lang, p] >= 50 * a:
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        rows[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(g, i, p.decode(), -a, left, right, total[g], -s) for g, own in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)}


@pytest.fixture(scope="module")
def docs():
    rng, out = np.random.default_rng(5), []
    vocabulary = ["the", "The", "of", "new", "york", "CITY", "été", "Été", "big", "a-b", "ö", "x" * 40, "rare"] + [f"r{i}" for i in range(300)]
    weights = np.array([30, 10, 20, 15, 15, 10, 5, 5, 8, 4, 4, 3, 1] + [0.2] * 300)
    for i in range(120):
        words = rng.choice(vocabulary, rng.integers(0, 120), p=weights / weights.sum())
        text = "".join(w + rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\x0b"], p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05]) for w in words)
        out.append((i, text + " new york city hall", ["en", None, "", "und", "fr"][i % 5], 1, 2, 3, 4))
    out += [(900, None, "en", 1, 1, 1, 1), (901, "", None, 1, 1, 1, 1), (902, " \t.,\n", "fr", 1, 1, 1, 1), (903, "z" * 300_000, "en", 1, 1, 1, 1), (904, "one two three four " * 20_000, "en", 1, 1, 1, 1)]
    return [*out, out[3], out[3], (None, "new york city " * 5, "en", None, None, None, None)]


def rows(df):
    return [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()]


@pytest.mark.parametrize(("max_words", "least", "top"), [(3, 10, 2000), (2, 3, 7), (4, 5, 50)])
def test_equals_counting(spark, docs, max_words, least, top):
    got = rows(collocations.collocations(spark.createDataFrame(docs, DOCS).repartition(4), max_words=max_words, least=least, top=top))
    assert len(got) == len(set(got)) and set(got) == brute(docs, max_words, least, top)


def test_without_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_WORDS", 3)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 1 << 12)
    got = rows(collocations.collocations(spark.createDataFrame(docs, DOCS).repartition(4)))
    assert set(got) == brute(docs, 3, 10, 2000)


def test_no_part_or_every_part_is_hot(spark, docs, monkeypatch):
    for hot in (1, 1 << 40):
        monkeypatch.setattr(collocations, "HOT", hot)
        assert set(rows(collocations.collocations(spark.createDataFrame(docs, DOCS)))) == brute(docs, 3, 10, 2000)


def test_wide_numbers_take_more_words(spark, docs, monkeypatch):
    monkeypatch.setattr(collocations, "Packing", lambda most, n: Packing(1 << 30, n))
    assert Packing(1 << 30, 3).columns == ["k0", "k1"] and Packing(37_000, 3).columns == ["k0"]
    assert set(rows(collocations.collocations(spark.createDataFrame(docs, DOCS)))) == brute(docs, 3, 10, 2000)


def test_words_of_one_hash_are_hashed_anew(spark, docs, monkeypatch):
    class Poor(bytetext.WordHash):
        def __init__(self, seed):
            super().__init__(seed)
            self.mask = np.uint64(0xFF) if seed == 11 else np.uint64(2**64 - 1)

        def spans(self, *args):
            return super().spans(*args) & self.mask

    monkeypatch.setattr(collocations, "WordHash", Poor)
    assert set(rows(collocations.collocations(spark.createDataFrame(docs, DOCS)))) == brute(docs, 3, 10, 2000)


def test_tables_without_words(spark, docs):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame(docs, DOCS).where("doc_id in (900, 901, 902)")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(spark.createDataFrame([], DOCS), max_words=1)
