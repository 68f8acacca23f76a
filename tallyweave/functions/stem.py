"""English stems by the published Porter 2 rules, and letters without their accents."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

# Fixed values of the published algorithm.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
IRREGULAR |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
FINISHED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

VOWEL = "[aeiouy]"
SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
REGION = re.compile(r"[aeiouy][^aeiouy]")
SPECIAL = re.compile(r"gener|commun|arsen")


def ending(word: str, suffixes) -> str:
    """The longest of the suffixes that the word has."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.removeprefix("'"))
    special = SPECIAL.match(w)
    first = REGION.search(w)
    r1 = special.end() if special else first.end() if first else len(w)
    second = REGION.search(w, r1)
    r2 = second.end() if second else len(w)
    inside = lambda s, region: len(w) - len(s) >= region
    w = w[: len(w) - len(ending(w, ("'", "'s", "'s'")))]
    s = ending(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and re.search(VOWEL, w[:-2]):
        w = w[:-1]
    if w in FINISHED:
        return w
    s = ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s.startswith("eed"):
        if inside(s, r1):
            w = w[: len(w) - len(s)] + "ee"
    elif s and re.search(VOWEL, w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif len(w) <= r1 and SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    s = ending(w, SECOND)
    if s and inside(s, r1) and not (s == "ogi" and not w.endswith("logi")) and not (s == "li" and w[-3] not in "cdeghkmnrt"):
        w = w[: len(w) - len(s)] + SECOND[s]
    s = ending(w, THIRD)
    if s and inside(s, r1) and not (s == "ative" and not inside(s, r2)):
        w = w[: len(w) - len(s)] + THIRD[s]
    s = ending(w, FOURTH)
    if s and inside(s, r2) and not (s == "ion" and w[-4] not in "st"):
        w = w[: len(w) - len(s)]
    if w.endswith("e") and (inside("e", r2) or (inside("e", r1) and not SHORT.search(w[:-1]))) or w.endswith("ll") and inside("l", r2):
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """The stem of each word of an array."""
    return words.map(lambda row: None if row is None else [stem(w) for w in row])


def unaccented(text: Column) -> Column:
    """Latin letters without their accents."""
    pairs = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250))}
    pairs = {a: b for a, b in pairs.items() if a != b and b.isascii()}
    out = F.translate(text, "".join(pairs) + "øØđĐłŁ", "".join(pairs.values()) + "oOdDlL")
    for letter, plain in (("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")):
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def stemmed(text: Column) -> Column:
    """Tokens of a text without accents, as English stems."""
    return stems(tx.tokens(unaccented(text)))
