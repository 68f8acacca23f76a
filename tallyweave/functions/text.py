"""Text, key and vector functions, Column to Column: all stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a selector answers to abstain (in lower case), and the marks trimmed from a key.
ABSTAIN = ("", "null", "none", "nil", "no_match", "nomatch", "no match", "n/a", "na")
KEY_MARKS = " \t\r\n\"'`[]().,;:"
# Fixed value: names of parameters whose values are credentials.
SECRET = r"(?i)api[-_]?key|(^|[-_])key$|secret|passw|credential|authori[sz]ation|bearer|header|cookie|(^|[-_])token$"
# Fixed value: marks and words that a query parser would read as syntax.
SYNTAX = r"""(?U)[`+\-!(){}\[\]^"~*?:\\/]|(?<!\w)(?:AND|OR|NOT|IN)(?!\w)"""

WORD = r"[\p{L}\p{N}_]+"
#: Letters that case folding changes beyond lower case.
FOLDED = (("ß", "ss"), ("ς", "σ"), ("ſ", "s"), ("ŉ", "ʼn"), ("ǰ", "ǰ"), ("µ", "μ"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"))


def compositions() -> list[tuple[str, str]]:
    """A letter followed by one combining mark, and the one character that they are composed to; of two marks in either order."""
    out = []
    for code in range(0xC0, min(sys.maxunicode, 0x1FFF)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == chr(code):
            out.append((unicodedata.normalize("NFC", parts[:-1]) + parts[-1], chr(code)))
            other = unicodedata.normalize("NFC", parts[0] + parts[-1])
            if len(parts) == 3 and len(other) == 1:
                out.append((other + parts[1], chr(code)))
    return sorted(out, key=lambda x: x[1])


COMPOSED = compositions()


def composed(text: Column) -> Column:
    """Letters and combining marks as composed characters; only texts that hold a mark are looked through."""
    pairs = F.from_json(F.lit("[" + ",".join(f'{{"a":"{a}","b":"{b}"}}' for a, b in COMPOSED) + "]"), "array<struct<a: string, b: string>>")
    return F.when(F.regexp_like(text, F.lit(r"\p{M}")), F.aggregate(pairs, text, lambda out, x: F.replace(out, x.a, x.b))).otherwise(text)


def folded(text: Column) -> Column:
    """Case-folded text: lower case, and what folding changes beyond it."""
    out = F.lower(text)
    for letter, plain in FOLDED:
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.when(F.regexp_like(text, F.lit("[^\\x00-\\x7F]")), out).otherwise(F.lower(text))


def tokens(text: Column) -> Column:
    """Case-folded runs of letters and digits of any script and underscores, in order."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def exact_form(text: Column) -> Column:
    """Whole-string match form: composed, case-folded, single spaces; marks and accents are kept."""
    return collapse(folded(composed(text)))


def normalise_query(text: Column) -> Column:
    """The form in which queries are compared: lower case, single spaces."""
    return collapse(F.lower(text))


def order_key(text: Column) -> Column:
    """The form by which records are ordered: compatibility characters of ASCII replaced, case-folded, single spaces."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u00a0\u3000"
    return collapse(folded(composed(F.translate(text, wide, "".join(map(chr, range(0x21, 0x7F))) + "  "))))


def exact_forms(*fields: Column) -> Column:
    """Distinct exact forms of string fields and arrays of strings, blanks left out."""
    forms = F.transform(F.flatten(F.array(*fields)), lambda x: exact_form(F.coalesce(x, F.lit(""))))
    return F.array_distinct(F.filter(forms, lambda x: x != ""))


def rendered_queries(*queries: Column) -> Column:
    """A record's queries in order: tidied, without blanks and repeats."""
    return rendered_list(F.array(*queries))


def rendered_list(queries: Column) -> Column:
    """The same of an array of any number of queries; null is none."""
    listed = F.coalesce(queries.cast("array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(listed, lambda x: tidy(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def tidy(text: Column) -> Column:
    """One space for each run of blanks, lines stripped, blank lines dropped."""
    lines = F.transform(F.split(F.regexp_replace(text, r"[ \t]+", " "), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def sanitise_query(text: Column) -> Column:
    """Blanks for query-syntax marks and for bare operators in capitals."""
    return collapse(F.regexp_replace(text, SYNTAX, " "))


def match_key(text: Column) -> Column:
    """Lower-case letter-and-digit tokens with one space between."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def multivalue(cell: Column, separator: str) -> Column:
    """Stripped non-blank parts; a blank or null cell gives no part."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), separator), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def names(*fields: Column) -> Column:
    """Distinct non-blank names of string fields, in order."""
    return F.array_distinct(F.filter(F.transform(F.array(*fields), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def singular(token: Column) -> Column:
    """A token of over three letters without its plural: -ies is -y, a final s goes, -ss stays."""
    size = F.length(token)
    plain = F.when(token.endswith("ies"), F.concat(F.substring(token, F.lit(1), size - 3), F.lit("y"))).when(token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), size - 1)).otherwise(token)
    return F.when(size > 3, plain).otherwise(token)


def singular_key(text: Column) -> Column:
    """The match key with each of its tokens in the singular."""
    return F.array_join(F.transform(F.split(match_key(text), " "), singular), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 where either side has none."""
    both, shared = F.size(F.array_union(a, b)), F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / both)


def curie(uri: Column) -> Column:
    """``PREFIX:local`` of a PURL, else what follows ``#``, else the address itself."""
    purl = F.regexp_extract(uri, r"/obo/([A-Za-z]+)_([A-Za-z0-9]+)$", 1)
    local = F.regexp_extract(uri, r"/obo/([A-Za-z]+)_([A-Za-z0-9]+)$", 2)
    return F.when(purl != "", F.concat(purl, F.lit(":"), local)).when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(uri)


def is_secret_name(name: Column) -> Column:
    """Whether a parameter of this name may carry a credential; ``token`` counts as a whole word only."""
    return F.regexp_like(name, F.lit(SECRET))


def redact_url(url: Column) -> Column:
    """The address without user info and without parameters that may carry a credential; other texts are left as they are."""
    part = lambda k: F.regexp_extract(url, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", k)
    scheme, host, path, query, fragment = (part(k) for k in range(1, 6))
    bare = F.regexp_replace(host, r"^.*@", "")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    encode = lambda x: F.replace(F.replace(F.url_encode(decode(x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.filter(F.split(query, "&"), lambda x: (x != "") & ~is_secret_name(decode(F.substring_index(x, "=", 1))))
    kept = F.array_join(F.transform(pairs, lambda x: F.concat(encode(F.substring_index(x, "=", 1)), F.lit("="), encode(F.when(F.contains(x, F.lit("=")), F.substr(x, F.length(F.substring_index(x, "=", 1)) + 2)).otherwise("")))), "&")
    out = F.concat(F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when(bare != "", F.concat(F.lit("//"), F.lower(bare))).otherwise(""), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.when((scheme == "") & (host == ""), url).otherwise(out)


def candidate_key(place: Column, count: Column) -> Column:
    """C01, C02, ...: as many digits as the count has, at least two."""
    width = F.greatest(F.lit(2), F.length(count.cast("string")))
    return F.concat(F.lit("C"), F.lpad(place.cast("string"), width, F.lit("0")))


def clean_key(answer: Column) -> Column:
    """The answer without white space and marks at its ends."""
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return bare(F.btrim(bare(F.coalesce(answer, F.lit(""))), F.lit(KEY_MARKS)))


def resolve_key(answer: Column, issued: Column, legacy: bool = False) -> Column:
    """(id, resolution) of a selector's answer, given the map of issued keys in order.

    ``legacy`` also takes ids as they are, in other case, by what follows their last colon, or by rank; each
    such way is named, so that none counts as an exact key.
    """
    text = clean_key(answer)
    found = F.try_element_at(issued, F.upper(text))
    rules = [(F.lower(text).isin(*ABSTAIN), "abstain", F.lit(None).cast("string")), (found.isNotNull(), "exact_key", found)]
    if legacy:
        ids = F.map_values(issued)
        last = lambda test: F.try_element_at(F.filter(ids, test), F.lit(-1))
        rules += [
            (F.array_contains(ids, text), "legacy_exact_id", text),
            (last(lambda x: F.lower(x) == F.lower(text)).isNotNull(), "legacy_fuzzy", last(lambda x: F.lower(x) == F.lower(text))),
            (last(lambda x: F.substring_index(x, ":", -1) == text).isNotNull(), "legacy_fuzzy", last(lambda x: F.substring_index(x, ":", -1) == text)),
            (F.regexp_like(text, F.lit("^[0-9]{1,9}$")) & F.coalesce(text.try_cast("int").between(1, F.size(ids)), F.lit(False)), "legacy_rank", F.try_element_at(ids, text.try_cast("int"))),
        ]
    kind, out = F.lit("unresolved"), F.lit(None).cast("string")
    for when, name, value in reversed(rules):
        kind, out = F.when(when, name).otherwise(kind), F.when(when, value).otherwise(out)
    return F.struct(out.alias("id"), kind.alias("resolution"))


def component_differences(before: Column, after: Column) -> Column:
    """Names in two maps whose values differ, or that only one has, in order."""
    names_ = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    return F.filter(names_, lambda x: ~F.try_element_at(before, x).eqNullSafe(F.try_element_at(after, x)))


def is_valid_score(score: Column) -> Column:
    """A number from 0 to 1; NaN and null are not."""
    return F.coalesce(score.between(0.0, 1.0) & ~F.isnan(score), F.lit(False))


def confidence(answer: Column) -> Column:
    """The number of a JSON answer if it is one in [0, 1]; null for anything else, nothing is coerced or clamped."""
    value = F.try_parse_json(answer)
    number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
    return F.when(is_valid_score(number), number)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def named(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once a row, however often and in whichever loop it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unit(v: Column) -> Column:
    """The vector over its length; zero stays zero."""
    scaled = lambda v, size: F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))
    return named(v, lambda v: named(F.sqrt(dot(v, v)), lambda size: scaled(v, size)))


def shaped(v: Column, dimensions: int) -> Column:
    """The leading dimensions, normalised again."""
    return unit(F.slice(v, 1, dimensions))


def half(v: Column) -> Column:
    """The vector as half-precision numbers hold it (11 bits, ties to even); a number that isn't finite is refused."""
    def rounded(x):
        size = F.abs(x.cast("double"))
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(size, F.lit(2.0**-24)))) - 10, F.lit(-24)))
        near = F.bround(size / step) * step
        bad = x.isNull() | F.isnan(x) | (near >= 65520)
        return F.when(bad, F.raise_error(F.lit("a vector holds a number that half precision can't")).cast("double")).otherwise(F.when(x < 0, -near).otherwise(near))
    return F.transform(v, rounded)


def encoded_text(text: Column, vector: Column, dimensions: int) -> Column:
    """The vector of a text; zero for a blank one, which no encoder is asked about."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array_repeat(F.lit(0.0), dimensions)).otherwise(vector)


def template(fmt: str, **fields: Column) -> Column:
    """``{name}`` in a static template replaced by its field; null is empty, the result is tidied."""
    out, rest = [], fmt
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(head), F.coalesce(fields[name].cast("string"), F.lit(""))]
    return tidy(F.concat(*out, F.lit(rest)))
