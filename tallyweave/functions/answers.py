"""JSON objects in what a model said. All but the search for the first balanced object is built-in."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags of reasoning, the fence of a block, and the one repair, a trailing comma.
TAGS = "think|thinking|reasoning"
FENCE = r"(?is)```(?:json)?\s*(.*?)\s*```"
TRAILING_COMMA = r",(\s*[}\]])"

PIECE = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?$)|[{}]', re.DOTALL)


def without_reasoning(text: Column) -> Column:
    """What a model said outside of its reasoning, stripped.

    One walk over the tags: a tag that opens hides what follows until a tag of its name closes, or all the
    rest if none does; a tag that closes without having been opened hides all before it.
    """
    marked = F.split(F.regexp_replace(text, rf"(?i)<(/?)({TAGS})(?:\b[^>]*)?>", "\u0001$1$2\u0002"), "\u0001")

    def walk(state, piece):
        tag, said = F.lower(F.substring_index(piece, "\u0002", 1)), F.substring_index(piece, "\u0002", -1)
        closes, name = tag.startswith("/"), F.ltrim(tag, F.lit("/"))
        ends = closes & (state.within == name)
        lone = closes & (state.within == "")
        opens = ~closes & (state.within == "")
        out = F.when(lone, said).when(ends, F.concat(state.out, said)).otherwise(state.out)
        return F.struct(out.alias("out"), F.when(opens, name).when(ends | lone, F.lit("")).otherwise(state.within).alias("within"))

    first = F.struct(F.try_element_at(marked, F.lit(1)).alias("out"), F.lit("").alias("within"))
    said = F.aggregate(F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))), first, walk, lambda x: x.out)
    return F.when(text.isNotNull(), F.regexp_replace(said, r"^\s+|\s+$", ""))


@F.pandas_udf(T.StringType())
def balanced_object(text: pd.Series) -> pd.Series:
    """The first run from an opening brace to its closing one; braces in strings don't count."""

    def find(value: str | None) -> str | None:
        depth = begin = 0
        for piece in PIECE.finditer(value or ""):
            if piece[0] == "{":
                begin, depth = (piece.start() if not depth else begin), depth + 1
            elif piece[0] == "}" and depth:
                depth -= 1
                if not depth:
                    return value[begin : piece.end()]
        return None

    return text.map(find)


def whole_value(text: Column) -> Column:
    """The text as one JSON value; null where it holds none, or more. In an array, since the parser stops after a first value."""
    value = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(value, "$[1]", "variant").isNull(), F.try_variant_get(value, "$[0]", "variant"))


def decision(reply: Column, lowest: float = 0.0, highest: float = 1.0) -> Column:
    """(value, error) of a reply that must be an object whose ``value`` is a number within bounds: nothing is clamped or coerced."""
    whole = F.try_parse_json(json_object(reply))
    given = F.try_variant_get(whole, "$.value", "variant")
    number = F.when(F.schema_of_variant(given).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(given, "$", "double"))
    error = F.when(whole.isNull(), "not_an_object").when(given.isNull(), "missing").when(number.isNull(), "not_a_number").when(~number.between(lowest, highest), "out_of_bounds")
    return F.struct(F.when(error.isNull(), number).alias("value"), error.alias("error"))


def clean_list(items: Column, issued: Column | None = None) -> Column:
    """Strings of a JSON array, stripped, without blanks and repeats; with ``issued``, keys that were issued only, in capitals."""
    strings = F.transform(F.filter(F.from_json(items, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.trim(F.try_variant_get(x, "$", "string")))
    if issued is not None:
        strings = F.filter(F.transform(strings, F.upper), lambda x: F.array_contains(issued, x))
    return F.coalesce(F.array_distinct(F.filter(strings, lambda x: x != "")), F.array().cast("array<string>"))


def json_object(answer: Column) -> Column:
    """The answer's JSON object as text: the first of four readings that parses, if it is an object; else null."""
    whole = without_reasoning(answer)
    fenced = F.regexp_extract(whole, FENCE, 1)
    inner = balanced_object(F.when(F.regexp_like(whole, F.lit(FENCE)), fenced).otherwise(whole))
    repaired = [F.regexp_replace(x, TRAILING_COMMA, "$1") for x in (whole, inner)]
    value = F.coalesce(*(whole_value(x) for x in (whole, inner, *repaired)))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.to_json(value))
