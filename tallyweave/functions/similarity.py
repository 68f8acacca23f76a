"""Similarity of names by matching blocks, which no built-in function gives."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters of matching blocks over all characters; null where either text is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """The larger of the block ratio of the texts' singular keys and the Jaccard index of their words; 0 where one is empty."""
    x, y = tx.singular_key(a), tx.singular_key(b)
    words = lambda c: F.array_distinct(F.split(c, " "))
    return F.when((x == "") | (y == ""), 0.0).otherwise(F.greatest(block_ratio(x, y), tx.jaccard(words(x), words(y))))
