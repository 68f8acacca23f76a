"""Content addresses and deterministic draws."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def canonical_json(value: Any) -> str:
    """Names in order, no white space; numbers that aren't finite are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_hash(value: Any) -> str:
    """The first 16 hex digits of SHA-256 of the canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:16]


def canonical_record(record_id: Column, **fields: Column) -> Column:
    """The canonical JSON of a record, ``{"fields":{...},"id":...}``, where null fields are missing ones."""
    body = F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items()))))
    return F.concat(F.lit('{"fields":'), body, F.lit(',"id":'), F.regexp_replace(F.to_json(F.array(record_id.cast("string"))), r"^\[|\]$", ""), F.lit("}"))


def record_digest(record_id: Column, **fields: Column) -> Column:
    """Hash of the id and the fields by name; a null field is a missing one."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), c.cast("string"))) for n, c in sorted(fields.items())]
    return short_hash(F.concat_ws("\x1f", F.concat(F.lit("id="), record_id.cast("string")), *parts))


def result_key(run: Column, source_id: Column, source_hash: Column) -> Column:
    return short_hash(F.concat_ws("|", run, source_id.cast("string"), source_hash))


def draw(salt: str, record_id: Column) -> Column:
    """A uniform number in [0, 1) that depends on salt and id only."""
    digest = F.sha2(F.concat(F.lit(salt + "\x00"), record_id.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


def partition_of(draw_value: Column, shares: dict[str, float]) -> Column:
    """The name whose range of cumulative shares holds the draw."""
    out, upto = None, 0.0
    for name, share in shares.items():
        upto += share
        here = draw_value < upto
        out = F.when(here, name) if out is None else out.when(here, name)
    return out.otherwise(list(shares)[-1])
