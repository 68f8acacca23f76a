"""Sources of records and sinks of results. Every loader refuses blank and repeated ids when it is read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


NUMBER = "row number of the task"


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their number in their file, or in the part of it that one task reads."""
    return rows.withColumn(NUMBER, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1)


def checked_id(column: Column, what: str, known: bool = False) -> Column:
    """The id, stripped. A row without one fails the read, by its number where that is ``known``."""
    value = F.trim(column.cast("string"))
    row = F.concat(F.lit(f"{what}: row "), F.col(f"`{NUMBER}`").cast("string")) if known else F.lit(f"{what}: a row")
    return F.when(value != "", value).otherwise(F.raise_error(F.concat(row, F.lit(" has no id"))))


def csv_records(spark: SparkSession, path: str, id_column: str, delimiter: str = ",", multivalue: tuple[str, ...] = (), separator: str = r"\|", encoding: str = "UTF-8") -> DataFrame:
    """Records of a CSV or TSV file: strings, stripped; multi-value columns are arrays without blanks."""
    raw = spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', multiLine=True, inferSchema=False, encoding=encoding)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    fields = [(tx.multivalue(F.col(f"`{c}`"), separator) if c in multivalue else F.coalesce(F.trim(F.col(f"`{c}`")), F.lit(""))).alias(c) for c in raw.columns if c != id_column]
    return numbered(raw).select(checked_id(F.col(f"`{id_column}`"), path, known=True).alias("id"), *fields)


def jsonl_records(spark: SparkSession, path: str, id_field: str) -> DataFrame:
    """Records of a JSON-lines file with their JSON types; a broken line fails the read."""
    raw = spark.read.json(path, mode="FAILFAST")
    return numbered(raw).select(checked_id(F.col(id_field), path, known=True).alias("id"), *(c for c in raw.columns if c != id_field))


def sql_literal(value) -> str:
    """A value as SQL writes it."""
    if value is None or isinstance(value, bool):
        return {None: "NULL", True: "TRUE", False: "FALSE"}[value]
    return repr(value) if isinstance(value, int | float) else "'" + str(value).replace("'", "''") + "'"


def bound(query: str, params: dict) -> str:
    """The query with each ``:name`` outside of quotes as its value; a name without a value is an error."""
    pieces = re.split(r"('(?:[^']|'')*')", query)
    put = lambda text: re.sub(r"(?<![:\w]):([A-Za-z_]\w*)", lambda m: sql_literal(params[m[1]]), text)
    return "".join(p if k % 2 else put(p) for k, p in enumerate(pieces))


def sql_records(spark: SparkSession, url: str, query: str, id_column: str, multivalue: tuple[str, ...] = (), fetch: int = 1000, params: dict | None = None, **options: str) -> DataFrame:
    """Records of a JDBC query, streamed ``fetch`` rows at a time; null is an empty string."""
    raw = spark.read.format("jdbc").option("url", url).option("query", bound(query, params or {})).option("fetchsize", fetch).options(**options).load()
    fields = [tx.multivalue(F.col(c).cast("string"), r"\|").alias(c) if c in multivalue else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in raw.columns if c != id_column]
    return raw.select(checked_id(F.col(id_column), "query").alias("id"), *fields)


#: Cells of a histogram for each range that is wanted, how often a full cell is cut anew, and the share of a range's rows from which on it is.
CELLS, REFINED, FULL = 16, 8, 0.5


def key_ranges(ask: Callable[[str], list], table: str, key: str, parts: int) -> list[str]:
    """Predicates over a numeric ``key`` that cut ``table`` into ranges of about equal counts; rows without a key go with the first.

    ``ask`` runs a query in the database. Counts are by equal cells of the key; a cell with more than half a range's
    rows is cut into cells itself, so a dense part of a key doesn't make one large range.
    """
    low, high, total = ask(f"SELECT MIN({key}) AS a, MAX({key}) AS b, COUNT({key}) AS n FROM {table}")[0]
    if not total or low == high:
        return [f"{key} IS NOT NULL OR {key} IS NULL"]
    wanted, todo, cells = total / parts, [(float(low), float(high), 0)], []
    while todo:
        a, b, depth = todo.pop()
        width = (b - a) / (CELLS * parts if not depth else CELLS)
        # Whole numbers: a cell narrower than one can't be cut further.
        counted = ask(f"SELECT cell, COUNT(*) AS n FROM (SELECT CAST(FLOOR(({key} - {a!r}) / {width!r}) AS INTEGER) AS cell FROM {table} WHERE {key} >= {a!r} AND {key} {'<=' if b == float(high) else '<'} {b!r}) c GROUP BY cell")
        for cell, n in counted:
            left = a + cell * width
            if n > FULL * wanted and depth < REFINED and width > 1e-9 * max(1.0, abs(a), abs(b)):
                todo.append((left, min(left + width, b) if left + width < b or b != float(high) else b, depth + 1))
            else:
                cells.append((left, n))
    cells.sort()
    cuts, held = [], 0
    for left, n in cells:
        if held and held + n / 2 >= wanted * (len(cuts) + 1):
            cuts.append(left)
        held += n
    cuts = [c for c in dict.fromkeys(cuts) if c > float(low)]
    ends = [None, *cuts, None]
    spans = [[f"{key} >= {a!r}" if a is not None else "", f"{key} < {b!r}" if b is not None else ""] for a, b in zip(ends, ends[1:], strict=False)]
    out = [" AND ".join(filter(None, s)) or f"{key} IS NOT NULL" for s in spans]
    return [f"({out[0]}) OR {key} IS NULL", *out[1:]]


def sql_records_in_parts(spark: SparkSession, url: str, query: str, id_column: str, key: str, parts: int = 8, multivalue: tuple[str, ...] = (), fetch: int = 1000, params: dict | None = None, **options: str) -> DataFrame:
    """The same, read by a task for each range of a numeric column ``key`` of the query, of about equal counts."""
    table = f"({bound(query, params or {})}) q"
    reader = lambda: spark.read.option("fetchsize", fetch).options(**options)

    def ask(text: str) -> list:
        return [tuple(r) for r in reader().format("jdbc").option("url", url).option("query", text).load().collect()]

    raw = reader().jdbc(url, table, predicates=key_ranges(ask, table, key, parts), properties=options)
    fields = [tx.multivalue(F.col(c).cast("string"), r"\|").alias(c) if c in multivalue else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in raw.columns if c != id_column]
    return raw.select(checked_id(F.col(id_column), "query").alias("id"), *fields)


def obo_records(spark: SparkSession, path: str, id_prefix: str = "", include_obsolete: bool = False) -> DataFrame:
    """``[Term]`` stanzas of an OBO file, one row each."""
    stanza = spark.read.text(path, lineSep="\n[").select(F.concat(F.lit("["), F.ltrim(F.col("value"))).alias("value"))
    terms = stanza.where(F.regexp_like("value", F.lit(r"^\[+Term\]"))).select(F.split("value", "\n").alias("lines"))

    def tags(name: str) -> Column:
        own = F.filter("lines", lambda x: x.startswith(f"{name}:"))
        return F.transform(own, lambda x: F.trim(F.regexp_replace(F.substring_index(F.substr(x, F.lit(len(name) + 2)), " ! ", 1), r"\s+$", "")))

    quoted = lambda x: F.regexp_extract(x, r'"((?:[^"\\]|\\.)*)"', 1)
    one = lambda a: F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(""))
    out = terms.select(one(tags("id")).alias("id"), one(tags("name")).alias("label"), F.transform(tags("synonym"), quoted).alias("synonyms"), quoted(one(tags("def"))).alias("definition"), tags("is_a").alias("parents"), (one(tags("is_obsolete")) == "true").alias("obsolete"))
    out = out.where((F.col("id") != "") & F.col("id").startswith(id_prefix))
    return out if include_obsolete else out.where("not obsolete")


def owl_records(
    spark: SparkSession, path: str, id_prefix: str = "", include_obsolete: bool = False, label: str = "rdfs:label", synonyms: tuple[str, ...] = ("oboInOwl:hasExactSynonym",), definition: str = "obo:IAO_0000115", deprecated: str = "owl:deprecated",
) -> DataFrame:
    """``owl:Class`` elements of an RDF/XML file, one row each; predicates are named as the file's prefixes spell them."""
    plain = dict.fromkeys((label, *synonyms, definition, deprecated))
    schema = ", ".join(["`_rdf:about` string", "`rdfs:subClassOf` array<struct<`_rdf:resource`: string>>", *(f"`{p}` array<string>" for p in plain)])
    raw = spark.read.schema(schema).option("rowTag", "owl:Class").option("valueTag", "_VALUE").format("xml").load(path)
    none = F.array().cast("array<string>")
    all_of = lambda p: F.filter(F.transform(F.coalesce(F.col(f"`{p}`"), none), lambda x: F.trim(x)), lambda x: x != "")
    first = lambda p: F.coalesce(F.try_element_at(all_of(p), F.lit(1)), F.lit(""))
    parents = F.array_sort(F.filter(F.transform("`rdfs:subClassOf`", lambda x: tx.curie(x["_rdf:resource"])), lambda x: x.isNotNull()))
    names = F.array_sort(F.array_distinct(F.flatten(F.array(*map(all_of, synonyms))))) if synonyms else none
    out = raw.select(tx.curie(F.col("`_rdf:about`")).alias("id"), first(label).alias("label"), names.alias("synonyms"), first(definition).alias("definition"), F.coalesce(parents, none).alias("parents"), (F.lower(first(deprecated)).isin("true", "1")).alias("obsolete"))
    out = out.where(F.col("id").isNotNull() & F.col("id").startswith(id_prefix))
    return out if include_obsolete else out.where("not obsolete")


def gold_sets(rows: DataFrame, separator: str = r"\|", normalize: Callable[[Column], Column] | None = None) -> DataFrame:
    """``source_id``, ``gold_ids``: an empty cell is an empty set (no match is right), not a missing row.

    ``gold_ids`` is a cell, or an array as JSON lines have it. ``normalize`` changes each id; one that it makes null goes.
    """
    given = rows.schema["gold_ids"].dataType.typeName() == "array"
    ids = F.filter(F.transform(F.coalesce("gold_ids", F.array().cast("array<string>")), lambda x: F.trim(x.cast("string"))), lambda x: x != "") if given else tx.multivalue(F.col("gold_ids"), separator)
    if normalize is not None:
        ids = F.filter(F.transform(ids, normalize), lambda x: x.isNotNull())
    return rows.select(checked_id(F.col("source_id"), "gold").alias("source_id"), F.array_distinct(ids).alias("gold_ids"))


def gold_file(spark: SparkSession, path: str, normalize: Callable[[Column], Column] | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Gold sets of a CSV or JSON-lines file; a repeated source fails the read, and sets that aren't empty take their aliases in."""
    raw = spark.read.json(path, mode="FAILFAST") if path.rstrip("/").endswith(".jsonl") else spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False)
    gold = gold_sets(raw, normalize=normalize)
    bad = gold.groupBy("source_id").count().where("count > 1").orderBy("source_id").limit(5).collect()
    if bad:
        raise ValueError(f"repeated sources: {[r.source_id for r in bad]}")
    return gold if aliases is None else expanded_gold(gold, aliases)


def expanded_gold(gold: DataFrame, aliases: DataFrame) -> DataFrame:
    """Gold sets with the aliases of their ids; empty sets stay empty."""
    flat = gold.select("source_id", F.explode("gold_ids").alias("id"))
    more = flat.join(aliases, "id").groupBy("source_id").agg(F.collect_set("alias").alias("more"))
    return gold.join(more, "source_id", "left").select("source_id", F.array_distinct(F.concat("gold_ids", F.coalesce("more", F.array().cast("array<string>")))).alias("gold_ids"))


def repeated_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def refuse_repeated_ids(records: DataFrame) -> DataFrame:
    bad = repeated_ids(records).orderBy("id").limit(5).collect()
    if bad:
        raise ValueError(f"repeated ids: {[r.id for r in bad]}")
    return records
