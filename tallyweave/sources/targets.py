"""A catalogue of targets as tables that change in place: kept by collection, changed by what differs, read by id.

A folder holds ``terms`` (id, digest, fields as given) and ``vectors`` (id, ord, kind, text, vector), a table of each for
each collection. A load writes the records that are new or differ, into the buckets of their ids, and marks for those
that go; a reader sees one version or the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import store
from ..functions import text as tx
from ..operators import ledger
from .delta import DeltaTable


def digest_of(columns: list[str]) -> Column:
    """A hash of all fields by name; a null field is a missing one."""
    return F.substring(F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns)))), 256), 1, 16)


#: Commits of a bucket from which on a load merges it.
DELTAS = 8


class Targets:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def folder(self, table: str, collection: str) -> str:
        return f"{self.path}/{table}/{collection}"

    def table(self, table: str, collection: str) -> DeltaTable:
        return DeltaTable(self.spark, self.folder(table, collection))

    def read(self, table: str, collection: str) -> DataFrame | None:
        return self.table(table, collection).read()

    def terms(self, collection: str) -> DataFrame:
        rows = self.read("terms", collection)
        if rows is None:
            raise KeyError(collection)
        return rows

    def load(self, collection: str, records: DataFrame, prune: bool = False) -> DataFrame:
        """Takes records in: those that are new or differ; with ``prune``, others go. Gives the number of each action.

        Repeated ids are refused.
        """
        bad = records.groupBy("id").count().where("count > 1").orderBy("id").limit(5).collect()
        if bad:
            raise ValueError(f"repeated ids: {[r.id for r in bad]}")
        new, terms = records.withColumn("digest", digest_of([c for c in records.columns if c != "id"])), self.table("terms", collection)
        before = terms.version()
        if before is None:
            terms.create(new, ["id"])
            return new.agg(F.lit("insert").alias("action"), F.count("*").alias("n"))
        old = terms.read(before)
        held = old.select("id", "digest") if old is not None else new.select("id", "digest").limit(0)
        done = ledger.upsert(held, new.select("id", "digest"))
        if not prune:
            done = done.withColumn("action", F.when(F.col("action") == "prune", "keep").otherwise(F.col("action")))
        done = store.Work(self.spark, "load").save(done, "actions")
        counts = done.groupBy("action").agg(F.count("*").alias("n")).collect()  # a row for each of four actions
        if any(r.action != "keep" for r in counts):
            puts = new.join(done.where("action in ('insert', 'update')").select("id"), "id", "left_semi")
            terms.change(puts, done.where("action = 'prune'").select("id"), before)
            terms.compact(DELTAS)
        return self.spark.createDataFrame([(r.action, r.n) for r in counts], "action string, n long")

    def get(self, collection: str, record_id: str) -> dict:
        if self.table("terms", collection).version() is None:
            raise KeyError(collection)
        kind = self.terms(collection).schema["id"]
        found = self.table("terms", collection).lookup(self.spark.createDataFrame([(record_id,)], T.StructType([kind])))
        row = found.first() if found is not None else None
        if row is None:
            raise KeyError(record_id)
        return row.asDict(recursive=True)

    def get_many(self, collection: str, ids: DataFrame) -> DataFrame:
        """The records asked for (``place``, ``id``), with their place; unknown ids are left out."""
        return self.terms(collection).join(store.few(ids), "id")

    def missing_vectors(self, collection: str, rows: DataFrame) -> DataFrame:
        """Rows (id, ord, text, ...) whose vector isn't there for the same text."""
        held = self.read("vectors", collection)
        return rows if held is None else rows.join(held.select("id", "ord", "text"), ["id", "ord", "text"], "left_anti")

    def add_vectors(self, collection: str, rows: DataFrame, dimensions: int) -> None:
        """Takes vectors in, in place of those of the same id and ord; another number of dimensions is refused."""
        right = F.when(F.size("vector") == dimensions, tx.half(F.col("vector"))).otherwise(F.raise_error(F.lit(f"a vector hasn't {dimensions} dimensions")).cast(T.ArrayType(T.DoubleType())))
        new, vectors = rows.withColumn("vector", right.cast("array<float>")), self.table("vectors", collection)
        before = vectors.version()
        if before is None:
            vectors.create(new, ["id", "ord"])
        else:
            vectors.change(new, after=before)
            vectors.compact(DELTAS)

    def drop(self, collection: str) -> None:
        for table in ("terms", "vectors"):
            store.delete(self.spark, self.folder(table, collection))

    def sizes(self) -> list[tuple[str, str, int, int]]:
        """(table, collection, rows, bytes) of all that is held."""
        out = []
        for table in ("terms", "vectors"):
            for name in store.names_in(self.spark, f"{self.path}/{table}"):
                rows = self.read(table, name)
                if rows is not None:
                    out.append((table, name, rows.count(), self.table(table, name).size()))
        return out


def vector_rows(records: DataFrame, names: Column, body: Column) -> DataFrame:
    """``id``, ``ord``, ``kind``, ``text`` of what an encoder is asked about: a record's text, then each of its distinct names."""
    entry = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    parts = F.concat(F.array(entry("doc", F.coalesce(body, F.lit("")))), F.transform(names, lambda n: entry("name", n)))
    return records.select("id", F.posexplode(parts).alias("ord", "entry")).select("id", "ord", "entry.kind", "entry.text")


def hashed_vector(text: Column, dimensions: int) -> Column:
    """A vector of a text without a model: each token adds to the place that its hash names; of length one, or zero."""
    places = F.transform(tx.tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int"))
    counts = lambda places: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))
    return tx.encoded_text(text, tx.unit(tx.named(places, counts)), dimensions)


def encoded(rows: DataFrame, encoder: Callable[[Column], Column] | None = None, dimensions: int = 64) -> DataFrame:
    """``vector`` of each row's text; ``encoder`` may be a pandas UDF around a model. Blank texts are zero and not asked about."""
    if encoder is None:
        return rows.withColumn("vector", hashed_vector(F.col("text"), dimensions))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    asked = rows.where(~blank).withColumn("vector", encoder(F.col("text")).cast("array<double>"))
    return asked.unionByName(rows.where(blank).withColumn("vector", F.array_repeat(F.lit(0.0), dimensions)))
