"""A table that changes in place: rows by key in hash buckets, changes as deltas, versions named by manifests.

A folder holds ``data/<commit>/bucket=<n>`` and ``versions/<n>.json``. A commit writes the rows that it puts, and
marks for those that it takes out, into the buckets of their keys; the manifest of the new version names for each
bucket the commits that make it up, in order. So a change of one row writes one file of one bucket, and a reader, who
reads what one manifest names, sees one version as long as its files are kept. Buckets of one commit are read as they
are; only those with deltas are merged, by the last commit of a key.

A manifest is created only where none of its number is; of two writers who start from one version the later one is
refused, and what it wrote is never named. A manifest that was not written whole doesn't count.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store

#: Rows of a bucket of a new table, on average, and the fewest buckets it has.
BUCKET_ROWS, FEWEST_BUCKETS = 500_000, 16
ORDER, GONE, BUCKET = "_commit", "_gone", "bucket"


class ConcurrentChange(RuntimeError):
    """Another writer made the next version first."""


@dataclass(frozen=True)
class Version:
    number: int
    keys: tuple[str, ...]
    buckets: int
    #: The commits of each bucket that holds rows, first to last.
    parts: dict[int, list[str]]


class DeltaTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        """Numbers of all manifests, whole or not."""
        return sorted(int(m.group(1)) for n in store.names_in(self.spark, f"{self.path}/versions") if (m := re.fullmatch(r"(\d+)\.json", n)))

    def version(self, number: int | None = None) -> Version | None:
        """A version by its number, or the last whole one."""
        for n in [number] if number is not None else self.numbers()[::-1]:
            try:
                held = json.loads(store.read_text(self.spark, f"{self.path}/versions/{n:08}.json"))
                return Version(n, tuple(held["keys"]), held["buckets"], {int(b): c for b, c in held["parts"].items()})
            except ValueError:
                continue
        return None

    def commit(self, after: Version | None, version: Version) -> Version:
        """Makes ``version`` the next one; refused if there is one beyond ``after`` already."""
        last = self.version()
        if (last.number if last else None) != (after.number if after else None):
            raise ConcurrentChange(f"version {last.number if last else None} is there")
        body = json.dumps({"keys": version.keys, "buckets": version.buckets, "parts": version.parts})
        if not store.create_text(self.spark, f"{self.path}/versions/{version.number:08}.json", body):
            raise ConcurrentChange(f"version {version.number} is there")
        return version

    def bucket_of(self, version: Version) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in version.keys)), F.lit(version.buckets)).cast("int")

    def write(self, version: Version, rows: DataFrame) -> tuple[str, list[int]]:
        """Writes rows under a new commit, a file or more for each bucket; gives its name and the buckets it has."""
        name = f"{version.number:08}-{uuid.uuid4().hex[:12]}"
        marked = rows.withColumns({ORDER: F.lit(version.number), BUCKET: self.bucket_of(version)})
        marked.repartition(BUCKET).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        return name, sorted(int(n.split("=")[1]) for n in store.names_in(self.spark, f"{self.path}/data/{name}") if n.startswith(f"{BUCKET}="))

    def create(self, rows: DataFrame, keys: list[str], buckets: int | None = None) -> Version:
        """The table of these rows; one that is there already is refused."""
        before = self.numbers()
        if self.version():
            raise ConcurrentChange(f"a table is in {self.path}")
        buckets = buckets or max(FEWEST_BUCKETS, -(-rows.count() // BUCKET_ROWS))
        new = Version(before[-1] + 1 if before else 0, tuple(keys), buckets, {})
        name, held = self.write(new, rows.withColumn(GONE, F.lit(False)))
        return self.commit(None, Version(new.number, new.keys, buckets, {b: [name] for b in held}))

    def change(self, puts: DataFrame | None = None, gone: DataFrame | None = None, after: Version | None = None) -> Version:
        """The version after ``after`` (the last one): ``puts`` in place of rows of their keys, and without the keys ``gone``."""
        old = after or self.version()
        number = self.numbers()[-1] + 1
        rows = puts.withColumn(GONE, F.lit(False)) if puts is not None else None
        if gone is not None:
            marks = gone.select(*(F.col(f"`{k}`") for k in old.keys)).withColumn(GONE, F.lit(True))
            rows = marks if rows is None else rows.unionByName(marks, allowMissingColumns=True)
        name, held = self.write(Version(number, old.keys, old.buckets, {}), rows)
        if not held:
            return old
        return self.commit(old, Version(number, old.keys, old.buckets, {**old.parts, **{b: [*old.parts.get(b, []), name] for b in held}}))

    def files(self, version: Version, buckets: list[int]) -> DataFrame | None:
        paths = [f"{self.path}/data/{c}/{BUCKET}={b}" for b in buckets for c in version.parts[b]]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def merged(self, version: Version, buckets: list[int]) -> DataFrame | None:
        """Rows of these buckets, the last of each key, with their commit and mark."""
        rows = self.files(version, buckets)
        if rows is None:
            return None
        names = [c for c in rows.columns if c not in version.keys]
        last = rows.groupBy(*(F.col(f"`{k}`") for k in version.keys)).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in names)), ORDER).alias("_row"))
        return last.select(*(F.col(f"`{k}`") for k in version.keys), "_row.*").select(*(F.col(f"`{c}`") for c in rows.columns))

    def read(self, version: Version | int | None = None) -> DataFrame | None:
        """The rows of a version, the last one by default; it stays that version, whatever is changed meanwhile."""
        v = version if isinstance(version, Version) else self.version(version)
        if v is None or not v.parts:
            return None
        plain = self.files(v, [b for b, own in v.parts.items() if len(own) == 1])
        changed = self.merged(v, [b for b, own in v.parts.items() if len(own) > 1])
        both = [x for x in (plain, changed) if x is not None]
        rows = both[0] if len(both) == 1 else both[0].unionByName(both[1], allowMissingColumns=True)
        return rows.where(~F.col(GONE)).drop(ORDER, GONE)

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows of these keys. Where they are few, only their buckets are read."""
        v = self.version()
        if v is None or not v.parts:
            return None
        asked = keys.select(*(F.col(f"`{k}`") for k in v.keys)).distinct()
        if store.is_few(asked, 1000):
            held = {r[0] for r in asked.select(self.bucket_of(v)).distinct().collect()}
            v = Version(v.number, v.keys, v.buckets, {b: own for b, own in v.parts.items() if b in held} or dict(list(v.parts.items())[:1]))
        return self.read(v).join(store.few(asked), list(v.keys), "left_semi")

    def compact(self, deltas: int = 4) -> Version | None:
        """Buckets of over ``deltas`` commits become one commit, without what was taken out; null if none are."""
        old = self.version()
        many = [b for b, own in old.parts.items() if len(own) > deltas] if old else []
        if not many:
            return None
        number = self.numbers()[-1] + 1
        rows = self.merged(old, many)
        name, held = self.write(Version(number, old.keys, old.buckets, {}), rows.where(~F.col(GONE)).drop(ORDER))
        parts = {b: own for b, own in old.parts.items() if b not in many} | {b: [name] for b in held}
        return self.commit(old, Version(number, old.keys, old.buckets, dict(sorted(parts.items()))))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests before the last ``keep`` whole ones, and commits that no kept one names; gives how many commits went.

        Readers of older versions, and writers at work, lose their files: it is for when there are none.
        """
        whole = [v for n in self.numbers() if (v := self.version(n))]
        kept = whole[-keep:]
        named = {c for v in kept for own in v.parts.values() for c in own}
        gone = [n for n in store.names_in(self.spark, f"{self.path}/data") if n not in named]
        for name in gone:
            store.delete(self.spark, f"{self.path}/data/{name}")
        for n in self.numbers():
            if n < kept[0].number:
                store.delete(self.spark, f"{self.path}/versions/{n:08}.json")
        return len(gone)

    def size(self) -> int:
        """Bytes of the files that the last version names."""
        v = self.version()
        return sum(store.bytes_in(self.spark, f"{self.path}/data/{c}/{BUCKET}={b}") for b, own in v.parts.items() for c in own) if v else 0
