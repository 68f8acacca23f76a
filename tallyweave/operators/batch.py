"""A run of many sources over several invocations, over plain files, that a kill doesn't spoil.

A folder holds ``identity.json`` (what the run's results depend on), ``results`` (a table that changes in place: the
last result of each source, and with it the versions before), and for each invocation ``invocations/<n>.begin`` and
``<n>.end``, each created only where none of its name is. An invocation takes the sources without a settled result, deals
them to passes, and commits a pass at a time; so what a killed pass wrote is never named, and the next invocation
goes on with all that isn't committed. One that began and never ended was interrupted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..sources.delta import DeltaTable
from . import ledger, reports

INVOCATIONS = "n int, state string, exit_code int, decided long, detail string"


class OtherRun(ValueError):
    """The folder holds a run of another identity; ``differences`` names the parts that differ."""

    def __init__(self, differences: list[str]) -> None:
        super().__init__(f"the folder holds a run that differs in {', '.join(differences)}")
        self.differences = differences


class BatchRun:
    def __init__(self, spark: SparkSession, path: str, identity: dict[str, str]) -> None:
        """Opens or begins the run in a folder; one of another identity is refused before anything is written."""
        self.spark, self.path, self.identity = spark, path, {k: str(v) for k, v in identity.items()}
        self.table = DeltaTable(spark, f"{path}/results")
        if not store.create_text(spark, f"{path}/identity.json", json.dumps(self.identity, sort_keys=True)):
            found = json.loads(store.read_text(spark, f"{path}/identity.json"))
            differing = sorted(k for k in found.keys() | self.identity.keys() if found.get(k) != self.identity.get(k))
            if differing:
                raise OtherRun(differing)

    def begin(self) -> int:
        """The number of a new invocation: the first that nobody else has begun."""
        n = max((int(x.split(".")[0]) for x in store.names_in(self.spark, f"{self.path}/invocations") if x.endswith(".begin")), default=0) + 1
        while not store.create_text(self.spark, f"{self.path}/invocations/{n:06}.begin", "{}"):
            n += 1
        return n

    def end(self, n: int, state: str, code: int, decided: int, detail: str = "") -> None:
        """How an invocation ended; said once, a second time changes nothing."""
        store.create_text(self.spark, f"{self.path}/invocations/{n:06}.end", json.dumps({"state": state, "exit_code": code, "decided": decided, "detail": detail}))

    def invocations(self) -> DataFrame:
        """``n``, ``state`` (interrupted: it never ended), ``exit_code``, ``decided`` (sources it committed) of each."""
        names = set(store.names_in(self.spark, f"{self.path}/invocations"))
        rows = []
        for name in sorted(x for x in names if x.endswith(".begin")):
            n = name.split(".")[0]
            told = json.loads(store.read_text(self.spark, f"{self.path}/invocations/{n}.end")) if f"{n}.end" in names else {"state": "interrupted", "exit_code": 130, "decided": None, "detail": ""}
            rows.append((int(n), told["state"], told["exit_code"], told["decided"], told["detail"]))
        return self.spark.createDataFrame(rows, INVOCATIONS)

    def results(self) -> DataFrame | None:
        """The committed result of each source, with the invocation that it is of."""
        return self.table.read()

    def todo(self, sources: DataFrame) -> DataFrame:
        """Sources without a committed result, and those whose result is that they failed."""
        held = self.results()
        return sources if held is None else sources.join(held.where("status <> 'failed'").select("source_id"), "source_id", "left_anti")

    def counts(self, sources: DataFrame, stopped: str | None = None) -> tuple[str, int]:
        held = self.results()
        log = held.withColumn("seq", F.lit(1)) if held is not None else sources.select("source_id", F.lit(1).alias("seq"), F.lit("pending").alias("status")).limit(0)
        row = reports.run_state(reports.counts(sources.select("source_id"), log), stopped).first()
        return row.state, row.exit_code

    def invoke(self, sources: DataFrame, decide: Callable[[DataFrame], DataFrame], passes: int = 4, limit: int | None = None) -> tuple[str, int]:
        """Decides what is left of ``sources`` (``source_id``) by ``decide`` (rows in, results out), ``limit`` of them in order at most.

        Gives the state and its exit code: 0 complete, 1 partial or to be reviewed, 3 failed or aborted, 130 interrupted. An error
        of ``decide`` ends the invocation as aborted and is raised; passes before it stay committed.
        """
        if sources.groupBy("source_id").count().where("count > 1").limit(1).count():
            raise ValueError("a source's id occurs twice")
        n, decided = self.begin(), 0
        work = store.Work(self.spark, "batch")
        left = self.todo(sources)
        if limit is not None:
            left = left.orderBy("source_id").limit(limit)
        left = work.save(left.withColumn("_pass", pass_of(F.col("source_id"), passes)), "todo")
        try:
            for k in range(passes):
                some = left.where(F.col("_pass") == k).drop("_pass")
                done = work.save(decide(some).withColumn("invocation", F.lit(n)), f"pass{k}")
                rows = done.count()
                if rows:
                    if self.table.version() is None:
                        self.table.create(done, ["source_id"])
                    else:
                        self.table.change(done)
                    decided += rows
            self.table.compact()
        except KeyboardInterrupt:
            self.end(n, "interrupted", 130, decided)
            raise
        except Exception as e:
            self.end(n, "aborted", 3, decided, str(e)[:500])
            raise
        state, code = self.counts(sources)
        self.end(n, state, code, decided)
        return state, code


def pass_of(key: Column, passes: int) -> Column:
    """The pass that a source is in: by its hash, so the same in each invocation."""
    return F.pmod(F.xxhash64(key), F.lit(passes)).cast("int")


def revisions(run: BatchRun) -> DataFrame | None:
    """The result of each source in each version of the table that has another one, first to last: ``revision``, ``current``."""
    numbers = [v.number for n in run.table.numbers() if (v := run.table.version(n))]
    every = None
    for n in numbers:
        rows = run.table.read(n).withColumn("seq", F.lit(n))
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
    if every is None:
        return None
    once = every.groupBy("source_id", "invocation", "status", "matched_id").agg(F.min("seq").alias("seq"))
    return ledger.history(once)
