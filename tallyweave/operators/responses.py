"""Answers of a model, kept between runs: a stored cache, and a budget of calls that holds across passes and restarts.

A request's key is a hash of all that the model sees and of who it is. A pass looks its requests up, asks the model once
for each distinct one that is missing, and keeps the answers in a table that changes in place. Calls are reserved in the
shared folder before they are made, so a run that is killed and taken up again can't spend its budget twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..sources.delta import DeltaTable

#: Raised when what an answer means changes, so that older ones are not taken for it.
CACHE_VERSION = 1


def request_key(model: str, *fields: str) -> Column:
    """The hash of named columns, as fields and not as one text, with the model's identity; null differs from blank."""
    own = F.struct(F.lit(CACHE_VERSION).alias("version"), F.lit(model).alias("model"), F.struct(*(F.col(f"`{f}`") for f in sorted(fields))).alias("request"))
    return F.sha2(F.to_json(own, {"ignoreNullFields": "false"}), 256)


class CallBudget:
    """Calls that a run may make, reserved by passes: one small file a pass, created only once."""

    def __init__(self, spark: SparkSession, path: str, most: int) -> None:
        self.spark, self.path, self.most = spark, path, most

    def reserved(self) -> dict[str, int]:
        return {n.removesuffix(".json"): json.loads(store.read_text(self.spark, f"{self.path}/{n}"))["calls"] for n in store.names_in(self.spark, self.path) if n.endswith(".json")}

    def reserve(self, name: str, wanted: int) -> int:
        """Reserves up to ``wanted`` calls for the pass ``name``. A pass that reserved before has what it had then."""
        held = self.reserved()
        if name not in held:
            held[name] = max(0, min(wanted, self.most - sum(held.values())))
            if not store.create_text(self.spark, f"{self.path}/{name}.json", json.dumps({"calls": held[name]})):
                return self.reserved()[name]
        return held[name]


class ResponseCache:
    """``request_key``, ``response`` in a table that changes in place. ``read`` and ``write`` turn either side off."""

    def __init__(self, spark: SparkSession, path: str, read: bool = True, write: bool = True) -> None:
        self.spark, self.table, self.read, self.write = spark, DeltaTable(spark, path), read, write

    def rows(self) -> DataFrame:
        held = self.table.read() if self.read else None
        return held if held is not None else self.spark.createDataFrame([], "request_key string, response string")

    def keep(self, answers: DataFrame) -> None:
        """Keeps answers (``request_key``, ``response``); null ones are failures and are asked again."""
        if not self.write:
            return
        new, before = answers.where("response is not null").select("request_key", "response"), self.table.version()
        if before is None:
            self.table.create(new, ["request_key"])
        else:
            self.table.change(new, after=before)

    def answered(self, requests: DataFrame, model: Callable[[DataFrame], DataFrame], budget: CallBudget | None = None, name: str = "pass") -> DataFrame:
        """All columns of ``requests`` (``seq``, ``request_key``, what the model reads), with ``answer`` and ``response``.

        ``answer`` is ``cached``, ``call``, ``shared`` (an equal request's call), ``failed`` (the call gave null) or ``refused``
        (no call was left; requests of the least ``seq`` are served first). ``model`` takes one row of each distinct request
        and gives ``request_key`` and ``response``. Equal requests may be of any number: only one row of each is moved.
        """
        work = store.Work(self.spark, "responses")
        rows = work.save(requests, "requests")
        held = self.rows()
        missing = rows.join(held.select("request_key"), "request_key", "left_anti").groupBy("request_key").agg(F.min("seq").alias("first_seq"))
        missing = work.save(missing, "missing")
        wanted = missing.count()
        allowed = wanted if budget is None else budget.reserve(name, wanted)
        made = missing if allowed >= wanted else missing.orderBy("first_seq", "request_key").limit(allowed)  # no more rows than calls
        made = work.save(made, "made")
        asked = rows.join(made, "request_key").where(F.col("seq") == F.col("first_seq")).drop("first_seq").dropDuplicates(["request_key"])
        answers = work.save(model(asked).select("request_key", F.col("response").cast("string").alias("response")), "answers")
        if wanted:
            self.keep(answers)
        found = held.select("request_key", "response", F.lit("cached").alias("how"), F.lit(None).cast("long").alias("first_seq"))
        called = made.join(answers, "request_key", "left").select("request_key", "response", F.lit("call").alias("how"), F.col("first_seq").cast("long").alias("first_seq"))
        both = work.save(rows.select("request_key").distinct().join(found.unionByName(called), "request_key"), "both")  # before the table changes again
        answer = F.when(F.col("how").isNull(), "refused").when(F.col("how") == "cached", "cached").when(F.col("response").isNull(), "failed").when(F.col("seq") == F.col("first_seq"), "call").otherwise("shared")
        return rows.join(both, "request_key", "left").withColumn("answer", answer).select(*(f"`{c}`" for c in requests.columns), "answer", "response")


def usage(answered: DataFrame) -> DataFrame:
    """One row: calls that were made, hits of the cache (which cost nothing), shared answers and refusals."""
    count = lambda *kinds: F.count_if(F.col("answer").isin(*kinds))
    return answered.agg(count("call", "failed").alias("calls"), count("cached").alias("cache_hits"), count("shared").alias("shared"), count("refused").alias("refused"))
