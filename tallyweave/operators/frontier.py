"""What lies between two attempts: proposals to follow up, calls to make, and when to stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def route_proposals(proposals: DataFrame, issued: DataFrame, seen: DataFrame) -> DataFrame:
    """An ``outcome`` for each of ``source_id``, ``place``, ``kind``, ``value``.

    A candidate must be a key that was ``issued`` (source_id, key); a query must not have been ``seen``
    (source_id, query, normalised). Of equal ones the first counts.
    """
    value, is_key = F.trim("value"), F.col("kind") == "candidate"
    form = F.when(is_key, F.upper(value)).otherwise(tx.normalise_query(value))
    known = issued.selectExpr("source_id", "'candidate' AS kind", "upper(key) AS form").union(seen.selectExpr("source_id", "'query' AS kind", "query AS form")).distinct().withColumn("known", F.lit(True))
    rows = proposals.withColumn("value", value).withColumn("form", form).join(known, ["source_id", "kind", "form"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    first = F.row_number().over(Window.partitionBy("source_id", "kind", "form").orderBy("place")) == 1
    keys = F.when(~F.col("known"), "not_issued").when(~first, "duplicate").otherwise("candidate")
    searches = F.when(F.col("known") | ~first, "already_tried").otherwise("query")
    return rows.select("source_id", "place", "kind", "value", F.when(F.col("value") == "", "blank").when(F.col("kind") == "candidate", keys).otherwise(searches).alias("outcome"))


def dispatch(requests: DataFrame, cache: DataFrame, budget: int) -> DataFrame:
    """How each of ``seq``, ``request_key`` is answered: ``cached``, ``call``, ``shared`` (an equal request's call) or ``refused``.

    Only the first of equal requests costs a call, and only ``budget`` calls are made, in order of ``seq``.
    """
    missing = requests.join(cache.select("request_key").distinct(), "request_key", "left_anti")
    calls = missing.groupBy("request_key").agg(F.min("seq").alias("first_seq"))
    made = calls.orderBy("first_seq").limit(budget).withColumn("made", F.lit(True))
    hits = cache.select("request_key").distinct().withColumn("hit", F.lit(True))
    rows = requests.join(hits, "request_key", "left").join(made, "request_key", "left")
    answer = F.when(F.col("hit"), "cached").when(F.col("made") & (F.col("seq") == F.col("first_seq")), "call").when(F.col("made"), "shared").otherwise("refused")
    return rows.select("seq", "request_key", answer.alias("answer"))


def stop_reason(states: DataFrame, most: int) -> DataFrame:
    """Whether a run's state is that of the iteration before (``converged``), of an earlier one (``oscillation``), or its last allowed one."""
    own = Window.partitionBy("run").orderBy("iteration")
    seen = F.row_number().over(Window.partitionBy("run", "digest").orderBy("iteration")) > 1
    reason = F.when(F.lag("digest").over(own) == F.col("digest"), "converged").when(seen, "oscillation").when(F.col("iteration") >= most, "max_iterations")
    return states.select("run", "iteration", reason.alias("reason"))


def selected_iteration(states: DataFrame, most: int) -> DataFrame:
    """Each run's first stop and the iteration to keep: the last if converged, else that with least ``unresolved``, of equals the first."""
    stops = states.join(stop_reason(states, most), ["run", "iteration"])
    first = stops.where("reason is not null").groupBy("run").agg(F.min(F.struct("iteration", "reason")).alias("stop")).select("run", F.col("stop.iteration").alias("last"), "stop.reason")
    best = states.join(first, "run").where(F.col("iteration") <= F.col("last")).groupBy("run", "last", "reason").agg(F.min(F.struct("unresolved", "iteration")).alias("best"))
    return best.select("run", "last", "reason", F.when(F.col("reason") == "converged", F.col("last")).otherwise(F.col("best.iteration")).alias("selected"))


def max_live(deltas: DataFrame) -> DataFrame:
    """The most live clusters of each run at a step's end, from ``run``, ``step``, ``delta``. Steps are summed before they are ordered."""
    steps = deltas.groupBy("run", "step").agg(F.sum("delta").alias("delta"))
    live = F.sum("delta").over(Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("live", live).groupBy("run").agg(F.max("live").alias("max_live"))


def join_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two passes' candidates (``query_id``, ``id``, ``rank``) as one list: those of the first stay before new ones of the second."""
    both = first.withColumn("turn", F.lit(1)).unionByName(second.withColumn("turn", F.lit(2)))
    once = both.groupBy("query_id", "id").agg(F.min(F.struct("turn", "rank")).alias("at"))
    return once.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id")).alias("rank"))
