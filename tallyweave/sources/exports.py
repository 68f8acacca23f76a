"""What a run gives out: mappings, reviewed views, histories, manifests, clusters and partitions as files.

Columns and their order are fixed, so that readers by position keep working.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ledger, reports

# The columns of each file.
MAPPING = ("source_id", "matched_id", "confidence", "status", "reason", "explanation", "attempts", "prompt_tokens", "completion_tokens", "llm_calls", "elapsed_seconds", "unknown_calls", "cache_hits", "cost_usd")
REVIEWED = ("source_id", "final_matched_id", "final_status", "review_decision", "corrected_target_id", "reviewer", "review_note", "reviewed_at", "model_matched_id", "model_status", "model_reason", "confidence", "result_key")
MEMBERS = ("order_index", "source_id", "outcome", "cluster_id", "cluster_size", "reason", "proposal_cluster_id", "confidence", "decision_id")
CLUSTERS = ("cluster_id", "revision", "size", "status", "seed_id", "mint_provenance", "member_ids", "representation")
UNRESOLVED = ("order_index", "source_id", "outcome", "reason", "proposal_cluster_id", "confidence", "decision_id")
WORKSHEET = ("result_key", "run_fingerprint", "source_id", "source_hash", "proposed_target_id", "decision", "corrected_target_id", "reviewer", "review_note", "reviewed_at")
DECISIONS = ("accept", "replace", "reject", "no_match", "defer")

#: A result as it is kept: nested, so that JSON lines read back to the same rows.
USAGE = T.StructType([T.StructField(n, t) for n, t in (("prompt_tokens", T.LongType()), ("completion_tokens", T.LongType()), ("calls", T.LongType()), ("unknown_calls", T.LongType()), ("cache_hits", T.LongType()), ("cost_usd", T.DoubleType()))])
ATTEMPT = T.StructType([T.StructField(n, t) for n, t in (("index", T.IntegerType()), ("query", T.StringType()), ("chosen_id", T.StringType()), ("resolution", T.StringType()), ("primary_score", T.DoubleType()), ("verifier_decision", T.StringType()), ("reason", T.StringType()), ("error", T.StringType()), ("candidate_count", T.IntegerType()))])
RESULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("result_key", "source_id", "source_hash", "matched_id")] + [T.StructField("confidence", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("status", "reason", "explanation", "run_fingerprint")] + [T.StructField("elapsed_seconds", T.DoubleType()), T.StructField("usage", USAGE), T.StructField("attempts", T.ArrayType(ATTEMPT))]
)


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def filled(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns in order, as text; one that is missing or null is blank."""
    return rows.select(*(text_of(F.col(c)).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns))


def to_json(results: DataFrame) -> DataFrame:
    """``source_id`` and a result's JSON with null fields kept."""
    own = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in results.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RESULT.fields))
    return results.select("source_id", F.to_json(own, {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Results from their JSON; one that isn't a result fails the read."""
    read = F.from_json("json", RESULT, {"mode": "FAILFAST"})
    return rows.select(read.alias("r")).select("r.*")


def mapping(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """A row for each source of the snapshot; one without a result is pending and otherwise blank."""
    rows = ledger.current_view(snapshot, log)
    pending = F.col("status") == "pending"
    if "usage" in rows.columns:
        rows = rows.withColumns({"prompt_tokens": F.col("usage.prompt_tokens"), "completion_tokens": F.col("usage.completion_tokens"), "llm_calls": F.col("usage.calls"), "unknown_calls": F.col("usage.unknown_calls"), "cache_hits": F.col("usage.cache_hits"), "cost_usd": F.col("usage.cost_usd")})
    if "attempts" in rows.columns and isinstance(rows.schema["attempts"].dataType, T.ArrayType):
        rows = rows.withColumn("attempts", F.when(~pending, F.size("attempts")))
    if "elapsed_seconds" in rows.columns:
        rows = rows.withColumn("elapsed_seconds", F.round("elapsed_seconds", 3))
    reason = F.when(pending, "pending").otherwise(F.col("reason")) if "reason" in rows.columns else F.when(pending, "pending")
    return filled(rows.withColumn("reason", reason), MAPPING)


def reviewed(snapshot: DataFrame, log: DataFrame, reviews: DataFrame) -> DataFrame:
    """The snapshot's sources with the review that applies, beside what the model said; reviews have their ``state``."""
    rows = ledger.current_view(snapshot, log)
    keep = [c for c in ("reviewer", "review_note", "reviewed_at") if c in reviews.columns]
    applied = reviews.where("state = 'applied'").select("source_id", F.col("decision").alias("review_decision"), F.col("corrected_id").alias("corrected_target_id"), *keep)
    d, pending = F.col("review_decision"), F.col("status") == "pending"
    final = F.when(d == "replace", F.col("corrected_target_id")).when(d.isin("reject", "no_match"), F.lit(None)).otherwise(F.col("matched_id"))
    status = F.when(d.isin("accept", "replace"), "matched").when(d.isin("reject", "no_match"), "unmatched").when(d == "defer", "needs_review").otherwise(F.col("status"))
    out = rows.join(applied, "source_id", "left").withColumns({"final_matched_id": final, "final_status": status, "model_matched_id": F.col("matched_id"), "model_status": F.when(~pending, F.col("status"))})
    return filled(out.withColumn("model_reason", F.col("reason")) if "reason" in out.columns else out, REVIEWED)


def worksheet(current: DataFrame, run: str) -> DataFrame:
    """Rows for a reviewer to fill: results that need one, with blank decisions."""
    rows = current.where("status = 'needs_review'").withColumn("run_fingerprint", F.lit(run)).withColumn("proposed_target_id", F.col("matched_id"))
    return filled(rows.select(*(c for c in rows.columns if c in WORKSHEET[:5])), WORKSHEET)


def read_worksheet(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of a filled worksheet; rows without one are left out, an unknown one fails the read, and so does
    a replacement without a target."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False)
    d, other = F.lower(F.trim(F.coalesce("decision", F.lit("")))), F.trim(F.coalesce("corrected_target_id", F.lit("")))
    checked = F.when(~d.isin(*DECISIONS), F.raise_error(F.concat(F.lit("unknown decision "), d))).when((d == "replace") & (other == ""), F.raise_error(F.lit("replace without a target"))).otherwise(d)
    return raw.where(F.trim(F.coalesce("decision", F.lit(""))) != "").withColumn("decision", checked).withColumn("corrected_target_id", F.when(other != "", other))


def manifest(snapshot: DataFrame, log: DataFrame, invocations: DataFrame | None = None) -> dict:
    """What a run holds, from its ledger alone: counts, repeated targets, sources that left, the last invocation.

    Only counts come to the driver, and of repeated targets as many as a report can name.
    """
    now = ledger.current_view(snapshot, log)
    out: dict = {"counts": {r.status: r["count"] for r in now.groupBy("status").count().collect()}}
    twice = ledger.duplicate_targets(now)
    out["duplicate_targets"] = {str(r.matched_id): r.sources for r in twice.orderBy("matched_id").limit(1000).collect()}
    out["duplicate_target_count"] = twice.count()
    out["removed_sources"] = ledger.removed_sources(log, snapshot).count()
    out["history"] = {"results": log.count()}
    out["snapshot"] = {"recorded": True, "size": snapshot.count()}
    state = reports.run_state(reports.counts(snapshot, log)).first()
    out |= {"run_state": state.state, "exit_code": state.exit_code}
    if invocations is not None:
        last = invocations.agg(F.max_by(F.to_json(F.struct(*invocations.columns)), "seq")).first()[0]
        out["last_invocation"] = json.loads(last) if last else None
    return out


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_history(log: DataFrame, path: str) -> None:
    """Every result ever committed, with its revision and whether it is current."""
    rows = ledger.history(log)
    write_json_lines(rows.select("current", "revision", F.struct(*(c for c in log.columns)).alias("result")), path)


def export(view: str, path: str, snapshot: DataFrame, log: DataFrame, reviews: DataFrame | None = None) -> None:
    """One view of a run: ``raw``, ``reviewed`` or ``history``."""
    if view == "raw":
        write_csv(mapping(snapshot, log), path)
    elif view == "reviewed":
        none = log.sparkSession.createDataFrame([], "source_id string, decision string, corrected_id string, state string")
        write_csv(reviewed(snapshot, log, none if reviews is None else reviews), path)
    elif view == "history":
        write_history(log, path)
        if reviews is not None:
            write_json_lines(reviews.select("state", F.struct(*(c for c in reviews.columns if c != "state")).alias("review")), f"{path}.reviews")
    else:
        raise ValueError(f"unknown view {view!r}: raw, reviewed or history")


def write_clusters(members: DataFrame, clusters: DataFrame, decisions: DataFrame, folder: str) -> None:
    """Members, clusters in order of birth, open items, and decisions, each a folder of its own."""
    write_csv(filled(members.orderBy("order_index"), MEMBERS), f"{folder}/members")
    write_csv(filled(clusters.orderBy("created_seq"), CLUSTERS), f"{folder}/clusters")
    write_csv(filled(members.where(F.col("outcome").isin("needs_review", "failed", "pending")).orderBy("order_index"), UNRESOLVED), f"{folder}/unresolved")
    write_json_lines(decisions, f"{folder}/decisions")


def assignments(rows: DataFrame) -> DataFrame:
    """``item_id``, ``cluster_id``, ``outcome`` of rows with these or ``source_id``; a missing outcome is told by the cluster's size.

    Blank or repeated items, unknown outcomes, and accepted items without a cluster fail the read.
    """
    from pyspark.sql import Window

    item = F.trim(F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("item_id", "source_id") if c in rows.columns), F.lit("")))
    cluster = F.trim(F.coalesce(F.col("cluster_id").cast("string"), F.lit("")))
    given = F.trim(F.coalesce(F.col("outcome"), F.lit(""))) if "outcome" in rows.columns else F.lit("")
    some = rows.select(item.alias("item_id"), cluster.alias("cluster_id"), given.alias("given"))
    some = some.withColumn("times", F.count("*").over(Window.partitionBy("item_id"))).withColumn("size", F.count("*").over(Window.partitionBy("cluster_id")))
    g, accepted = F.col("given"), F.col("given").isin("", "assigned", "singleton")
    fault = F.when(F.col("item_id") == "", "a row has no item_id").when(F.col("times") > 1, F.concat(F.lit("repeated item_id "), F.col("item_id"))).when((g != "") & ~g.isin(*reports.OUTCOMES), F.concat(F.lit("unknown outcome "), g)).when((F.col("cluster_id") == "") & accepted, F.concat(F.lit("no cluster_id for "), F.col("item_id")))
    outcome = F.when(fault.isNotNull(), F.raise_error(fault)).when(g != "", g).when(F.col("size") > 1, "assigned").otherwise("singleton")
    return some.select("item_id", "cluster_id", outcome.alias("outcome"))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.json(path, mode="FAILFAST") if path.rstrip("/").endswith(".jsonl") else spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False)
    return assignments(raw)


def write_assignments(rows: DataFrame, path: str) -> None:
    write_csv(assignments(rows), path)


def partitioned(ids: DataFrame, drawn: Column, overrides: DataFrame | None = None) -> DataFrame:
    """``source_id``, ``partition``: that of a file, where it names the source, else the drawn one."""
    rows = ids.select("source_id", drawn.alias("drawn"))
    if overrides is None:
        return rows.withColumnRenamed("drawn", "partition")
    return rows.join(overrides.select("source_id", "partition"), "source_id", "left").select("source_id", F.coalesce("partition", "drawn").alias("partition"))


def read_partition(spark: SparkSession, path: str, names: tuple[str, ...] = ("prompt_train", "validation", "test")) -> DataFrame:
    raw = spark.read.csv(path, header=True, inferSchema=False)
    part = F.trim("partition")
    return raw.select(F.trim("source_id").alias("source_id"), F.when(part.isin(*names), part).otherwise(F.raise_error(F.concat(F.lit("unknown partition "), part))).alias("partition"))


def question(kind: str, entity: str, target: str, rules: list[str], key: str = "") -> str:
    """What a decider is asked, from a domain's words: ``screen`` one candidate, ``choose`` among all, or ``rubric`` the choice."""
    ask = {
        "screen": f"Is candidate {key} the same {target} as the {entity} given?",
        "choose": f"Which candidate is the most specific {target} that is the same as the {entity} given, without a property that it doesn't state? Say NONE if there is none.",
        "rubric": f"How well does the chosen {target} stand for the {entity} given?",
    }[kind]
    return " ".join(" ".join(line.split()) for line in (ask, *rules) if line.strip())


def multivalue_cell(values: Column, separator: str = "|") -> Column:
    """The cell that ``multivalue`` reads back."""
    return F.array_join(F.filter(values, lambda x: F.trim(x) != ""), separator)

