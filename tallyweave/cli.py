"""``python -m tallyweave.cli``: searching, matching, clustering and their evaluation over files.

Exit codes: 0 all is settled, 1 something needs a look, 2 the call is wrong, 3 something failed.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import engine, evaluate, matcher, reports, retrieval
from .sources import exports, files


def records(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """``id`` and ``text`` (all other fields) of a CSV, TSV, JSON-lines or OBO file; repeated ids are refused."""
    kind = path.rsplit(".", 1)[-1]
    if kind == "obo":
        rows = files.obo_records(spark, path)
    elif kind in ("jsonl", "ndjson"):
        rows = files.jsonl_records(spark, path, id_column)
    else:
        rows = files.csv_records(spark, path, id_column, "\t" if kind == "tsv" else ",")
    fields = [F.array_join(c, " ") if rows.schema[c].dataType.typeName() == "array" else F.col(f"`{c}`").cast("string") for c in rows.columns if c != "id"]
    return files.refuse_repeated_ids(rows.select("id", F.trim(F.concat_ws(" ", *fields)).alias("text")))


def arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tallyweave")
    commands = top.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", help="the best targets of one text")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=10)
    match = commands.add_parser("match", help="the target of each source")
    match.add_argument("--sources", required=True)
    for p in (search, match):
        p.add_argument("--targets", required=True)
    match.add_argument("--decider", action="store_true", help="one pass of screening and choice instead of the retry loop")
    cluster = commands.add_parser("cluster", help="groups of equal records")
    cluster.add_argument("--items", required=True)
    cluster.add_argument("--block", default="", help="a column that cuts the items into blocks")
    score = commands.add_parser("eval", help="a mapping against gold")
    score.add_argument("--mapping", required=True)
    score.add_argument("--gold", required=True)
    validate = commands.add_parser("validate", help="what is wrong with a collection")
    validate.add_argument("--items", required=True)
    for p in (match, cluster):
        p.add_argument("--out", required=True)
    for p in (search, match, cluster, validate):
        p.add_argument("--id", default="id")
    return top.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[dict, int]:
    """What is reported, and the exit code."""
    if args.command == "search":
        targets = records(spark, args.targets, args.id)
        lists = {"bm25": lambda q, k: retrieval.bm25_topk(q, targets, k), "overlap": lambda q, k: retrieval.top(retrieval.overlap_scores(q, retrieval.postings(targets)), k)}
        found = retrieval.search_one(args.query, lists, targets, args.limit).orderBy("rank").collect()
        return {"hits": [{"id": r.id, "rank": r["rank"], "evidence": r.evidence} for r in found]}, 0 if found else 1
    if args.command == "match":
        sources, targets = records(spark, args.sources, args.id).withColumnRenamed("id", "source_id"), records(spark, args.targets, args.id)
        search = lambda q, k: retrieval.bm25_topk(q, targets, k)
        results = matcher.decide_sources(sources, targets, search, matcher.lexical_decider()) if args.decider else matcher.match(sources, targets, search, matcher.lexical_models())[0]
        log = results.withColumn("seq", F.lit(1).cast("long"))
        exports.export("raw", f"{args.out}/mapping", sources.select("source_id"), log)
        state = reports.run_state(reports.counts(sources.select("source_id"), log)).first()
        return exports.manifest(sources.select("source_id"), log), state.exit_code
    if args.command == "cluster":
        items = records(spark, args.items, args.id).withColumnRenamed("text", "label")
        block = F.lit("all")
        if args.block:
            raw = files.csv_records(spark, args.items, args.id).select("id", F.col(f"`{args.block}`").alias("block"))
            items, block = items.join(raw, "id"), F.col("block")
        log = engine.cluster_blocks(items, block)
        members, clusters = engine.selected_members(log), engine.selected_clusters(log)
        exports.write_clusters(members, clusters, log.where("kind NOT IN ('member', 'cluster', 'end')"), args.out)
        counts = {r.outcome: r["count"] for r in members.groupBy("outcome").count().collect()}
        return {"outcomes": counts, "clusters": clusters.count()}, 3 if counts.get("failed") else 1 if counts.get("needs_review") else 0
    if args.command == "validate":
        from .operators.catalogue import preflight

        kind = args.items.rsplit(".", 1)[-1]
        rows = files.csv_records(spark, args.items, args.id, "\t" if kind == "tsv" else ",")
        fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns if c != "id"]
        found = preflight(rows.select("id", F.concat_ws(" ", *fields).alias("text")), "text").first().asDict()
        return found, 1 if found["duplicate_ids"] or found["empty_texts"] or not found["rows"] else 0
    rows = spark.read.csv(args.mapping, header=True, quote='"', escape='"', multiLine=True, inferSchema=False)
    results = rows.select("source_id", "status", F.nullif(F.col("matched_id"), F.lit("")).alias("matched_id"), F.col("confidence").try_cast("double").alias("confidence"))
    return evaluate.metrics(evaluate.judged(results, files.gold_file(spark, args.gold))).first().asDict(), 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("tallyweave").getOrCreate()
    try:
        report, code = run(spark, args)
    except (ValueError, KeyError) as error:
        report, code = {"error": str(error)}, 2
    print(json.dumps(report, default=str, sort_keys=True))
    return code


if __name__ == "__main__":
    sys.exit(main())
