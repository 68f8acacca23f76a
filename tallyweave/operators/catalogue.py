"""The target catalogue's upkeep, and gold sets against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preflight(rows: DataFrame, text: str) -> DataFrame:
    """Rows, ids that occur more than once, and blank texts."""
    by_id = rows.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) == "").alias("blank"))
    zero = F.lit(0)
    return by_id.agg(F.coalesce(F.sum("n"), zero).alias("rows"), F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.coalesce(F.sum("blank"), zero).alias("empty_texts"))


def restricted_gold(gold: DataFrame, targets: DataFrame) -> DataFrame:
    """Gold links (``source_id``, ``gold_id``) counted by whether the catalogue still has their target."""
    here = targets.select(F.col("id").alias("gold_id")).distinct().withColumn("here", F.lit(True))
    rows = gold.join(here, "gold_id", "left")
    return rows.groupBy("source_id").agg(F.count("here").alias("kept"), F.count_if(F.col("here").isNull()).alias("dropped"))


def alias_closure(gold: DataFrame, aliases: DataFrame) -> DataFrame:
    """Gold links with every id that is an alias (``id``, ``alias``) of one of them, once each."""
    more = gold.join(aliases.select(F.col("id").alias("gold_id"), "alias"), "gold_id").select("source_id", F.col("alias").alias("gold_id"))
    return gold.select("source_id", "gold_id").union(more).distinct()


def hop_headroom(missed: DataFrame, shown: DataFrame, parents: DataFrame) -> DataFrame:
    """Missed gold links, and those whose target is a parent or child (``id``, ``parent``) of a candidate shown."""
    hops = parents.selectExpr("id AS candidate", "parent AS gold_id").union(parents.selectExpr("parent AS candidate", "id AS gold_id")).distinct()
    near = shown.join(hops, "candidate").select("source_id", "gold_id").distinct().withColumn("near", F.lit(True))
    return missed.join(near, ["source_id", "gold_id"], "left").agg(F.count("*").alias("missed"), F.count("near").alias("one_hop"))


def co_exposure(shown: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs of items of one gold cluster that some decision showed together, and all pairs of gold clusters.

    A decision's list is as long as its candidate budget, so its pairs are bounded.
    """
    own = shown.join(gold, "item_id").select("decision", "item_id", "gold_id").distinct()
    a, b = own.withColumnRenamed("item_id", "low"), own.withColumnRenamed("item_id", "high")
    pairs = a.join(b, ["decision", "gold_id"]).where("low < high").select("low", "high").distinct().agg(F.count("*").alias("exposed_pairs"))
    total = gold.groupBy("gold_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("gold_pairs"))
    return pairs.crossJoin(F.broadcast(total))  # one row each
