"""Clusters of one collection: by exact mention, by gold set, by leaders within blocks; lineage of merges."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ids import short_hash


def by_exact_mention(items: DataFrame) -> DataFrame:
    """``item_id``, ``cluster_id``: items with one match key, named after their smallest id."""
    keyed = items.select("item_id", tx.match_key(F.col("label")).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("item_id").alias("cluster_id")), "key").select("item_id", "cluster_id")


def by_gold_set(gold: DataFrame) -> DataFrame:
    """Sources with the same set of gold ids are one cluster; without gold each is its own."""
    name = F.when(F.size("gold_ids") > 0, F.concat(F.lit("g:"), F.array_join(F.array_sort(F.col("gold_ids").cast("array<long>")), "|"))).otherwise(F.concat(F.lit("s:"), F.col("source_id").cast("string")))
    return gold.select("source_id", name.alias("cluster_id"))


def by_leaders(items: DataFrame, block: str, same_at: float = 0.85, reverse: bool = False) -> DataFrame:
    """Greedy leaders in order of id, within each block: an item joins the first leader whose key is as similar
    as ``same_at`` (twice the letters of matching blocks over all letters), or becomes one.

    The decision for an item depends on those before it, so a block is one sequential task; blocks are the
    unit of scale and should be keyed finely. Items of one key are one, and so are compared once.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple[str, int]] = []
        known: dict[str, int] = {}
        out = []
        for item, key in pdf.sort_values("item_id", ascending=not reverse)[["item_id", "key"]].itertuples(index=False):
            if key not in known:
                known[key] = next((who for text, who in leaders if as_similar(key, text, same_at)), item)
                if known[key] == item:
                    leaders.append((key, item))
            out.append((item, known[key]))
        return pd.DataFrame(out, columns=["item_id", "cluster_id"])

    keyed = items.select("item_id", tx.match_key(F.col("label")).alias("key"), F.col(block).alias("block"))
    return keyed.groupBy("block").applyInPandas(run, "item_id long, cluster_id long")


def as_similar(a: str, b: str, least: float) -> bool:
    """Whether two keys' block ratio reaches ``least``; cheap bounds above it are asked first."""
    if not a and not b:
        return True
    if 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    matcher = SequenceMatcher(None, a, b)
    return matcher.quick_ratio() >= least and matcher.ratio() >= least


def by_matching(results: DataFrame) -> DataFrame:
    """Sources by their accepted target; an unmatched one is its own, others are open."""
    s, matched = F.col("status"), (F.col("status") == "matched") & F.col("matched_id").isNotNull()
    own = F.col("source_id").cast("string")
    name = F.when(matched, F.concat(F.lit("t:"), F.col("matched_id").cast("string"))).when(s == "unmatched", F.concat(F.lit("s:"), own)).otherwise(F.concat(F.lit("r:"), own))
    size = F.count("*").over(Window.partitionBy("cluster_id"))
    kind = F.when(F.col("cluster_id").startswith("r:"), F.when(F.col("status") == "needs_review", "needs_review").otherwise("failed")).when(size > 1, "assigned").otherwise("singleton")
    return results.withColumn("cluster_id", name).select(F.col("source_id").alias("item_id"), "cluster_id", kind.alias("outcome"))


def mint_id(run: str, seed) -> F.Column:
    return F.concat(F.lit("K"), short_hash(F.concat_ws("|", F.lit(run), seed.cast("string"))))


def with_outcomes(members: DataFrame) -> DataFrame:
    """Cluster sizes beside each member; a lone member is a singleton."""
    size = F.count("*").over(Window.partitionBy("cluster_id"))
    return members.withColumn("size", size).withColumn("outcome", F.when(F.col("size") > 1, "assigned").otherwise("singleton"))


def member_changes(revisions: DataFrame) -> DataFrame:
    """What each revision of a cluster added to and removed from the one before; members are arrays."""
    before = F.coalesce(F.lag("members").over(Window.partitionBy("cluster_id").orderBy("revision")), F.array().cast(revisions.schema["members"].dataType))
    joined = lambda a: F.array_join(F.array_sort(a), "|")
    return revisions.withColumn("before", before).select("cluster_id", "revision", joined(F.array_except("members", "before")).alias("added"), joined(F.array_except("before", "members")).alias("removed"))


def merge_ancestry(spark: SparkSession, merges: DataFrame) -> DataFrame:
    """Every cluster that a cluster was merged into, directly or through others, with the number of steps.

    ``merges`` has ``child`` and ``parent``; clusters merge once, so the recursion ends.
    """
    return spark.sql(
        """WITH RECURSIVE up(child, ancestor, steps) AS (
             SELECT child, parent, 1 FROM {merges}
             UNION ALL SELECT u.child, m.parent, u.steps + 1 FROM up u JOIN {merges} m ON m.child = u.ancestor)
           SELECT child, ancestor, steps FROM up""",
        merges=merges,
    )
