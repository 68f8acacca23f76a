"""Evaluation of results, rankings and partitions. Ratios with denominator zero are null."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decide import derive_status


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def f1(p: Column, r: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(2 * p * r, p + r), digits)


def judged(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Results with ``labelled``, ``no_match`` (an empty gold set) and ``correct``; gold has source_id, gold_ids."""
    return judged_rows(results.join(gold, "source_id", "left"))


def judged_rows(j: DataFrame) -> DataFrame:
    """The same for results that have their ``gold_ids``, null if unlabelled."""
    labelled = F.col("gold_ids").isNotNull()
    hit = F.coalesce(F.array_contains("gold_ids", F.col("matched_id")), F.lit(False))
    return j.withColumn("labelled", labelled).withColumn("no_match", labelled & (F.size("gold_ids") == 0)).withColumn("correct", labelled & hit)


def metrics(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and ratios over judged rows, for each group of ``keys``."""
    matched, unmatched = F.col("status") == "matched", F.col("status") == "unmatched"
    lab, none = F.col("labelled"), F.col("no_match")
    n = lambda c: F.count_if(c)
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("total"), n(lab).alias("n_labelled"), n(matched).alias("n_matched"), n(F.col("status") == "needs_review").alias("n_review"),
        n(unmatched).alias("n_unmatched"), n(F.col("status") == "failed").alias("n_failed"), n(lab & matched).alias("accepted"),
        n(lab & matched & F.col("correct")).alias("right"), n(lab & unmatched & none).alias("right_no_match"), n(lab & unmatched).alias("said_no_match"), n(none).alias("gold_no_match"),
    )
    c = F.col
    return agg.select(*keys, "total", "n_labelled", "n_matched", "n_review", "n_unmatched", "n_failed", ratio(c("right"), c("accepted")).alias("accepted_precision"), ratio(c("accepted"), c("n_labelled")).alias("coverage"), ratio(c("right"), c("n_labelled") - c("gold_no_match")).alias("recall"), ratio(c("right_no_match"), c("said_no_match")).alias("no_match_precision"), ratio(c("right_no_match"), c("gold_no_match")).alias("no_match_recall"))


def at_thresholds(rows: DataFrame, steps: int = 21) -> DataFrame:
    """Each row at each threshold 0, 0.05, ... with the review floor lowered to it where it is above."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    return rows.withColumn("step", grid).withColumn("threshold", F.round(F.col("step") / (steps - 1), 4)).drop("step")


def calibration(rows: DataFrame, least: int = 3, gap: float = 0.10) -> DataFrame:
    """Mean confidence of right and wrong answers, and whether they are too close to tell apart."""
    seen = rows.where("labelled and confidence is not null and matched_id is not null")
    agg = seen.agg(F.count_if("correct").alias("n_right"), F.count_if(~F.col("correct")).alias("n_wrong"), F.round(F.avg(F.when(F.col("correct"), F.col("confidence"))), 6).alias("mean_right"), F.round(F.avg(F.when(~F.col("correct"), F.col("confidence"))), 6).alias("mean_wrong"))
    warn = (F.col("n_right") >= least) & (F.col("n_wrong") >= least) & (F.col("mean_right") - F.col("mean_wrong") < gap)
    return agg.withColumn("warning", F.coalesce(warn, F.lit(False)))


def first_hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """For each query with gold answers the rank of its first one, null if none was retrieved."""
    hits = ranked.join(gold, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return gold.select("query_id").distinct().join(hits, "query_id", "left")


def recall_at(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    first = first_hits(ranked, gold)
    return first.agg(F.count("*").alias("n"), *(F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def ceiling_bucket() -> Column:
    """On labelled, gold_ids, known_gold, matched_id, keyed, retrieved (ids), cut, degraded: why a gold answer was or wasn't found."""
    c, meet = F.col, lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    return (
        F.when(~c("labelled"), "unlabelled").when(F.size("gold_ids") == 0, "no_gold").when(F.size("known_gold") == 0, "gold_unreachable")
        .when(F.coalesce(F.array_contains("gold_ids", c("matched_id")), F.lit(False)), "found").when(meet(c("gold_ids"), c("keyed")), "misjudged")
        .when(meet(c("gold_ids"), c("retrieved")) & c("cut"), "truncated").when(c("degraded"), "unavailable").otherwise("never_retrieved")
    )


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many sources went from one status to another."""
    a, b = before.select("source_id", F.col("status").alias("status_before")), after.select("source_id", F.col("status").alias("status_after"))
    return a.join(b, "source_id").groupBy("status_before", "status_after").agg(F.count("*").alias("n"))


def gold_outcome() -> Column:
    """On judged rows: how a result stands to what is known of its source."""
    s = F.col("status")
    said = F.when(s == "matched", F.when(F.col("correct"), "accepted_correct").otherwise("accepted_wrong"))
    said = said.when(s == "unmatched", F.when(F.col("no_match"), "correct_no_match").otherwise("incorrect_no_match"))
    return F.when(F.col("labelled"), said.when(s == "needs_review", "review").otherwise("failed")).otherwise("unlabelled")


#: Fields of a policy that judge the evidence of attempts and don't gather any: only these can be replayed.
REPLAYED = ("accept_at", "review_floor")


def refuse_unrecorded(recorded, proposed) -> None:
    """Refuses a policy that would have asked other things than the recorded one did."""
    if type(recorded) is not type(proposed):
        raise ValueError("another kind of policy needs calls that were not recorded")
    changed = [f.name for f in fields(recorded) if f.name not in REPLAYED and getattr(recorded, f.name) != getattr(proposed, f.name)]
    if changed:
        raise ValueError(f"these changes need calls that were not recorded: {', '.join(changed)}")


def replay(attempts: DataFrame, gold: DataFrame, recorded, proposed) -> DataFrame:
    """``matrix`` (``status`` or ``gold``), ``before``, ``after``, ``n``: what recorded attempts come to under another policy.

    Both policies are applied to the attempts in one plan each, and meet by source in one join.
    """
    refuse_unrecorded(recorded, proposed)

    def told(policy, name: str) -> DataFrame:
        results = derive_status(attempts, accept_at=policy.accept_at, review_floor=policy.review_floor)
        return judged(results, gold).select("source_id", F.array(F.struct(F.lit("status").alias("matrix"), F.col("status").alias("to")), F.struct(F.lit("gold").alias("matrix"), gold_outcome().alias("to"))).alias(name))

    both = told(recorded, "a").join(told(proposed, "b"), "source_id").select(F.explode(F.arrays_zip("a", "b")).alias("x"))
    return both.groupBy(F.col("x.a.matrix").alias("matrix"), F.col("x.a.to").alias("before"), F.col("x.b.to").alias("after")).agg(F.count("*").alias("n"))


def deal_holdout(rows: DataFrame, draw_value: Column, ranges: int = 1024) -> DataFrame:
    """Alternate rows in order of their draw: halves that differ by one at most.

    Draws are even over [0, 1): each of ``ranges`` is ordered by itself, after as many rows as the ranges before it hold.
    """
    drawn = rows.withColumn("draw", draw_value).withColumn("range", F.floor(F.col("draw") * ranges))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # over a row for each range
    first = drawn.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("draw", "source_id")) + F.col("first")
    return drawn.join(F.broadcast(first), "range").withColumn("part", F.when(place % 2 == 1, "fit").otherwise("holdout")).drop("range", "first")


def fit_grid(rows: DataFrame, accept: list[float], choose: list[float], target: float) -> DataFrame:
    """Accepted and right answers at each pair of floors, and whether precision reaches the target."""
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("accept_at"), F.lit(c).alias("choose_at")) for a in accept for c in choose)))
    on = rows.withColumn("g", grid).select("*", "g.*")
    ok = (F.col("confidence") >= F.col("accept_at")) & (F.col("p_choice") >= F.col("choose_at")) & F.col("labelled")
    agg = on.groupBy("accept_at", "choose_at").agg(F.count_if(ok).alias("accepted"), F.count_if(ok & F.col("correct")).alias("right"))
    precision = ratio(F.col("right"), F.col("accepted"))
    return agg.withColumn("precision", precision).withColumn("good", F.coalesce(precision >= target, F.lit(False)))


def recommended(grid: DataFrame) -> DataFrame:
    """Of the pairs that reach the target, that with most accepted; of equals, the stricter."""
    return grid.where("good").agg(F.max_by(F.struct("accept_at", "choose_at", "accepted", "precision"), F.struct("accepted", "accept_at", "choose_at")).alias("r")).where("r is not null").select("r.*")


def pairs_in(n: Column) -> Column:
    return n * (n - 1) / 2


def partition_scores(items: DataFrame) -> DataFrame:
    """Pairwise and B-cubed scores of ``cluster_id`` against ``gold_id``, from their contingency counts."""
    cells = items.groupBy("cluster_id", "gold_id").agg(F.count("*").alias("n"))
    a = items.groupBy("cluster_id").agg(F.count("*").alias("a"), F.count_distinct("gold_id").alias("golds"))
    b = items.groupBy("gold_id").agg(F.count("*").alias("b"), F.count_distinct("cluster_id").alias("clusters"))
    c = F.col
    cell = cells.join(a, "cluster_id").join(b, "gold_id").agg(F.sum("n").alias("items"), F.sum(pairs_in(c("n"))).alias("tp"), F.sum(c("n") * c("n") / c("a")).alias("bp"), F.sum(c("n") * c("n") / c("b")).alias("br"))
    own = a.agg(F.count("*").alias("n_clusters"), F.sum(pairs_in(c("a"))).alias("predicted"), F.count_if(c("golds") > 1).alias("false_merges"), F.count_if(c("a") == 1).alias("singletons"))
    true = b.agg(F.count("*").alias("n_gold"), F.sum(pairs_in(c("b"))).alias("actual"), F.count_if(c("clusters") > 1).alias("splits"))
    one = cell.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(true))  # one row each
    p, r, bp, br = ratio(c("tp"), c("predicted")), ratio(c("tp"), c("actual")), ratio(c("bp"), c("items")), ratio(c("br"), c("items"))
    long = lambda x: x.cast("long")
    return one.select("items", "n_clusters", "n_gold", "singletons", "false_merges", "splits", long(c("tp")).alias("true_pairs"), long(c("predicted") - c("tp")).alias("false_pairs"), long(c("actual") - c("tp")).alias("missed_pairs"), p.alias("pair_precision"), r.alias("pair_recall"), f1(p, r).alias("pair_f1"), bp.alias("b3_precision"), br.alias("b3_recall"), f1(bp, br).alias("b3_f1"))


def order_sensitivity(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairwise F1 between two partitions of the items they share, and how many items changed company."""
    both = first.select("item_id", F.col("cluster_id").alias("one")).join(second.select("item_id", F.col("cluster_id").alias("two")), "item_id")
    cell = both.groupBy("one", "two").agg(F.count("*").alias("n"))
    left, right = both.groupBy("one").agg(F.count("*").alias("a")), both.groupBy("two").agg(F.count("*").alias("b"))
    c = F.col
    joined = cell.join(left, "one").join(right, "two").agg(F.sum(pairs_in(c("n"))).alias("tp"), F.sum(F.when((c("n") != c("a")) | (c("n") != c("b")), c("n")).otherwise(0)).alias("unstable_items"))
    pairs = left.agg(F.sum(pairs_in(c("a"))).alias("p")).crossJoin(right.agg(F.sum(pairs_in(c("b"))).alias("q")))
    p, r = ratio(c("tp"), c("p")), ratio(c("tp"), c("q"))
    return joined.crossJoin(pairs).select(f1(p, r).alias("pair_f1"), c("unstable_items").cast("long").alias("unstable_items"))


def run_gate(baseline: DataFrame, candidate: DataFrame, tolerance: float = 0.02, most_tokens: float = 0.5) -> DataFrame:
    """Whether a candidate run may replace the baseline, by ``domain``: ``accuracy`` and ``tokens`` of both.

    A domain's accuracy may fall by the tolerance, the mean over domains not at all.
    """
    a, b = (d.select("domain", F.col("accuracy").alias(f"accuracy_{n}"), F.col("tokens").alias(f"tokens_{n}")) for d, n in ((baseline, "before"), (candidate, "after")))
    delta, ratio_ = F.round(F.col("accuracy_after") - F.col("accuracy_before"), 6), F.col("tokens_after") / F.nullif("tokens_before", F.lit(0))
    both = a.join(b, "domain").select("domain", delta.alias("delta"), F.round(ratio_, 6).alias("token_ratio"))
    fine = F.coalesce((F.col("delta") >= -tolerance) & (F.col("token_ratio") <= most_tokens), F.lit(False))
    mean = F.round(F.avg("delta").over(Window.partitionBy(F.lit(0))), 6)  # a row for each domain
    return both.withColumn("domain_passes", fine).withColumn("run_passes", F.every("domain_passes").over(Window.partitionBy(F.lit(0))) & (mean >= 0))
