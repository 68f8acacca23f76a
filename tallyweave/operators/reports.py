"""Reports over results and gold: matching and pair metrics, ceilings, clustering conventions, ablations, ensembles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from . import evaluate
from .evaluate import f1, ratio

NOT_A_CEILING = ("unlabelled", "no_gold", "gold_unreachable")
FAULTS = ("never_retrieved", "truncated", "misjudged")
OUTCOMES = ("assigned", "singleton", "needs_review", "failed", "pending")


def matching_metrics(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """One row over predictions that have gold.

    ``predictions``: source_id, status, predicted_id, retrieved and shown (arrays of ids, or null), first_id,
    has_first, attempts. Recall is over sources with gold, whatever they were accepted as.
    """
    c = F.col
    rows = predictions.join(gold, "source_id")
    right = F.coalesce(F.array_contains("gold_ids", c("predicted_id")), F.lit(False))
    first_right = F.coalesce(F.array_contains("gold_ids", c("first_id")), F.lit(False))
    meets = lambda a: F.coalesce(F.arrays_overlap("gold_ids", a), F.lit(False))
    has, accepted, none = F.size("gold_ids") > 0, c("status") == "matched", c("status") == "unmatched"
    looked, showed = has & c("retrieved").isNotNull(), c("shown").isNotNull()
    agg = rows.agg(
        F.count("*").alias("n"), F.count_if(has).alias("with_gold"), F.count_if(~has).alias("gold_no_match"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & right).alias("accepted_correct"),
        F.count_if(c("status") == "needs_review").alias("review"), F.count_if(has & right).alias("any_right"), F.count_if(none).alias("said_none"), F.count_if(none & ~has).alias("right_none"), F.count_if(~has & accepted).alias("false_accept_on_no_match"),
        F.count_if(looked).alias("looked"), F.count_if(looked & meets("retrieved")).alias("got"), F.count_if(looked & showed & meets("shown")).alias("saw"), F.count_if(looked & showed).alias("any_shown"),
        F.count_if(looked & meets("retrieved") & showed & ~meets("shown")).alias("cut"), F.round(F.avg(F.when(looked, F.size("retrieved"))), 2).alias("mean_candidates"),
        F.count_if("has_first").alias("tried"), F.count_if(c("has_first") & ~first_right & accepted & right).alias("recovered"), F.count_if(c("has_first") & first_right & ~(accepted & right) & (c("attempts") > 1)).alias("broken_by_retry"), F.round(F.avg(F.when(c("has_first"), c("attempts"))), 3).alias("mean_attempts"),
    )
    p, r = ratio(c("accepted_correct"), c("accepted")), ratio(c("accepted_correct"), c("with_gold"))
    only = lambda when, value: F.when(when > 0, value)
    return agg.select(
        "n", "with_gold", "gold_no_match", "accepted", "accepted_correct", p.alias("accepted_precision"), ratio(c("accepted"), c("n")).alias("coverage"), ratio(c("review"), c("n")).alias("review_rate"), r.alias("final_recall"), f1(p, r).alias("final_f1"),
        ratio(c("any_right"), c("with_gold")).alias("recall_any_status"), ratio(c("right_none"), c("said_none")).alias("no_match_precision"), ratio(c("right_none"), c("gold_no_match")).alias("no_match_recall"), "false_accept_on_no_match",
        only(c("looked"), ratio(c("got"), c("looked"))).alias("candidate_recall"), only(c("any_shown"), ratio(c("saw"), c("looked"))).alias("candidate_recall_shown"), only(c("looked"), c("cut")).alias("truncated"), "mean_candidates",
        only(c("tried"), c("recovered")).alias("recovered"), only(c("tried"), c("broken_by_retry")).alias("broken_by_retry"), "mean_attempts",
    )


def pairwise_metrics(pairs: DataFrame) -> DataFrame:
    """One row over pairs with ``same`` (the label) and ``predicted``."""
    y, p = F.col("same"), F.col("predicted")
    agg = pairs.agg(F.count("*").alias("pairs"), F.count_if(y).alias("positives"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.select("*", precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"))


def ceiling_counts(bucketed: DataFrame, seen: DataFrame, gold: DataFrame) -> DataFrame:
    """``part``, ``name``, ``n``: sources by bucket, by each retriever that brought a gold answer, and by the first
    attempt that did. ``bucketed``: source_id, bucket; ``seen``: source_id, attempt, id, retriever."""
    asks = bucketed.where(~F.col("bucket").isin(*NOT_A_CEILING)).select("source_id")
    hits = seen.join(asks, "source_id", "left_semi").join(gold.select("source_id", F.explode("gold_ids").alias("id")), ["source_id", "id"])
    rows = lambda part, df, key: df.groupBy(F.col(key).cast("string").alias("name")).agg(F.count_distinct("source_id").alias("n")).select(F.lit(part).alias("part"), "name", "n")
    first = hits.groupBy("source_id").agg(F.min("attempt").alias("first"))
    return rows("bucket", bucketed, "bucket").unionByName(rows("retriever", hits, "retriever")).unionByName(rows("attempt", first, "first"))


def ceiling_advice(counts: DataFrame) -> DataFrame:
    """One row: sources that can be judged, the commonest fault and its share, and what would help it most."""
    b = counts.where("part = 'bucket'")
    total = b.agg(F.coalesce(F.sum(F.when(~F.col("name").isin(*NOT_A_CEILING), F.col("n"))), F.lit(0)).alias("evaluable"), F.coalesce(F.sum(F.when(F.col("name").isin(*FAULTS), F.col("n"))), F.lit(0)).alias("faults"), F.coalesce(F.max(F.when(F.col("name") == "unavailable", F.col("n"))), F.lit(0)).alias("unavailable"), F.coalesce(F.max(F.when(F.col("name") == "gold_unreachable", F.col("n"))), F.lit(0)).alias("unreachable"), F.max_by(F.when(F.col("name").isin(*FAULTS), F.col("name")), F.when(F.col("name").isin(*FAULTS), F.struct("n", -F.array_position(F.array(*map(F.lit, FAULTS)), F.col("name"))))).alias("worst"), F.max(F.when(F.col("name").isin(*FAULTS), F.col("n"))).alias("most"))
    helps = {"never_retrieved": "retrieval", "truncated": "the candidate budget", "misjudged": "prompts"}
    worst = F.col("worst")
    return total.select("evaluable", "faults", F.when(F.col("faults") > 0, worst).alias("worst"), ratio(F.col("most"), F.col("faults")).alias("share"), F.when(F.col("faults") > 0, F.element_at(F.create_map(*(F.lit(x) for kv in helps.items() for x in kv)), worst)).otherwise("nothing: no ceiling failures").alias("spend_on"), (F.col("unavailable") > 0).alias("incomplete_traces"), (F.col("unreachable") > 0).alias("unreachable_gold"))


def evaluate_clustering(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Two rows, by ``convention``: every item that isn't accepted is its own cluster, or left out.

    ``predicted``: item_id, cluster_id, outcome; ``gold``: item_id, gold_id. Items without gold are ignored.
    """
    rows = gold.join(predicted.withColumn("here", F.lit(True)), "item_id", "left")
    accepted = F.coalesce(F.col("outcome").isin("assigned", "singleton"), F.lit(False))
    own = F.when(accepted, F.concat(F.lit("c:"), F.col("cluster_id").cast("string"))).otherwise(F.concat(F.lit("s:"), F.col("item_id").cast("string")))
    out = None
    for name, part in (("as_singletons", rows.withColumn("cluster_id", own)), ("accepted_only", rows.where(accepted))):
        one = evaluate.partition_scores(part.select("item_id", "cluster_id", "gold_id")).withColumn("convention", F.lit(name))
        out = one if out is None else out.unionByName(one)
    share = rows.agg(ratio(F.count_if(accepted), F.count("*")).alias("accepted_coverage"), ratio(F.count_if(F.coalesce(F.col("outcome") == "needs_review", F.lit(False))), F.count("*")).alias("review_coverage"), F.count_if(F.col("here").isNull()).alias("missing"))
    return out.crossJoin(F.broadcast(share))  # one row


def ablation_delta(variants: DataFrame, baseline: str, metrics: list[str]) -> DataFrame:
    """``variant``, ``metric``, ``value``, ``delta`` to the baseline; a metric that a variant lost counts as minus the baseline's."""
    names = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    long = variants.select("variant", F.explode(names).alias("m")).select("variant", "m.metric", "m.value")
    base = long.where(F.col("variant") == baseline).select("metric", F.col("value").alias("base"))
    delta = F.when(F.col("value").isNotNull() & F.col("base").isNotNull(), F.col("value") - F.col("base")).when(F.col("base").isNotNull(), -F.col("base"))
    return long.where(F.col("variant") != baseline).join(F.broadcast(base), "metric").select("variant", "metric", "value", F.round(delta, 4).alias("delta"))


def standard_ablations(retrievers: list[str], max_attempts: int, candidates: int) -> dict[str, dict]:
    """What each variant changes: one retriever less (if another is left), no second opinion, no retries, half the budget."""
    out: dict[str, dict] = {f"no_{r}": {"retrievers": [x for x in retrievers if x != r]} for r in retrievers} if len(retrievers) > 1 else {}
    return out | {"no_verifier": {"verify_band": None}, "no_retries": {"max_attempts": 1}, "half_budget": {"candidates": max(1, candidates // 2)}}


def ablate(run: Callable[..., DataFrame], gold: DataFrame, variants: dict[str, dict], metrics: list[str]) -> DataFrame:
    """Runs the baseline and each variant (``run`` gives its results) and compares their metrics."""
    rows = None
    for name, change in {"baseline": {}, **variants}.items():
        one = evaluate.metrics(evaluate.judged(run(**change), gold)).withColumn("variant", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return ablation_delta(rows, "baseline", metrics)


def ensemble(sources: DataFrame, first: DataFrame, second: DataFrame, margin: float = 0.2) -> DataFrame:
    """Each source's answer from two runs: what both say, else the surer by ``margin``, else a review.

    A run may lack sources; results have source_id, status, matched_id, confidence.
    """
    side = lambda df, n: df.select("source_id", F.when(F.col("status") == "matched", F.col("matched_id")).alias(f"id{n}"), F.coalesce("confidence", F.lit(0.0)).alias(f"c{n}"))
    rows = sources.select("source_id").join(side(first, 1), "source_id", "left").join(side(second, 2), "source_id", "left")
    a, b, ca, cb = F.col("id1"), F.col("id2"), F.col("c1"), F.col("c2")
    surer = F.abs(ca - cb) >= margin
    method = F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "consensus").when(surer, F.when(ca > cb, "surer_first").otherwise("surer_second")).otherwise("conflict")).when(a.isNotNull(), "only_first").when(b.isNotNull(), "only_second").otherwise("none")
    final = F.when(method.isin("consensus", "surer_first", "only_first"), a).when(method.isin("surer_second", "only_second"), b)
    status = F.when(method == "conflict", "needs_review").when(final.isNotNull(), "matched").otherwise("unmatched")
    return rows.select("source_id", method.alias("method"), final.alias("matched_id"), status.alias("status"))


def counts(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """One row: sources of the snapshot, those pending, current results, and all rows of history."""
    from .ledger import current_view, latest

    now = current_view(snapshot, log).agg(F.count("*").alias("snapshot_size"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "needs_review").alias("review"))
    return now.crossJoin(log.agg(F.count("*").alias("history"))).crossJoin(latest(log).agg(F.count("*").alias("sources_seen")))  # one row each


def run_state(counted: DataFrame, stopped: str | None = None) -> DataFrame:
    """The state of a run and its exit code: interrupted 130, aborted or failed 3, open ones 1, else 0. ``stopped``
    is ``interrupted`` or ``aborted`` where the run was."""
    state = F.lit(stopped) if stopped else F.when(F.col("failed") > 0, "failed").when(F.col("pending") > 0, "partial").otherwise("complete")
    code = F.when(F.col("state") == "interrupted", 130).when(F.col("state").isin("aborted", "failed") | (F.col("failed") > 0), 3).when((F.col("review") > 0) | (F.col("state") == "partial"), 1).otherwise(0)
    return counted.withColumn("state", state).withColumn("exit_code", code)


def first_unfinished(snapshot: DataFrame, log: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` sources without a settled result, in order; the rest stay pending."""
    from .ledger import resume_todo

    return resume_todo(snapshot, log).orderBy("source_id").limit(limit)


def full_report(results: DataFrame, attempts_: DataFrame, gold: DataFrame, parts: DataFrame) -> DataFrame:
    """``section``, ``name``, ``value``: metrics, status counts, sizes of the parts (source_id, part), attempts per source."""
    judged = evaluate.judged(results, gold)
    one = evaluate.metrics(judged)
    metric = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in one.columns))).alias("m")).select(F.lit("metrics").alias("section"), "m.name", "m.value")
    by = lambda df, section, key: df.groupBy(F.col(key).cast("string").alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(section).alias("section"), "name", "value")
    tries = attempts_.where("attempt is not null").groupBy("source_id").agg(F.count("*").alias("attempts"))
    return metric.unionByName(by(results, "status", "status")).unionByName(by(parts.join(results.select("source_id"), "source_id", "left_semi"), "partition", "part")).unionByName(by(tries, "attempts", "attempts"))


#: Sources that are looked at together when gold is taken out.
PAGE = 1_000


def removed_gold(gold: DataFrame, targets: DataFrame, salt: str, wanted: int, most: int) -> tuple[list, DataFrame]:
    """Targets to take out of the catalogue so that ``wanted`` sources have no right answer, ``most`` at most, and the gold left.

    Whole gold sets go, in order of the sources' salted hashes, ``PAGE`` sources at a time until ``wanted`` are found or no
    source is left; with a page come the sources that share a target with it.
    """
    here = targets.select(F.col("id").alias("gold_id")).distinct()
    flat = gold.select("source_id", F.explode_outer("gold_ids").alias("gold_id")).join(here.withColumn("here", F.lit(True)), "gold_id", "left").groupBy("source_id").agg(F.sort_array(F.collect_set(F.when(F.col("here"), F.col("gold_id")))).alias("gold_ids"))
    work = store.Work(targets.sparkSession, "removed_gold")
    ordered = work.save(flat.withColumn("order", F.sha2(F.concat(F.lit(salt), F.col("source_id").cast("string")), 256)), "ordered")
    by_target = work.save(ordered.select("source_id", "gold_ids", F.explode("gold_ids").alias("gold_id")), "by_target")
    empty, gone, after = ordered.where(F.size("gold_ids") == 0).count(), set(), ""
    while empty < wanted:
        page = ordered.where((F.col("order") > after) & (F.size("gold_ids") > 0)).orderBy("order", "source_id").limit(PAGE).collect()
        if not page:
            break
        # All sources that share a target with those of the page, as whole gold sets: taking a target may empty these too.
        mine = targets.sparkSession.createDataFrame([(i,) for i in sorted({i for r in page for i in r.gold_ids})], here.schema)
        labels = {r.source_id: set(r.gold_ids) for r in by_target.join(F.broadcast(mine), "gold_id", "left_semi").select("source_id", "gold_ids").distinct().collect()}
        users: dict = {}
        for source, ids in labels.items():
            for i in ids:
                users.setdefault(i, set()).add(source)
        for r in page:
            left = set(r.gold_ids) - gone
            if left and empty < wanted:
                hit = {s for i in left for s in users[i]}
                more = sum(bool(labels[s] - gone) and not labels[s] - gone - left for s in hit)
                if empty + more <= most:
                    gone |= left
                    empty += more
        after = page[-1].order
    kept = F.filter("gold_ids", lambda x: ~x.isin(*gone)) if gone else F.col("gold_ids")
    return sorted(gone), flat.select("source_id", kept.alias("gold_ids"))


def chunked(ranked: DataFrame, size: Column, chunk: int, most: int) -> DataFrame:
    """``chunk`` of each candidate: as many as ``chunk`` in one, halved for a source until no chunk's text is over ``most``.

    A single candidate over ``most`` is a chunk of its own.
    """
    out = ranked.withColumn("size", size).withColumn("per", F.lit(chunk))
    tries = chunk.bit_length()
    for _ in range(tries):
        number = F.floor((F.col("rank") - 1) / F.col("per"))
        total = F.sum("size").over(Window.partitionBy("query_id", number))
        worst = F.max(F.when(F.col("per") > 1, total)).over(Window.partitionBy("query_id"))
        out = out.withColumn("total", total).withColumn("worst", F.max(F.when(F.col("per") > 1, F.col("total"))).over(Window.partitionBy("query_id"))).withColumn("per", F.when(F.col("worst") > most, F.greatest(F.lit(1), F.floor(F.col("per") / 2).cast("int"))).otherwise(F.col("per"))).drop("total", "worst")
    return out.withColumn("chunk", F.floor((F.col("rank") - 1) / F.col("per")).cast("int")).drop("per", "size")
