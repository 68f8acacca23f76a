"""Matching as a whole: attempts of each source as a frontier of rows, until each has an answer or no more turns.

A pass takes the sources that still have work, one row each: queries to search or a candidate to look at again.
Retrieval, budget, selection, scoring and verification of a pass are joins over all its rows; what a source does
next (follow leads, search anew, ask for a rewrite, stop) is decided on its own row. Each pass is written before
the next one, so the plan stays as long as one pass, however many there are.

Models are columns: functions of a source and its candidates. Those here go by names and need no network.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import text as tx
from . import decide, retrieval

FATAL, PROVIDER, RETRIEVER, OVER = "fatal_provider_failure", "provider_failure", "retriever_failure", "candidate_budget_exceeded"
#: An outage says nothing about the source: the same work is tried again.
SAME_WORK = (PROVIDER, RETRIEVER)


@dataclass(frozen=True)
class Policy:
    max_attempts: int = 3
    accept_at: float = decide.ACCEPT_AT
    review_floor: float = decide.REVIEW_FLOOR
    verify_band: tuple[float, float] | None = (0.6, 0.8)
    audit_rate: float = 0.0
    candidates: int = 30
    chars: int = 8000 * 4
    alternate_queues: bool = False
    deduplicate_candidates: bool = False


@dataclass(frozen=True)
class Models:
    """What a pass asks, as columns of ``source`` (a source's text) and of candidates.

    ``select`` scores a candidate's fit (of the best, of equals the first, the answer is its key; below
    ``select_floor`` it is none), ``score`` is how sure the choice is, ``verify`` a second opinion on the choice
    (``support``, ``disagree``, ``no_match``), ``leads`` keys that deserve a look (an array, from ``keys`` ranked
    by fit), ``searches`` and ``rewrites`` new queries (arrays), ``failure`` a reason for a call that broke, by
    ``attempt``.
    """

    select: Callable[[Column, Column], Column]
    score: Callable[[Column, Column], Column]
    verify: Callable[[Column, Column], Column]
    searches: Callable[[Column], Column] = field(default=lambda source: F.array().cast("array<string>"))
    rewrites: Callable[[Column], Column] = field(default=lambda source: F.array().cast("array<string>"))
    failure: Callable[[Column, Column], Column] = field(default=lambda source, attempt: F.lit(None).cast("string"))
    select_floor: float = 0.0
    leads: int = 0


def lexical_models(select_floor: float = 0.2, support: float = 0.5) -> Models:
    """Goes by the overlap of words of the source and the candidate's text."""
    words = lambda c: F.array_distinct(F.filter(F.split(tx.match_key(c), " "), lambda x: x != ""))
    fit = lambda source, text: F.round(tx.jaccard(words(source), words(text)), 4)
    half = lambda source: F.array(F.array_join(F.slice(F.split(source, " "), 1, F.greatest(F.lit(1), F.floor(F.size(F.split(source, " ")) / 2).cast("int"))), " "))
    return Models(fit, fit, lambda source, text: F.when(fit(source, text) >= support, "support").otherwise("disagree"), rewrites=half, select_floor=select_floor, leads=1)


WORK = "array<struct<kind: string, value: string, id: string, attempt: int>>"


def first_state(sources: DataFrame) -> DataFrame:
    """Each source with its own query in the queue; ``queries`` (an array) if it has several, else its ``text``."""
    asked = F.col("queries") if "queries" in sources.columns else F.array("text")
    queries = tx.rendered_list(asked) if "queries" in sources.columns else F.filter(asked, lambda q: F.trim(F.coalesce(q, F.lit(""))) != "")
    text = F.array_join(queries, "\n")  # several queries are one search, fused
    item = lambda value: F.struct(F.lit("query").alias("kind"), value.alias("value"), F.lit(None).cast("string").alias("id"), F.lit(0).alias("attempt"))
    none = F.array().cast("array<string>")
    return sources.select(F.col("source_id").cast("string").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("attempt"), F.array(item(text)).cast(WORK).alias("queue"), F.transform(queries, tx.normalise_query).alias("seen"), none.alias("chased"), none.alias("done"), F.lit(None).cast("struct<kind: string, value: string, id: string, attempt: int>").alias("work"), F.lit(False).alias("retry"), F.lit(True).alias("turn"))


def attempt(frontier: DataFrame, targets: DataFrame, search: Callable[[DataFrame, int], DataFrame], models: Models, policy: Policy) -> DataFrame:
    """One pass: for each source its choice, score, second opinion, leads and new queries.

    ``search`` gives ``query_id``, ``id``, ``rank`` for ``query_id``, ``text``; ``targets`` have ``id``, ``text``.
    """
    asked = frontier.select("source_id", "text", "attempt", F.col("work.kind").alias("kind"), F.col("work.value").alias("value"), F.col("work.id").alias("forced"))
    # Several queries of a source are lines of one value; each votes, and the votes are fused.
    lines = asked.select("source_id", F.posexplode(F.split("value", "\n")).alias("line", "query"))
    named = lines.withColumn("query_id", F.concat_ws("\n", "source_id", F.col("line").cast("string")))
    hits = search(named.select("query_id", F.col("query").alias("text")), policy.candidates).select("query_id", F.col("id").cast("string").alias("id"), "rank")
    votes = hits.select(F.substring_index("query_id", "\n", 1).alias("query_id"), "id", F.concat(F.lit("line"), F.substring_index("query_id", "\n", -1)).alias("retriever"), "rank")
    fused = retrieval.top(retrieval.fuse(votes), policy.candidates * 4)
    fused = store.Work(frontier.sparkSession, "hits").save(fused, "fused")  # read twice: to be counted, and to be joined
    shown = targets.select(F.col("id").cast("string").alias("id"), F.col("text").alias("candidate")).join(store.few(fused), "id")
    ranked = shown.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    kept = retrieval.within_budget(ranked, F.length("candidate"), policy.candidates, policy.chars)
    rows = asked.join(kept.withColumnRenamed("query_id", "source_id"), "source_id", "left")
    source, text, fits = F.col("text"), F.col("candidate"), F.col("kept")
    fit = F.when(fits & (F.col("forced").isNull() | (F.col("id") == F.col("forced"))), models.select(source, text))
    entry = F.struct(fit.alias("fit"), (-F.col("rank")).alias("order"), F.col("id").alias("id"), models.score(source, text).alias("score"), models.verify(source, text).alias("opinion"))
    one = rows.groupBy("source_id", "text", "attempt", "kind", "forced").agg(
        F.count("id").alias("candidate_count"), F.count_if(fits).alias("shown"), F.max(F.when(fit.isNotNull(), entry)).alias("best"),
        F.transform(F.reverse(F.array_sort(F.collect_list(F.when(fits, F.struct(models.select(source, text).alias("fit"), (-F.col("rank")).alias("order"), F.col("id").alias("id")))))), lambda x: x.id).alias("by_fit"),
    )
    b, broken = F.col("best"), models.failure(F.col("text"), F.col("attempt"))
    reason = F.when(broken.isNotNull(), broken).when((F.col("candidate_count") > 0) & (F.col("shown") == 0), OVER)
    chooses = reason.isNull() & b.isNotNull() & ((b.fit >= models.select_floor) | F.col("forced").isNotNull())
    chosen, score = F.when(chooses, b.id), F.when(chooses, b.score)
    asks = decide.should_verify(score, *policy.verify_band) if policy.verify_band else F.lit(False)
    audited = decide.should_audit("match", F.col("source_id"), score, policy.verify_band[1] if policy.verify_band else 1.0, policy.audit_rate)
    opinion = F.when(chooses & (asks | audited), b.opinion)
    others = F.filter("by_fit", lambda x: ~x.eqNullSafe(chosen))
    none = F.array().cast("array<string>")
    out = one.select(
        "source_id", "attempt", score.alias("score"), chosen.alias("chosen_id"), F.when(chooses, "exact_key").otherwise("abstain").alias("resolution"), opinion.alias("verifier"), reason.alias("reason"),
        F.col("candidate_count").cast("int").alias("candidate_count"), F.when(reason == RETRIEVER, 1).otherwise(0).alias("retrieval_failures"), audited.alias("audited"),
        F.when((opinion == "disagree") & (F.size(others) > 0), F.slice(others, 1, 1)).otherwise(none).alias("verifier_lead"),
        F.when(reason.isNull(), F.slice(others, 1, models.leads) if models.leads else none).otherwise(none).alias("leads"),
        F.when(reason.isNull(), models.searches(F.col("text"))).otherwise(none).alias("searches"), models.rewrites(F.col("text")).alias("rewrites"),
    )
    return out.withColumn("accepted", F.coalesce(decide.acceptable(policy.accept_at), F.lit(False)))


def without(items: Column, others: Column) -> Column:
    return F.filter(items, lambda x: ~F.array_contains(others, x))


def advanced(frontier: DataFrame, outcome: DataFrame, policy: Policy) -> DataFrame:
    """The frontier of the next pass, of the sources that are not done: each row's arrays tell what it does next.

    After an outage the same work is tried again. Else a verifier's leads go before all that waits, a scorer's after
    it, then new queries (rewrites only where nothing else is left); forms of a query that were asked are not asked
    again. A candidate is taken before a query, or by turns.
    """
    none = F.array().cast("array<string>")
    what = outcome.select("source_id", "reason", "accepted", "chosen_id", *(F.coalesce(F.col(c), none).alias(c) for c in ("verifier_lead", "leads", "searches", "rewrites")))
    rows = frontier.join(what, "source_id").where(~F.coalesce(F.col("reason").isin(FATAL, OVER), F.lit(False)) & ~F.col("accepted") & (F.col("attempt") + 1 < policy.max_attempts))
    same = F.coalesce(F.col("reason").isin(*SAME_WORK), F.lit(False))
    item = lambda kind, value, who: F.struct(F.lit(kind).alias("kind"), value.alias("value"), who.cast("string").alias("id"), F.col("attempt").alias("attempt"))
    follow = lambda who: item("candidate", F.col("work.value"), who)
    waiting = lambda queue: F.transform(F.filter(queue, lambda w: w.kind == "candidate"), lambda w: w.id)
    rows = rows.withColumn("done2", F.when(F.col("chosen_id").isNull(), F.col("done")).otherwise(F.concat("done", F.array("chosen_id"))))
    first = F.array_distinct(without(F.col("verifier_lead"), F.col("chased")))
    if policy.deduplicate_candidates:
        first = without(without(first, F.col("done2")), waiting(F.col("queue")))
    rows = rows.withColumn("first", first).withColumn("queue2", F.concat(F.transform(F.reverse("first"), follow), "queue").cast(WORK))
    then = F.col("leads")
    if policy.deduplicate_candidates:
        then = F.array_distinct(without(without(then, F.col("done2")), waiting(F.col("queue2"))))
    rows = rows.withColumn("queue3", F.concat("queue2", F.transform(then, follow)).cast(WORK))
    wanted = F.concat("searches", F.when((F.size("queue3") == 0) & (F.size("searches") == 0), F.col("rewrites")).otherwise(none))
    rows = rows.withColumn("wanted", wanted).withColumn("forms", F.transform("wanted", tx.normalise_query))
    fresh = lambda q, k: (F.get(F.col("forms"), k) != "") & ~F.array_contains("seen", F.get(F.col("forms"), k)) & (F.array_position("forms", F.get(F.col("forms"), k)) == k + 1)
    rows = rows.withColumn("new", F.filter("wanted", fresh)).withColumn("queue4", F.concat("queue3", F.transform("new", lambda q: item("query", q, F.lit(None)))).cast(WORK))
    kinds = rows.withColumn("kinds", F.transform("queue4", lambda w: w.kind)).where(same | (F.size("queue4") > 0))
    candidate = F.array_contains("kinds", "candidate")
    if policy.alternate_queues:
        candidate = candidate & (F.col("turn") | ~F.array_contains("kinds", "query"))
    at = F.array_position("kinds", F.when(candidate, "candidate").otherwise("query")).cast("int")
    moved = kinds.withColumn("at", at).withColumn("next", F.get("queue4", F.col("at") - 1))
    keep = lambda name, new: F.when(same, F.col(name)).otherwise(new).alias(name)
    return moved.select(
        "source_id", "text", (F.col("attempt") + 1).alias("attempt"), keep("queue", F.filter("queue4", lambda w, k: k != F.col("at") - 1)), keep("seen", F.concat("seen", F.transform("new", tx.normalise_query))),
        keep("chased", F.concat("chased", "first")), keep("done", F.col("done2")), keep("work", F.col("next")), same.alias("retry"), keep("turn", F.col("next.kind") == "query"),
    )


def match(sources: DataFrame, targets: DataFrame, search: Callable[[DataFrame, int], DataFrame], models: Models, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(results, attempts) of all sources: ``source_id``, ``text`` and perhaps ``queries``."""
    work = store.Work(sources.sparkSession, "match")
    state = first_state(sources)
    start = F.get(F.col("queue"), F.lit(0))
    frontier = work.save(state.withColumn("work", start).withColumn("queue", F.array().cast(WORK)).withColumn("turn", F.lit(True)), "frontier0")
    attempts: list[DataFrame] = []
    for k in range(policy.max_attempts):
        outcome = work.save(attempt(frontier, targets, search, models, policy), f"attempts{k}")
        attempts.append(outcome)
        if k + 1 == policy.max_attempts:
            break
        frontier = work.save(advanced(frontier, outcome, policy), f"frontier{k + 1}")
        if not frontier.limit(1).count():
            break
    every = attempts[0]
    for more in attempts[1:]:
        every = every.unionByName(more)
    rows = sources.select(F.col("source_id").cast("string").alias("source_id")).join(every, "source_id", "left")
    return decide.derive_status(rows, accept_at=policy.accept_at, review_floor=policy.review_floor), every


# The decider's path: one pass, and one more for what the first missed.


@dataclass(frozen=True)
class Decider:
    """Probabilities as columns of a source's and a candidate's text: ``screen``, and of the one chosen ``rubric`` (a level)
    and ``properties`` by name; ``rewrites`` are queries of a second pass."""

    screen: Callable[[Column, Column], Column]
    rubric: Callable[[Column, Column], Column]
    properties: dict[str, Callable[[Column, Column], Column]]
    rewrites: Callable[[Column], Column] | None = None
    levels: int = 4
    max_candidates: int = 300
    shortlist: int = 15
    shortlist_floor: float = 0.20


def lexical_decider(rewrites: Callable[[Column], Column] | None = None) -> Decider:
    """Goes by the overlap of words, as the offline decider does."""
    words = lambda c: F.array_distinct(F.filter(F.split(tx.match_key(c), " "), lambda x: x != ""))
    fit = lambda source, text: F.round(tx.jaccard(words(source), words(text)), 4)
    return Decider(fit, lambda s, t: F.round(fit(s, t) * 3, 0), {"same_words": fit}, rewrites)


def screened(asked: DataFrame, hits: DataFrame, targets: DataFrame, model: Decider) -> DataFrame:
    """``source_id``, ``id``, ``rank``, ``p`` of each candidate that is screened."""
    shown = hits.where(F.col("rank") <= model.max_candidates).select(F.col("query_id").alias("source_id"), F.col("id").cast("string").alias("id"), "rank")
    shown = store.Work(asked.sparkSession, "hits").save(shown, "shown")  # read twice: to be counted, and to be joined
    rows = targets.select(F.col("id").cast("string").alias("id"), F.col("text").alias("candidate")).join(store.few(shown), "id").join(asked.select(F.col("source_id").cast("string").alias("source_id"), "text"), "source_id")
    return rows.select("source_id", "id", "rank", model.screen(F.col("text"), F.col("candidate")).alias("p"))


def merged_screens(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two screens as one: the first's order before new ones, and the higher probability of those in both."""
    both = first.withColumn("turn", F.lit(1)).unionByName(second.withColumn("turn", F.lit(2)))
    one = both.groupBy("source_id", "id").agg(F.min(F.struct("turn", "rank")).alias("at"), F.max("p").alias("p"))
    return one.select("source_id", "id", F.row_number().over(Window.partitionBy("source_id").orderBy("at", "id")).alias("rank"), "p")


def decide_sources(sources: DataFrame, targets: DataFrame, search: Callable[[DataFrame, int], DataFrame], model: Decider) -> DataFrame:
    """``source_id``, ``matched_id``, ``status``, ``reason``, ``confidence`` and the signals behind them.

    A source whose best screen stays below the floor gets a second pass with rewritten queries, if there are any.
    """
    work = store.Work(sources.sparkSession, "decide")
    asked = sources.select(F.col("source_id").cast("string").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"))
    find = lambda rows: search(rows.select(F.col("source_id").alias("query_id"), "text"), model.max_candidates)
    seen = work.save(screened(asked, find(asked), targets, model), "screen")
    if model.rewrites is not None:
        best = seen.groupBy("source_id").agg(F.max("p").alias("best"))
        missed = asked.join(best, "source_id", "left").where(F.coalesce("best", F.lit(0.0)) < decide.SCREEN_FLOOR)
        again = missed.select("source_id", F.explode(model.rewrites(F.col("text"))).alias("text")).where(F.trim("text") != "")
        more = retrieval.top(retrieval.fuse(find(again.withColumn("source_id", F.concat_ws("\n", "source_id", "text"))).withColumn("retriever", F.col("query_id")).withColumn("query_id", F.substring_index("query_id", "\n", 1))), model.max_candidates)
        seen = work.save(merged_screens(seen, screened(asked, more, targets, model)), "screens")
    counted = seen.groupBy("source_id").agg(F.count("*").alias("candidate_count"), F.max("p").alias("screen_best"))
    short = retrieval.top(seen.withColumnRenamed("p", "score").drop("rank").join(seen.select("source_id", "id", F.col("rank").alias("place")), ["source_id", "id"]), model.shortlist, ("source_id",), "place").where(F.col("score") >= model.shortlist_floor)
    open_ = short.join(counted.where(F.col("screen_best") >= decide.SCREEN_FLOOR).select("source_id"), "source_id", "left_semi")
    choice = decide.overlap_choice(open_.select(F.col("source_id").alias("query_id"), "id", "rank", F.col("score").alias("overlap"))).withColumnRenamed("query_id", "source_id")
    choice = work.save(choice, "choice")
    texts = targets.select(F.col("id").cast("string").alias("id"), F.col("text").alias("candidate")).join(store.few(choice.select("id").distinct()), "id", "left_semi")
    gated = choice.join(texts, "id", "left").join(asked, "source_id").join(seen.select("source_id", "id", F.col("p").alias("screen_chosen")), ["source_id", "id"], "left")
    s, t = F.col("text"), F.col("candidate")
    some = F.col("id").isNotNull()
    gated = gated.select("source_id", F.col("id").alias("chosen"), "p_choice", "p_none", "screen_chosen", F.when(some, model.rubric(s, t)).alias("rubric"), F.when(some, F.least(*(p(s, t) for p in model.properties.values()), F.lit(1.0))).alias("least_property"), F.create_map(*(x for n, p in model.properties.items() for x in (F.lit(n), F.when(some, p(s, t))))).alias("properties"))
    rows = asked.join(counted, "source_id", "left").join(gated, "source_id", "left").withColumn("abstained", F.col("chosen").isNull()).withColumn("exact_key", F.col("chosen").isNotNull()).withColumn("failed", F.lit(False)).withColumn("degraded", F.lit(False))
    rows = rows.withColumn("p_none", F.coalesce("p_none", F.lit(1.0))).withColumn("v", decide.decider_status(model.levels))
    keeps = F.col("v.status").isin("matched", "needs_review")
    return rows.select("source_id", F.when(keeps, F.col("chosen")).alias("matched_id"), "v.status", "v.reason", F.col("screen_chosen").alias("confidence"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), "screen_best", "screen_chosen", "p_choice", "p_none", "rubric", "least_property", "properties", decide.explanation().alias("explanation"))
