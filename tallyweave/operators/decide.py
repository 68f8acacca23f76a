"""Reducers from a record's evidence to its status, as CASE logic over windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ids import draw

ACCEPT_AT, REVIEW_FLOOR = 0.6, 0.4
#: Reasons that count as failures of an attempt, and those that forbid a negative result.
FAILURES = ("provider_failure", "retriever_failure", "fatal_provider_failure", "unresolved_output", "candidate_budget_exceeded")
BLOCKING = ("provider_failure", "retriever_failure")
#: Defaults of the decider.
SCREEN_FLOOR, NONE_AT, CHOOSE_AT, DECIDER_ACCEPT, PROPERTY_FLOOR = 0.30, 0.70, 0.50, 0.85, 0.50


def should_verify(score: Column, low: float, high: float) -> Column:
    return F.coalesce(score.between(low, high), F.lit(False))


def should_audit(salt: str, record_id: Column, score: Column, high: float, rate: float) -> Column:
    """A fixed share of records above the verify band, the same on every run."""
    return F.coalesce((score > high) & (draw(salt, record_id) < rate), F.lit(False))


def sound() -> Column:
    """On an attempt's columns reason, chosen_id, score, resolution, verifier: acceptable, if its score is high enough."""
    return F.col("reason").isNull() & F.col("chosen_id").isNotNull() & tx.is_valid_score(F.col("score")) & (F.col("resolution") == "exact_key") & (F.col("verifier").isNull() | (F.col("verifier") == "support"))


def acceptable(accept_at: float | Column = ACCEPT_AT) -> Column:
    return sound() & F.coalesce(F.col("score") >= accept_at, F.lit(False))


def evidence(attempts: DataFrame, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """What all attempts of a source say, whatever the thresholds: one aggregate.

    A source without attempts is a row with a null ``attempt``.
    """
    real, reason, score = F.col("attempt").isNotNull(), F.col("reason"), F.col("score")
    ok = real & sound()
    scored = real & F.col("chosen_id").isNotNull() & tx.is_valid_score(score)
    failed = F.coalesce(reason.isin(*FAILURES), F.lit(False))
    order = F.struct((-score).alias("s"), F.col("attempt"))
    best = F.struct((-score).alias("s"), failed.alias("f"), F.col("attempt"))
    state = F.struct("chosen_id", "score", "resolution", "verifier")
    blocking = real & (F.coalesce(reason.isin(*BLOCKING), F.lit(False)) | (F.col("retrieval_failures") > 0))
    latest = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col("attempt")))
    return attempts.groupBy(*keys).agg(
        F.count_if(real).alias("n"),
        F.count_if(real & reason.isNull()).alias("n_clear"),
        F.coalesce(F.bool_or(reason == "fatal_provider_failure"), F.lit(False)).alias("fatal"),
        F.min_by(F.when(ok, F.struct("chosen_id", "score")), F.when(ok, order)).alias("winner"),
        latest(reason, real).alias("last_reason"),
        F.coalesce(F.bool_or(reason == "candidate_budget_exceeded"), F.lit(False)).alias("over_budget"),
        F.min_by(F.when(scored, state), F.when(scored, best)).alias("best"),
        F.coalesce(F.bool_or(real & (F.col("resolution") == "unresolved")), F.lit(False)).alias("unresolved"),
        F.coalesce(F.bool_or(F.col("candidate_count") > 0), F.lit(False)).alias("some_candidates"),
        F.coalesce(F.bool_or(blocking), F.lit(False)).alias("blocked"),
        latest(F.when(reason.isin(*BLOCKING), reason).otherwise("retriever_failure"), blocking).alias("block_reason"),
    )


def status_of(found: DataFrame, keys: tuple[str, ...] = ("source_id",), accept_at: float | Column = ACCEPT_AT, review_floor: float | Column = REVIEW_FLOOR) -> DataFrame:
    """Status, reason, matched_id and confidence from evidence; thresholds may be columns of it.

    The winner is the sound attempt of the highest score, so it alone tells whether any reaches a threshold.
    """
    b, won = F.col("best"), F.col("winner").isNotNull() & (F.col("winner.score") >= accept_at)
    rules = [
        (F.col("n") == 0, "failed", F.lit("provider_failure")),
        (F.col("fatal"), "failed", F.lit("fatal_provider_failure")),
        (won, "matched", F.lit("accept_threshold")),
        (F.col("n_clear") == 0, "failed", F.col("last_reason")),
        (F.col("over_budget"), "needs_review", F.lit("candidate_budget_exceeded")),
        (b.isNotNull() & b.verifier.isin("disagree", "no_match"), "needs_review", F.lit("verifier_disagreement")),
        (b.isNotNull() & b.verifier.isNotNull() & (b.verifier != "support"), "needs_review", F.lit("provider_failure")),
        (b.isNotNull() & (b.resolution != "exact_key"), "needs_review", F.lit("unresolved_output")),
        (b.isNotNull() & (b.score >= accept_at), "needs_review", F.lit("provider_failure")),
        (b.isNotNull() & (b.score >= review_floor), "needs_review", F.lit("below_accept_threshold")),
        (b.isNull() & F.col("unresolved"), "needs_review", F.lit("unresolved_output")),
        (F.col("blocked"), "failed", F.col("block_reason")),  # a degraded search can't say no
        (b.isNotNull(), "unmatched", F.lit("below_review_floor")),
        (F.col("some_candidates"), "unmatched", F.lit("selector_abstained")),
    ]
    status, why = F.lit("unmatched"), F.lit("no_candidates")
    for when, name, cause in reversed(rules):
        status, why = F.when(when, name).otherwise(status), F.when(when, cause).otherwise(why)
    top = F.when(won, F.col("winner")).otherwise(F.struct(b.chosen_id.alias("chosen_id"), b.score.alias("score")))
    out = found.select(*keys, status.alias("status"), why.alias("reason"), top.alias("top"), F.col("n").alias("attempts"))
    return out.select(*keys, "status", "reason", F.when(F.col("status").isin("matched", "needs_review"), F.col("top.chosen_id")).alias("matched_id"), F.col("top.score").alias("confidence"), "attempts")


def derive_status(attempts: DataFrame, keys: tuple[str, ...] = ("source_id",), accept_at: float = ACCEPT_AT, review_floor: float = REVIEW_FLOOR) -> DataFrame:
    """Status, reason, matched_id and confidence of each source from all its attempts."""
    return status_of(evidence(attempts, keys), keys, accept_at, review_floor)


def decider_status(levels: int = 4, accept_at: float = DECIDER_ACCEPT) -> Column:
    """(status, reason) on columns screen_best, screen_chosen, p_choice, p_none, abstained, exact_key, rubric, least_property, failed, degraded."""
    c = F.col
    floor = max(0, levels - 2)
    accepted = (c("screen_chosen") >= accept_at) & (c("p_choice") >= CHOOSE_AT) & c("rubric").between(0, levels - 1) & (c("rubric") >= floor) & (c("least_property") >= PROPERTY_FLOOR)
    rules = [
        (c("failed"), "failed", "retriever_failure"),
        (c("screen_best").isNull(), "unmatched", "no_candidates"),
        (c("screen_best") < SCREEN_FLOOR, "unmatched", "below_review_floor"),
        (c("abstained") & (c("p_none") >= NONE_AT), "unmatched", "selector_abstained"),
        (c("abstained") | ~c("exact_key") | c("screen_chosen").isNull(), "needs_review", "unresolved_output"),
        (F.coalesce(accepted, F.lit(False)), "matched", "accept_threshold"),
    ]
    status, reason = F.lit("needs_review"), F.lit("below_accept_threshold")
    for when, name, why in reversed(rules):
        status, reason = F.when(when, name).otherwise(status), F.when(when, why).otherwise(reason)
    degraded = (status == "unmatched") & c("degraded")
    return F.struct(F.when(degraded, "failed").otherwise(status).alias("status"), F.when(degraded, "retriever_failure").otherwise(reason).alias("reason"))


def overlap_choice(overlaps: DataFrame) -> DataFrame:
    """The offline decider's choice from ``query_id``, ``id``, ``rank``, ``overlap``: the largest overlap, of equals the later key.

    Without any overlap it chooses none. Probabilities are shares of all overlaps.
    """
    best = overlaps.groupBy("query_id").agg(F.max_by("id", F.struct("overlap", "rank")).alias("id"), F.max("overlap").alias("overlap"), F.sum("overlap").alias("total"))
    some = F.col("overlap") > 0
    return best.select("query_id", F.when(some, F.col("id")).alias("id"), "overlap", F.when(some, F.col("overlap") / F.col("total")).otherwise(0.0).alias("p_choice"), F.when(some, 0.0).otherwise(1.0).alias("p_none"))


def explanation() -> Column:
    """The numbers behind a decision in one line."""
    part = lambda name, label: F.when(F.col(name).isNotNull(), F.concat(F.lit(label), F.format_string("%.2f", F.col(name))))
    return F.concat_ws("; ", part("screen_best", "best screen "), part("screen_chosen", "chosen screen "), part("p_choice", "choice "), part("p_none", "none "))
