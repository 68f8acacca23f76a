"""Replays of recorded attempts, and what is small enough to be broadcast."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tallyweave import store
from tallyweave.operators import evaluate, matcher


def test_replay_by_status_and_gold(spark):
    rows = [(1, 0, 0.9, 10), (2, 0, 0.7, 20), (3, 0, 0.7, 31), (4, 0, 0.2, 40), (5, 0, 0.7, 50)]
    attempts = spark.createDataFrame(rows, "source_id long, attempt int, score double, chosen_id long").withColumns({"resolution": F.lit("exact_key"), "verifier": F.lit(None).cast("string"), "reason": F.lit(None).cast("string"), "candidate_count": F.lit(1), "retrieval_failures": F.lit(0)})
    gold = spark.createDataFrame([(1, [10]), (2, [20]), (3, [30]), (4, [])], "source_id long, gold_ids array<long>")
    recorded = matcher.Policy(accept_at=0.6, review_floor=0.4)
    got = {tuple(r) for r in evaluate.replay(attempts, gold, recorded, replace(recorded, accept_at=0.8)).collect()}
    assert got == {
        ("status", "matched", "matched", 1), ("status", "matched", "needs_review", 3), ("status", "unmatched", "unmatched", 1),
        ("gold", "accepted_correct", "accepted_correct", 1), ("gold", "accepted_correct", "review", 1), ("gold", "accepted_wrong", "review", 1), ("gold", "correct_no_match", "correct_no_match", 1), ("gold", "unlabelled", "unlabelled", 1),
    }
    assert evaluate.replay(attempts.limit(0), gold, recorded, recorded).count() == 0


def test_replay_refuses_what_needs_new_calls():
    recorded = matcher.Policy()
    evaluate.refuse_unrecorded(recorded, replace(recorded, accept_at=0.9, review_floor=0.1))
    with pytest.raises(ValueError, match="candidates, alternate_queues"):
        evaluate.refuse_unrecorded(recorded, replace(recorded, candidates=5, alternate_queues=True))
    with pytest.raises(ValueError, match="another kind"):
        evaluate.refuse_unrecorded(recorded, object())


def test_nothing_is_recommended_below_the_target(spark):
    rows = spark.createDataFrame([(0.9, 0.9, True, False)], "confidence double, p_choice double, labelled boolean, correct boolean")
    assert evaluate.recommended(evaluate.fit_grid(rows, [0.5], [0.5], 0.5)).count() == 0


def test_few_counts_rows_and_bytes(spark):
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.lit(None).cast("string"), F.lit("ab")).alias("many"))
    assert store.is_few(rows) and store.is_few(rows, 100)
    assert not store.is_few(rows, 99) and not store.is_few(rows, most_bytes=100_000)
    assert store.is_few(rows.select("id"), most_bytes=800) and not store.is_few(rows.select("id"), most_bytes=799)
    assert store.is_few(rows.limit(0)) and store.is_few(spark.range(3).select(F.lit(None).cast("string").alias("odd.name")))
