"""The life of a run: limits, failures, kills between and within passes, and what is refused."""

import pytest
from pyspark.sql import functions as F

from tallyweave import store
from tallyweave.operators import batch


def decided(status="matched"):
    seen = []

    def decide(some):
        seen.append({r.source_id for r in some.collect()})
        return some.select("source_id", F.lit(status).alias("status"), F.concat(F.lit("t"), "source_id").alias("matched_id"), F.lit(0.9).alias("confidence"))

    decide.seen = seen
    return decide


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([(i,) for i in range(40)], "source_id long")


def ended(run):
    return [(r.n, r.state, r.exit_code, r.decided) for r in run.invocations().orderBy("n").collect()]


def test_limits_and_resuming(spark, sources, tmp_path):
    run, one, two = batch.BatchRun(spark, str(tmp_path / "r"), {"a": "1"}), decided(), decided()
    assert run.invoke(sources, one, passes=2, limit=10) == ("partial", 1)
    assert set().union(*one.seen) == set(range(10))
    again = batch.BatchRun(spark, str(tmp_path / "r"), {"a": "1"})
    assert again.invoke(sources, two, passes=2) == ("complete", 0)
    assert set().union(*two.seen) == set(range(10, 40)) and again.results().count() == 40
    three = decided()
    assert again.invoke(sources, three, passes=2) == ("complete", 0) and set().union(*three.seen) == set()
    assert ended(again) == [(1, "partial", 1, 10), (2, "complete", 0, 30), (3, "complete", 0, 0)]


def test_a_kill_between_passes_repeats_nothing_committed(spark, sources, tmp_path):
    run, plain = batch.BatchRun(spark, str(tmp_path / "r"), {}), decided()

    def killed(some):
        if len(plain.seen) == 2:
            raise KeyboardInterrupt
        return plain(some)

    with pytest.raises(KeyboardInterrupt):
        run.invoke(sources, killed, passes=4)
    first = set().union(*plain.seen)
    assert run.results().count() == len(first) and ended(run) == [(1, "interrupted", 130, len(first))]
    after = decided()
    assert run.invoke(sources, after, passes=4) == ("complete", 0)
    assert set().union(*after.seen) == set(range(40)) - first


def test_a_process_that_dies_leaves_an_interrupted_invocation(spark, sources, tmp_path):
    run = batch.BatchRun(spark, str(tmp_path / "r"), {})
    assert run.begin() == 1 and ended(run) == [(1, "interrupted", 130, None)]
    # A pass that was written and never committed doesn't count.
    spark.createDataFrame([(1, "matched")], "source_id long, status string").write.parquet(f"{tmp_path}/r/results/data/00000000-dead/bucket=1")
    assert run.results() is None and run.invoke(sources, decided(), passes=1) == ("complete", 0)
    assert [x[:2] for x in ended(run)] == [(1, "interrupted"), (2, "complete")]


def test_errors_abort_and_failures_are_tried_again(spark, sources, tmp_path):
    run = batch.BatchRun(spark, str(tmp_path / "r"), {})

    def broken(some):
        raise RuntimeError("provider down")

    with pytest.raises(RuntimeError):
        run.invoke(sources, broken, passes=1)
    assert ended(run) == [(1, "aborted", 3, 0)] and run.invocations().first().detail == "provider down"
    assert run.invoke(sources, decided("failed"), passes=1) == ("failed", 3)
    assert run.invoke(sources, decided("needs_review"), passes=1)[1] == 1
    kept = {(r.source_id, r.revision, r.status, r.current) for r in batch.revisions(run).collect()}
    assert {x for x in kept if x[0] == 7} == {(7, 1, "failed", False), (7, 2, "needs_review", True)}


def test_another_identity_and_repeated_ids_are_refused(spark, sources, tmp_path):
    batch.BatchRun(spark, str(tmp_path / "r"), {"rule": "x", "depth": "1"})
    with pytest.raises(batch.OtherRun) as e:
        batch.BatchRun(spark, str(tmp_path / "r"), {"rule": "y", "depth": "1"})
    assert e.value.differences == ["rule"]
    with pytest.raises(ValueError, match="twice"):
        batch.BatchRun(spark, str(tmp_path / "q"), {}).invoke(sources.union(sources), decided())


def test_an_end_is_said_once(spark, tmp_path):
    run = batch.BatchRun(spark, str(tmp_path / "r"), {})
    n = run.begin()
    run.end(n, "complete", 0, 5)
    run.end(n, "aborted", 3, 0)
    assert ended(run) == [(1, "complete", 0, 5)] and run.begin() == 2
    assert store.names_in(spark, f"{tmp_path}/r/nothing") == []
