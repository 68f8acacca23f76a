"""Clustering in rounds: small collections by hand, invariants on random ones, and blocks that fail."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import engine


def log_of(spark, labels, judge=engine.lexical_judge, blocks=None, **settings):
    rows = [(str(i), t, blocks[i] if blocks else "b") for i, t in enumerate(labels)]
    return engine.cluster_blocks(spark.createDataFrame(rows, "id string, label string, block string"), F.col("block"), judge, engine.Settings(**settings))


def members(log):
    return {r.source_id: r for r in engine.selected_members(log).collect()}


def groups(log):
    found = collections.defaultdict(list)
    for i, r in members(log).items():
        if r.cluster_id:
            found[r.cluster_id].append(i)
    return sorted(sorted(g) for g in found.values())


def test_joins_mints_and_copies(spark):
    log = log_of(spark, ["red cat big", "red cat big", "Red  big CAT", "blue dog", "zebra", "red cat big old wise x", None])
    got = members(log)
    assert groups(log)[0] == ["0", "1", "2"] and ["4"] in groups(log) and ["6"] in groups(log)
    assert got["3"].outcome == "singleton" and got["4"].reason == "minted:neighbours_exhausted"
    assert sorted(r.order_index for r in got.values()) == list(range(7))
    assert engine.run_summary(log).first().stop_reason == "converged"


def test_unsure_items_stay_open(spark):
    got = members(log_of(spark, ["a b c d e f g", "a b c d e x y", "q"]))  # 5 of 9 words: unlike, but not surely
    assert {got["0"].outcome, got["1"].outcome} == {"singleton", "needs_review"}
    last = got["0"] if got["0"].outcome == "needs_review" else got["1"]
    assert last.reason == "novelty_below_threshold" and last.proposal_cluster_id and last.cluster_id is None


def test_repeated_ids_are_refused(spark):
    with pytest.raises(ValueError, match="repeated"):
        engine.cluster_blocks(spark.createDataFrame([("1", "a"), ("1", "b")], "id string, label string"), F.lit("b"))


def test_blocks_never_meet(spark):
    log = log_of(spark, ["red cat big"] * 4, blocks=["x", "x", "y", None])
    assert groups(log) == [["0", "1"], ["2"], ["3"]]
    assert {r.block for r in engine.run_summary(log).collect()} == {"x", "y", ""}


def test_clusters_merge_by_mutual_choice(spark):
    log = log_of(spark, ["red cat big fat one", "red cat big fat two", "red cat big fat", "blue dog"], retrieve_limit=1, shown_limit=1)
    assert ["3"] in groups(log) and sum(map(len, groups(log))) + sum(r.cluster_id is None for r in members(log).values()) == 4
    assert engine.partition_faults(engine.selected_members(log), engine.selected_clusters(log)).count() == 0


def test_random_collections_are_partitions(spark):
    rng = np.random.default_rng(4)
    roots = [" ".join(f"r{r}w{k}" for k in range(8)) for r in range(8)]
    labels = [" ".join(w for w in roots[r].split() if rng.random() > 0.06) + (" extra" if rng.random() < 0.2 else "") for r in rng.integers(0, 8, 70)]
    log = log_of(spark, labels, blocks=["k" + str(i % 2) for i in range(70)])
    got, clusters = engine.selected_members(log), engine.selected_clusters(log)
    assert got.count() == 70 and engine.partition_faults(got, clusters).count() == 0
    for r in clusters.collect():
        own = r.member_ids.split("|")
        assert len(own) == r.size and r.seed_id in own
        assert len({labels[int(i)].split()[0].split("w")[0] for i in own}) == 1  # no cluster mixes two roots
        assert len({int(i) % 2 for i in own}) == 1
    joined = sum(r.size for r in clusters.collect() if r.size > 1)
    assert joined > 50
    assert {r.stop_reason for r in engine.run_summary(log).collect()} <= {"converged", "oscillation", "max_iterations"}
    assert {r.code for r in engine.warnings(log).collect()} <= {"unresolved_share", "not_converged", "all_singletons", "single_cluster"}


def test_failed_items_are_decided_again(spark):
    said = engine.lexical_judge()
    down = lambda: engine.Judge(lambda a, b: F.when(~a.contains("zebra") & ~b.contains("zebra"), said.alike(a, b)))
    labels = ["red cat big", "red cat big zebra", "blue dog"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(labels)], "id string, label string")
    log = engine.cluster_blocks(rows, F.lit("b"), down)
    before = members(log)
    failed = [i for i, r in before.items() if r.outcome == "failed"]
    assert failed in (["0"], ["1"]) and before[failed[0]].reason == "invalid_output"
    after = members(engine.resumed(rows, F.lit("b"), log))
    assert after["0"].cluster_id == after["1"].cluster_id and after[failed[0]].reason == "verified" and after["2"].cluster_id == before["2"].cluster_id
    assert engine.run_summary(engine.resumed(rows, F.lit("b"), log)).first().stop_reason == "resumed"


def test_members_move_where_they_fit_better(spark):
    run = engine.Run(engine.read_items(spark.createDataFrame([("0", "a b c d"), ("1", "a b c d e"), ("2", "x y z w"), ("3", "x y z w v")], "id string, label string"), F.lit("b"), engine.Settings()), engine.lexical_judge(), engine.Settings(), "run")
    kind = "block string, id string, priority long, outcome string, cluster string, reason string, proposal string, sure double, since int"
    wrong = spark.createDataFrame([("b", "0", 1, "seed", "A", "", None, 1.0, 0), ("b", "1", 2, "assigned", "B", "", None, 1.0, 1), ("b", "2", 3, "seed", "B", "", None, 1.0, 0), ("b", "3", 4, "assigned", "B", "", None, 1.0, 1)], kind)
    after = {r.id: r for r in run.moved(wrong, spark.createDataFrame([("b",)], "block string"), 1).collect()}
    assert (after["1"].cluster, after["1"].reason) == ("A", "reassigned") and after["3"].cluster == after["2"].cluster == "B"
    alone = spark.createDataFrame([("b", "2", 3, "seed", "B", "", None, 1.0, 0), ("b", "0", 1, "assigned", "B", "", None, 1.0, 1)], kind)
    lost = {r.id: r for r in run.moved(alone, spark.createDataFrame([("b",)], "block string"), 1).collect()}
    assert (lost["0"].outcome, lost["0"].reason, lost["0"].proposal) == ("deferred", "reverify_failed", "B")


def test_empty_collection(spark):
    assert engine.cluster_blocks(spark.createDataFrame([], "id string, label string"), F.lit("b")).count() == 0


def test_settings_are_checked():
    for bad in ({"retrieve_limit": 0}, {"assign_review_floor": 0.9}, {"merge_review_floor": 0.9}):
        with pytest.raises(ValueError):
            engine.Settings(**bad)
