"""The index of short codes: recall, what it reads, odd vectors, hot lists, appended rows."""

import numpy as np
import pytest

from tallyweave.operators import ann, quantised, retrieval


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")


def asked(v, step=20):
    return v.where(f"id % {step} = 0").withColumnRenamed("id", "query_id")


def clusters(n, size, of, rng):
    centres = rng.normal(size=(of, size)) * 6
    return centres[rng.integers(0, of, n)] + rng.normal(size=(n, size))


def test_clustered_vectors_need_a_tenth_of_the_lists(spark, tmp_path):
    x = clusters(3000, 24, 40, np.random.default_rng(1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = table(spark, x)
    index = quantised.QuantisedIndex.build(v, str(tmp_path / "i"))
    assert index.model.probes <= len(index.model.centres) / 10
    found = index.search(asked(v))
    assert ann.recall(found, retrieval.dense_topk(asked(v), v)).first().recall >= 0.9
    again = quantised.QuantisedIndex.open(spark, str(tmp_path / "i"))
    assert again.model.probes == index.model.probes and np.allclose(again.model.books, index.model.books)
    assert sorted(again.search(asked(v)).collect()) == sorted(found.collect())


def test_vectors_without_clusters_get_more_lists(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(1500, 32))
    v = table(spark, x / np.linalg.norm(x, axis=1)[:, None])
    index = quantised.QuantisedIndex.build(v, str(tmp_path / "i"))
    assert index.model.probes > len(index.model.centres) / 10
    assert ann.recall(index.search(asked(v)), retrieval.dense_topk(asked(v), v)).first().recall >= 0.9


def test_all_lists_and_all_codes_are_exact_with_hot_lists_and_parts(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile(rng.normal(size=(1, 10)), (200, 1)), rng.normal(size=(400, 10))])  # a third are copies
    v = table(spark, x)
    monkeypatch.setattr(quantised, "SLICE", 30)
    monkeypatch.setattr(quantised, "ASKED", 7)
    index = quantised.QuantisedIndex.build(v, str(tmp_path / "i"))
    q = asked(v, 15)
    found = index.search(q, 10, probes=10**6, rerank=60)
    key = lambda r: (r.query_id, r.rank, r.id, round(r.score, 9))
    assert sorted(map(key, found.collect())) == sorted(map(key, retrieval.dense_topk(q, v).collect()))


def test_only_probed_lists_are_read(spark, tmp_path):
    v = table(spark, clusters(600, 8, 12, np.random.default_rng(4)))
    index = quantised.QuantisedIndex.build(v, str(tmp_path / "i"), lists=12)
    one = v.where("id = 5").withColumnRenamed("id", "query_id").withColumnRenamed("vector", "v")
    near = index.candidates(one, 5, probes=2)
    assert near.select("list").distinct().count() <= 2
    plan = near._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "/i/rows" in line]
    assert scans and all("list#" in line.split("PartitionFilters: ")[1].split("PushedFilters")[0] and " IN (" in line for line in scans)
    assert all("vector" not in line.split("ReadSchema")[1] for line in scans)


def test_odd_vectors_and_appended_rows(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(80, 6))
    odd = spark.createDataFrame([(900, None), (901, []), (902, [1.0]), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [float("nan")] * 6), (905, [float("inf")] * 6)], "id long, vector array<double>")
    v = table(spark, x).unionByName(odd)
    index = quantised.QuantisedIndex.build(v, str(tmp_path / "i"))
    assert index.rows().count() == 80
    assert {r.query_id for r in index.search(v.withColumnRenamed("id", "query_id"), 1, probes=99).select("query_id").collect()} == set(range(80))
    index.append(table(spark, x[:5] * 9, 200))
    best = index.search(table(spark, x[:5]).withColumnRenamed("id", "query_id"), 1, probes=99)
    assert {r.query_id for r in best.collect() if r.id == 200 + r.query_id or r.id >= 200} == set(range(5))


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_few_rows(spark, tmp_path, rows):
    v = table(spark, np.random.default_rng(6).normal(size=(3, 5))).limit(rows)
    index = quantised.QuantisedIndex.build(v, str(tmp_path / "i"))
    index = quantised.QuantisedIndex.open(spark, str(tmp_path / "i"))
    assert index.search(v.withColumnRenamed("id", "query_id")).count() == rows * rows
