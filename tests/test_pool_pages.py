"""A changing vector pool against one built anew, and pages against slices of a sorted list."""

import numpy as np
import pytest

from tallyweave.operators.ledger import Pages
from tallyweave.operators.pool import VectorPool

KIND = "id long, vector array<double>"


def nearest(vectors, query, k, but=()):
    unit = lambda v: v / np.linalg.norm(v) if np.any(v) else v
    scores = [(-round(float(unit(np.array(v)) @ unit(np.array(query))), 9), i) for i, v in vectors.items() if i not in but]
    return [i for _, i in sorted(scores)[:k]]


def test_a_changed_pool_answers_as_one_built_anew(spark, tmp_path):
    rng = np.random.default_rng(3)
    new = lambda ids: {int(i): rng.normal(size=4).round(3).tolist() for i in ids}
    frame = lambda held: spark.createDataFrame(sorted(held.items()), KIND)
    pool, held = VectorPool(spark, str(tmp_path / "p")), new(range(40))
    assert pool.search(frame(new([1])).withColumnRenamed("id", "query_id"), 3).count() == 0
    pool.upsert(frame(held))
    for step in range(3):
        more = new(rng.choice(60, 12, replace=False))
        pool.upsert(frame(more))
        gone = [int(i) for i in rng.choice(60, 5, replace=False)]
        pool.remove(spark.createDataFrame([(i,) for i in gone], "id long"))
        held = {i: v for i, v in (held | more).items() if i not in gone}
    asked = new([100, 101])
    queries = frame(asked).withColumnRenamed("id", "query_id")
    got = pool.search(queries, 7).collect()
    for q, v in asked.items():
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == nearest(held, v, 7)
    but = nearest(held, asked[100], 3)
    out = pool.search(queries, 7, spark.createDataFrame([(100, i) for i in but], "query_id long, id long")).collect()
    assert [r.id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 100] == nearest(held, asked[100], 7, but)
    assert [r.id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == 101] == nearest(held, asked[101], 7)
    for_all = pool.search(queries, 7, spark.createDataFrame([(i,) for i in but], "id long")).collect()
    assert [r.id for r in sorted(for_all, key=lambda r: r["rank"]) if r.query_id == 101] == nearest(held, asked[101], 7, but)


@pytest.mark.parametrize("status", [None, "matched", "failed", "none"])
def test_pages_are_slices(spark, status):
    rows = [(i * 3, ["matched", "unmatched", "failed"][i % 7 % 3]) for i in range(500)]
    pages, wanted = Pages(spark.createDataFrame(rows, "source_id long, status string").repartition(5)), [r for r in rows if status is None or r[1] == status]
    for offset, limit in ((0, 10), (95, 50), (len(wanted) - 5, 20) if wanted else (0, 1), (10_000, 5)):
        got = pages.page(offset, limit, status).collect()
        assert [(r.source_id, r.status) for r in got] == wanted[offset : offset + limit]
        assert all(r.total == len(wanted) and r.next_offset == (offset + limit if len(wanted) > offset + limit else None) for r in got)


def test_pages_are_bounded(spark):
    pages = Pages(spark.createDataFrame([(1, "matched")], "source_id long, status string"))
    for offset, limit in ((0, 0), (0, 201), (-1, 5)):
        with pytest.raises(ValueError):
            pages.page(offset, limit)
