"""The filter audit against a replay row by row."""

import itertools
import re

import pytest

from tallyweave.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, part string, mask string, step int, `a.b` int"
LABELS = "doc_id long, quality int, toxic int"
CLEAN = " ".join(f"w{i}" for i in range(60))


def replayed(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    rows = {}
    for d, t, s, *_ in docs:
        t, s = t or "", s or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        for order in map("".join, itertools.permutations("ABCDE")):
            first = next((k for k, x in enumerate(order, 1) if fails[x]), 6)
            for step, x in enumerate(order, 1):
                r = rows.setdefault((s, order, step), [0] * 6)
                here = first == step
                r[0] += first > step
                r[1] += here
                r[2] += fails[x] and first < step
                r[3] += fails[x] and sum(fails.values()) == 1
                r[4] += here and d in good
                r[5] += here and d in toxic
    shapley = {}
    for (s, order, step), r in rows.items():
        shapley[s, order[step - 1]] = shapley.get((s, order[step - 1]), 0) + r[1]
    return {(s, o, k, *r, shapley[s, o[k - 1]]) for (s, o, k), r in rows.items()}


@pytest.fixture(scope="module")
def docs():
    texts = [CLEAN, CLEAN, CLEAN.upper(), CLEAN + " $", "few words", None, "", " \t\n", "w " * 80, "ÀÉ " * 60, "x" * 200_000, " ".join(f"v{i}" for i in range(30_000)), CLEAN + "\x0b\x0cA", CLEAN + " B"]
    rows = [(i, t, [None, "", "s1", "s2"][i % 4], "p", "m", 1, 2) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[3], (None, CLEAN, "s1", None, None, None, None), (None, CLEAN, None, None, None, None, None), (99, CLEAN + " $", "s2", None, None, None, None)]


def test_equals_replay(spark, docs):
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, None, None), (3, 0, 0), (4, 1, 1), (None, 1, 1), (500, 1, 1)]
    found = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    got = [(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()]
    assert len(got) == len(set(got)) == 3 * 600
    assert set(got) == replayed(docs, labels)


def test_parts_by_other_names(spark, docs):
    found = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS), part="a.b")
    assert {r.part for r in found.select("part").distinct().collect()} == {"2", ""}
    assert found.agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[:] == (0, 0)


def test_empty_table(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0


def test_each_step_loses_what_it_removes(spark, docs):
    found = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS))
    total = len(docs)
    by_order = found.groupBy("filter_order").agg({"removed": "sum"}).collect()
    kept = found.where("step = 5").groupBy("filter_order").agg({"kept": "sum"}).collect()
    assert len({r[1] for r in kept}) == 1 and {r[0]: total - r[1] for r in by_order} == {r[0]: r[1] for r in kept}


def test_orders_are_bounded(spark, docs):
    with pytest.raises(ValueError):
        filter_audit.orders(spark.createDataFrame(docs, DOCS), "ABCDEFG")
