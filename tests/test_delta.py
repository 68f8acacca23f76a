"""Tables that change in place: against a dictionary, and what each change writes."""

import random

import pytest

from tallyweave import store
from tallyweave.sources.delta import BUCKET, ConcurrentChange, DeltaTable

SCHEMA = "id long, name string, size int"


def held(df):
    return {r.id: (r.name, r.size) for r in df.collect()} if df is not None else {}


def test_changes_equal_a_dictionary(spark, tmp_path):
    rng, table, now = random.Random(1), DeltaTable(spark, str(tmp_path)), {i: (f"n{i}", i) for i in range(60)}
    table.create(spark.createDataFrame([(i, *v) for i, v in now.items()], SCHEMA), ["id"], 8)
    seen = [(table.version(), dict(now))]
    for step in range(5):
        puts = {rng.randrange(90): (f"s{step}", step) for _ in range(rng.randrange(1, 12))}
        gone = [i for i in rng.sample(range(90), 6) if i not in puts]
        table.change(spark.createDataFrame([(i, *v) for i, v in puts.items()], SCHEMA), spark.createDataFrame([(i,) for i in gone], "id long"))
        now = {i: v for i, v in (now | puts).items() if i not in gone}
        seen.append((table.version(), dict(now)))
        if step == 3:
            table.compact(2)
            seen.append((table.version(), dict(now)))
    for version, rows in seen:
        assert held(table.read(version)) == rows
    assert held(table.lookup(spark.createDataFrame([(i,) for i in (1, 5, 88, 1000)], "id long"))) == {i: now[i] for i in (1, 5, 88) if i in now}
    old = table.read(seen[-1][0])
    assert table.vacuum(1) > 0 and held(table.read()) == now and held(old) == now and len(table.numbers()) == 1


def test_one_row_writes_one_bucket(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path))
    first = table.create(spark.createDataFrame([(i, "a", i) for i in range(200)], SCHEMA), ["id"], 16)
    assert len(first.parts) == 16
    before = table.read()
    second = table.change(spark.createDataFrame([(7, "b", 0)], SCHEMA))
    changed = [b for b in second.parts if second.parts[b] != first.parts[b]]
    assert len(changed) == 1 and len(second.parts[changed[0]]) == 2
    files = [n for n in store.names_in(spark, f"{tmp_path}/data/{second.parts[changed[0]][1]}") if n.startswith(BUCKET)]
    assert files == [f"{BUCKET}={changed[0]}"]
    assert held(before)[7] == ("a", 7) and held(table.read())[7] == ("b", 0)
    assert table.change(spark.createDataFrame([], SCHEMA)).number == second.number  # nothing to change is no version
    # Buckets without deltas are read without a shuffle for them: only the changed bucket is merged.
    plan = table.read()._jdf.queryExecution().toString()
    assert plan.count("Union") and "max_by" in plan


def test_the_later_of_two_writers_is_refused(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path))
    base = table.create(spark.createDataFrame([(1, "a", 1)], SCHEMA), ["id"], 2)
    table.change(spark.createDataFrame([(2, "b", 2)], SCHEMA), after=base)
    with pytest.raises(ConcurrentChange):
        table.change(spark.createDataFrame([(3, "c", 3)], SCHEMA), after=base)
    with pytest.raises(ConcurrentChange):
        table.create(spark.createDataFrame([(3, "c", 3)], SCHEMA), ["id"])
    assert set(held(table.read())) == {1, 2}


def test_a_manifest_cut_short_does_not_count(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path))
    table.create(spark.createDataFrame([(1, "a", 1)], SCHEMA), ["id"], 2)
    store.create_text(spark, f"{tmp_path}/versions/00000001.json", '{"keys": ["id"')
    assert table.version().number == 0 and held(table.read()) == {1: ("a", 1)}
    assert table.change(spark.createDataFrame([(2, "b", 2)], SCHEMA)).number == 2 and set(held(table.read())) == {1, 2}


def test_new_columns_and_empty_tables(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path / "a"))
    table.create(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA), ["id"], 2)
    table.change(spark.createDataFrame([(2, "c", 2, "new")], SCHEMA + ", extra string"))
    assert {r.id: r.extra for r in table.read().collect()} == {1: None, 2: "new"}
    none = DeltaTable(spark, str(tmp_path / "b"))
    assert none.version() is None and none.read() is None
    none.create(spark.createDataFrame([], SCHEMA), ["id"])
    assert none.read() is None
    none.change(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    assert held(none.read()) == {1: ("a", 1)}


def test_several_keys(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path))
    table.create(spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)], "id string, ord int, v double"), ["id", "ord"], 4)
    table.change(spark.createDataFrame([("a", 1, 5.0)], "id string, ord int, v double"), spark.createDataFrame([("b", 0)], "id string, ord int"))
    assert {(r.id, r.ord): r.v for r in table.read().collect()} == {("a", 0): 1.0, ("a", 1): 5.0}
