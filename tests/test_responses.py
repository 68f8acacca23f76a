"""The stored answers of a model: keys, passes, budgets and restarts."""

from pyspark.sql import functions as F

from tallyweave.operators import responses


def requests(spark, rows):
    return spark.createDataFrame(rows, "seq long, system string, user string").withColumn("request_key", responses.request_key("m", "system", "user"))


def echo(seen):
    def model(rows):
        seen.append(sorted(r.user for r in rows.collect()))
        return rows.select("request_key", F.when(F.col("user") != "bad", F.upper("user")).alias("response"))

    return model


def kinds(df):
    return {r.seq: (r.answer, r.response) for r in df.collect()}


def test_keys_take_fields_apart(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "c"), ("", "c"), ("ab", "c")], "system string, user string")
    keys = [r[0] for r in rows.select(responses.request_key("m", "system", "user")).collect()]
    assert len(set(keys)) == 4 and keys[0] == keys[4]
    assert rows.select(responses.request_key("m", "user", "system")).first()[0] == keys[0]
    assert rows.select(responses.request_key("other", "system", "user")).first()[0] != keys[0]


def test_passes_share_and_keep_answers(spark, tmp_path):
    cache, seen = responses.ResponseCache(spark, str(tmp_path / "c")), []
    first = cache.answered(requests(spark, [(3, "s", "a"), (1, "s", "a"), (2, "s", "b"), (4, "s", "bad")]), echo(seen))
    assert kinds(first) == {1: ("call", "A"), 3: ("shared", "A"), 2: ("call", "B"), 4: ("failed", None)}
    again = responses.ResponseCache(spark, str(tmp_path / "c"))  # another run
    second = again.answered(requests(spark, [(1, "s", "a"), (2, "t", "a"), (3, "s", "bad")]), echo(seen))
    assert kinds(second) == {1: ("cached", "A"), 2: ("call", "A"), 3: ("failed", None)}
    assert seen == [["a", "b", "bad"], ["a", "bad"]]
    assert tuple(responses.usage(second).first()) == (2, 1, 0, 0)
    third = again.answered(requests(spark, [(1, "s", "a")]), echo(seen))
    assert kinds(third) == {1: ("cached", "A")} and kinds(second)[2] == ("call", "A")


def test_reading_and_writing_can_be_off(spark, tmp_path):
    rows, seen = requests(spark, [(1, "s", "a")]), []
    responses.ResponseCache(spark, str(tmp_path / "c"), write=False).answered(rows, echo(seen)).count()
    responses.ResponseCache(spark, str(tmp_path / "c")).answered(rows, echo(seen)).count()
    assert kinds(responses.ResponseCache(spark, str(tmp_path / "c"), read=False).answered(rows, echo(seen))) == {1: ("call", "A")}
    assert kinds(responses.ResponseCache(spark, str(tmp_path / "c")).answered(rows, echo(seen))) == {1: ("cached", "A")}


def test_budget_holds_over_passes_and_restarts(spark, tmp_path):
    budget = lambda: responses.CallBudget(spark, str(tmp_path / "b"), 3)
    cache, seen = responses.ResponseCache(spark, str(tmp_path / "c")), []
    first = cache.answered(requests(spark, [(1, "s", "a"), (2, "s", "b"), (3, "s", "a")]), echo(seen), budget(), "one")
    assert tuple(responses.usage(first).first()) == (2, 0, 1, 0)
    assert budget().reserve("one", 9) == 2  # taken up again: what it had
    second = cache.answered(requests(spark, [(9, "s", "c"), (5, "s", "d"), (7, "s", "e"), (8, "s", "a"), (6, "s", "d")]), echo(seen), budget(), "two")
    assert kinds(second) == {5: ("call", "D"), 6: ("shared", "D"), 7: ("refused", None), 9: ("refused", None), 8: ("cached", "A")}
    assert budget().reserve("three", 1) == 0 and sum(budget().reserved().values()) == 3


def test_no_requests(spark, tmp_path):
    cache = responses.ResponseCache(spark, str(tmp_path / "c"))
    assert cache.answered(requests(spark, []), echo([])).count() == 0
    assert cache.rows().count() == 0
