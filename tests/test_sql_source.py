"""A database read in parts: rows equal, ranges even, also where the key is skewed."""

import pytest

from tallyweave.sources import files

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


@pytest.fixture(scope="module")
def url(spark):
    at = "jdbc:derby:memory:parts;create=true"
    spark._jvm.java.lang.Class.forName(DRIVER)
    connection = spark._jvm.java.sql.DriverManager.getConnection(at)
    statement = connection.createStatement()
    statement.execute("CREATE TABLE T (ID INT, NUMBER INT, NAME VARCHAR(50), TAGS VARCHAR(50), HOLES INT)")
    number = lambda i: i if i < 1800 else 1_000_000 + i if i < 1990 else 2_000_000_000
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    for k in range(0, 2000, 200):
        rows = [(i, number(i), f"n{i}", None if i % 3 == 0 else "a|b", None if i % 500 == 7 else i) for i in range(k, k + 200)]
        statement.execute("INSERT INTO T VALUES " + ", ".join(f"({', '.join(map(text, r))})" for r in rows))
    connection.close()
    return at


@pytest.mark.parametrize("key", ["ID", "NUMBER", "HOLES"])
def test_parts_hold_all_rows_evenly(spark, url, key):
    whole = files.sql_records(spark, url, "SELECT ID, NAME, TAGS FROM T", "ID", ("TAGS",), driver=DRIVER)
    parts = files.sql_records_in_parts(spark, url, "SELECT * FROM T WHERE NAME <> :no", "ID", key, 8, ("TAGS",), params={"no": "n5"}, driver=DRIVER)
    want = {(r.id, r.NAME, tuple(r.TAGS)) for r in whole.collect() if r.id != "5"}
    assert {(r.id, r.NAME, tuple(r.TAGS)) for r in parts.collect()} == want and parts.count() == 1999
    sizes = [len(p) for p in parts.rdd.glom().collect()]
    assert 6 <= len([n for n in sizes if n]) <= 10 and max(sizes) < 2 * 2000 / 8


def test_one_key_and_no_rows(spark, url):
    one = files.sql_records_in_parts(spark, url, "SELECT ID, NAME, 1 AS K FROM T", "ID", "K", 8, driver=DRIVER)
    assert one.count() == 2000
    none = files.sql_records_in_parts(spark, url, "SELECT ID, NAME FROM T WHERE ID < 0", "ID", "ID", 8, driver=DRIVER)
    assert none.count() == 0
