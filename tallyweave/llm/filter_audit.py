"""Filter interaction audit: which document each filter removes, in every order that the filters can be applied in.

Direct relational replay. A document's failures are one row of flags; it is crossed with the broadcast orders
(``n!`` of ``n`` filters, so 120 of five: the bound of the broadcast is the number of filters, not the data),
its five steps are exploded, and the first step that it fails decides what each step counts. Counts are summed
in each task before they are shuffled, so what is shuffled is a row of a task, part, order and step, and a part
that holds most documents is no hot key.

A text is a copy if a smaller doc_id has it. Copies are told by the SHA-256 of the text: the smallest doc_id of a
digest is an aggregate that starts in each task, and a document asks for the pair of digest and its own doc_id, so
thousands of copies of one text spread over all tasks.

Null texts are empty ones: they fail as texts without words and are copies of each other and of empty texts. A
document without doc_id is no copy and makes none. Repeated rows (one doc_id, one text) count each and are no
copies of each other. A null part is the empty string. A document that several labels name is good, or toxic, if
any of them says so; without labels it is neither. An empty table gives no rows. Other columns, whatever their
names, are not read; very long texts are taken whole.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import named
from .scratch import Scratch

BLANKS = r"[\x20\x09-\x0D]+"
#: The name of the filter for copies, which looks at all texts; the others look at one.
COPIES = "E"
MOST_FILTERS = 6


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def rules(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides."""
    own = words(text)
    return {
        "A": F.size(own) < 50,
        "B": 100 * F.size(F.array_distinct(own)) < 65 * F.size(own),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id``, ``part`` and ``mask`` of each row: bit k is set where it fails the k-th filter (copies last)."""
    scratch, body = Scratch(docs.sparkSession, "audit"), F.coalesce(named(text).cast("string"), F.lit(""))
    rows = docs.select(named(doc_id).alias("doc_id"), F.coalesce(named(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(rules(F.col("body")).values())), F.lit(0))
    narrow = scratch.save(rows.select("doc_id", "part", mask.alias("own"), F.unhex(F.sha2("body", 256)).alias("digest")), "flags")
    first = narrow.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return narrow.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("own") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def orders(like: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """All orders of the filters: ``filter_order`` and the ``bits`` of its steps."""
    if not 0 < len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters of different names are audited at once")
    rows = [("".join(o), [1 << filters.index(x) for x in o]) for o in itertools.permutations(filters)]
    return like.sparkSession.createDataFrame(rows, "filter_order string, bits array<int>").coalesce(1)


def replay(flagged: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """Counts of each part, order and step over ``flagged`` (``part``, ``mask``, ``good``, ``toxic``)."""
    n, each = len(filters), orders(flagged, filters)
    unrolled = each.select("filter_order", *(F.col("bits")[k].alias(f"bit{k + 1}") for k in range(n)))
    first = F.lit(n + 1)
    for k in range(n, 0, -1):
        first = F.when(F.col("mask").bitwiseAND(F.col(f"bit{k}")) != 0, k).otherwise(first)
    crossed = flagged.crossJoin(F.broadcast(unrolled)).select("part", "filter_order", "mask", "good", "toxic", first.alias("first"), *(f"bit{k + 1}" for k in range(n)))
    steps = F.posexplode(F.array(*(F.col(f"bit{k + 1}") for k in range(n)))).alias("place", "bit")
    rows = crossed.select("part", "filter_order", "mask", "good", "toxic", "first", steps).withColumn("step", F.col("place") + 1)
    here, fails = F.col("first") == F.col("step"), F.col("mask").bitwiseAND(F.col("bit")) != 0

    def count(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    counts = rows.groupBy("part", "filter_order", "step").agg(
        count(F.col("first") > F.col("step")).alias("kept"), count(here).alias("removed"), count(fails & (F.col("first") < F.col("step"))).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"), count(here & F.col("good")).alias("good_lost"), count(here & F.col("toxic")).alias("toxic_lost"),
    )
    return counts


def with_shapley(counts: DataFrame) -> DataFrame:
    """``counts`` with ``shapley``: what the step's filter removes over all orders."""
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    total = counts.groupBy("part", letter.alias("filter")).agg(F.sum("removed").alias("shapley"))
    return counts.withColumn("filter", letter).join(total, ["part", "filter"]).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row of counts for each ``part``, ``filter_order`` and ``step``, and ``shapley``, its filter's removals summed over all orders."""
    scratch = Scratch(docs.sparkSession, "audit_counts")
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    found = failures(docs, doc_id, text, part).join(marked, "doc_id", "left")
    flagged = found.select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return with_shapley(scratch.save(replay(flagged), "counts"))
