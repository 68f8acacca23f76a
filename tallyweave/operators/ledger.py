"""The result ledger as append-only rows; everything else is a view over it.

A log row has ``source_id``, ``seq`` (its commit), ``status`` and more; a snapshot names the sources that
count now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import store


def latest(log: DataFrame, key: str = "source_id", seq: str = "seq") -> DataFrame:
    """The last row of each key: an aggregate, so only one row of a key and task is shuffled."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), seq).alias("row")).select(key, "row.*")


def revisions(log: DataFrame, key: str = "source_id", seq: str = "seq") -> DataFrame:
    return log.withColumn("revision", F.row_number().over(Window.partitionBy(key).orderBy(seq)))


def history(log: DataFrame, key: str = "source_id", seq: str = "seq") -> DataFrame:
    """All rows with their revision and whether they are the current one."""
    own = Window.partitionBy(key)
    return revisions(log, key, seq).withColumn("current", F.col(seq) == F.max(seq).over(own))


def current_view(snapshot: DataFrame, log: DataFrame, key: str = "source_id") -> DataFrame:
    """Each source of the snapshot with its latest row; sources without one are pending."""
    return snapshot.join(latest(log, key), key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def removed_sources(log: DataFrame, snapshot: DataFrame, key: str = "source_id") -> DataFrame:
    return log.select(key).distinct().join(snapshot, key, "left_anti")


def resume_todo(snapshot: DataFrame, log: DataFrame, key: str = "source_id") -> DataFrame:
    """Sources to run again: all but those whose latest status is settled (anything but failed)."""
    return snapshot.join(latest(log, key).where("status <> 'failed'"), key, "left_anti")


def distinct_snapshots(snapshots: DataFrame, digest: str = "digest", seq: str = "seq") -> DataFrame:
    """Snapshots that differ from the one before, per run."""
    before = F.lag(digest).over(Window.partitionBy("run").orderBy(seq))
    return snapshots.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(digest))).drop("before")


def failing_streak(invocations: DataFrame, length: int = 3) -> DataFrame:
    """Runs of equal outcomes (gaps and islands) that failed ``length`` times or more."""
    w = Window.partitionBy("source_id").orderBy("seq")
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy("source_id", "status").orderBy("seq"))
    return invocations.withColumn("island", island).groupBy("source_id", "status", "island").agg(F.count("*").alias("length"), F.min("seq").alias("first_seq")).where((F.col("status") == "failed") & (F.col("length") >= length)).drop("island", "status")


def duplicate_targets(results: DataFrame) -> DataFrame:
    """Targets that several sources matched, with those sources: a report, never a resolution."""
    return results.where("status = 'matched'").groupBy("matched_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source_id")), "|").alias("sources")).where("n > 1")


def top_groups(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k largest groups; the rest are one group named ``other``."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), key))  # over one row for each kind of group
    return counts.withColumn("place", place).groupBy(F.when(F.col("place") <= k, F.col(key)).otherwise("other").alias(key)).agg(F.sum("n").alias("n"))


def page(results: DataFrame, offset: int, limit: int, order: str = "source_id") -> DataFrame:
    """A page in order, with the total and where the next page starts (null at the end)."""
    total = results.agg(F.count("*").alias("total"))
    rows = results.orderBy(order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("long")))


class Pages:
    """Results written in ranges of their order, with the rows of each status in each range: a page reads the ranges it lies in."""

    def __init__(self, results: DataFrame, order: str = "source_id") -> None:
        self.order, self.columns = order, results.columns
        ranged = results.repartitionByRange(order).withColumn("_range", F.spark_partition_id())
        self.path = f"{store.Work(results.sparkSession, 'pages').root}/results"
        ranged.write.partitionBy("_range").option("compression", "zstd").parquet(self.path)
        self.rows = results.sparkSession.read.parquet(self.path)
        counts = self.rows.groupBy("_range", "status").count().collect()  # ranges times statuses
        self.counts = [(r._range, r.status, r["count"]) for r in counts]

    def page(self, offset: int, limit: int, status: str | None = None) -> DataFrame:
        """A page in order, of one status if it is given, with the total and where the next page starts (null at the end)."""
        if not 1 <= limit <= 200 or offset < 0:
            raise ValueError("a page has 1 to 200 rows, from offset 0 on")
        sizes: dict[int, int] = {}
        for at, own, n in self.counts:
            if status is None or own == status:
                sizes[at] = sizes.get(at, 0) + n
        before, total, needed = None, 0, []
        for at in sorted(sizes):
            if total < offset + limit and total + sizes[at] > offset:
                before = total if before is None else before
                needed.append(at)
            total += sizes[at]
        rows = self.rows.where(F.col("_range").isin(needed) if needed else F.lit(False))
        if status is not None:
            rows = rows.where(F.col("status") == status)
        found = rows.orderBy(self.order).offset(offset - (before or 0)).limit(limit).select(*self.columns)
        return found.withColumn("total", F.lit(total).cast("long")).withColumn("next_offset", F.lit(offset + limit if total > offset + limit else None).cast("long"))


def applicable_reviews(reviews: DataFrame, log: DataFrame) -> DataFrame:
    """Every review as applied (the last one of the current revision), superseded, or stale (another revision)."""
    now = revisions(log).groupBy("source_id").agg(F.max("revision").alias("now"))
    fits = F.col("result_revision") == F.col("now")
    last = F.max(F.when(fits, F.col("review_id"))).over(Window.partitionBy("source_id"))
    state = F.when(~fits, "stale").when(F.col("review_id") == last, "applied").otherwise("superseded")
    return reviews.join(now, "source_id").withColumn("state", state).drop("now")


def adjudicated(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """Current results overlaid with their applied review, if any."""
    applied = reviews.where("state = 'applied'").select("source_id", "decision", "corrected_id")
    d = F.col("decision")
    final = F.when(d == "accept", F.col("matched_id")).when(d == "replace", F.col("corrected_id")).when(d.isin("reject", "no_match"), F.lit(None)).otherwise(F.col("matched_id"))
    status = F.when(d.isin("accept", "replace"), "matched").when(d.isin("reject", "no_match"), "unmatched").when(d == "defer", "needs_review").otherwise(F.col("status"))
    return results.join(applied, "source_id", "left").select("source_id", final.alias("final_id"), status.alias("final_status"), "decision", F.col("matched_id").alias("model_id"), F.col("status").alias("model_status"))


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", digest: str = "digest") -> DataFrame:
    """What a digest-guarded upsert does to each key: insert, update, keep, or prune."""
    a, b = stored.select(key, F.col(digest).alias("old")), new.select(key, F.col(digest).alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "prune").when(F.col("old") == F.col("new"), "keep").otherwise("update")
    return a.join(b, key, "full").select(key, action.alias("action"))


def review_problems(reviews: DataFrame, results: DataFrame, targets: str) -> DataFrame:
    """Why a review can't be applied (null: it can), for each of ``result_key``, ``source_hash``, ``proposed_id``.

    ``results`` has a row for each ``result_key``: source_hash, matched_id, current, target_digest. ``targets``
    is the digest of the targets as they are now.
    """
    r = results.select("result_key", F.col("source_hash").alias("now_hash"), "matched_id", "current", "target_digest", F.lit(True).alias("known"))
    c = F.col
    problem = (
        F.when(c("known").isNull(), "unknown_key").when(~c("source_hash").eqNullSafe(c("now_hash")), "source_changed").when(~c("current"), "not_current")
        .when(~c("proposed_id").eqNullSafe(c("matched_id")), "recomputed").when(c("target_digest") != targets, "targets_changed")
    )
    return reviews.join(r, "result_key", "left").select(*reviews.columns, problem.alias("problem"))


def applied_batch(checked: DataFrame) -> DataFrame:
    """All checked reviews, or none if any of them has a problem."""
    bad = checked.agg(F.count("problem").alias("bad"))
    return checked.crossJoin(F.broadcast(bad)).where("bad = 0").drop("bad", "problem")  # one row


def last_invocation(invocations: DataFrame) -> DataFrame:
    """Each run's last invocation (``run``, ``seq``, and more): how it ended, or ``interrupted`` if it never did."""
    last = latest(invocations, "run")
    return last.withColumn("state", F.coalesce("state", F.lit("interrupted")))


def explained(source_id, results: DataFrame, attempts: DataFrame, reviews: DataFrame) -> DataFrame:
    """All that is known of one source, in order: its revisions, attempts and reviews."""
    own = lambda df: df.where(F.col("source_id") == source_id)
    row = lambda df, what, at: own(df).select(F.lit(what).alias("what"), F.col(at).cast("long").alias("at"), F.to_json(F.struct(*df.columns)).alias("row"))
    return row(results, "result", "seq").unionByName(row(attempts, "attempt", "attempt")).unionByName(row(reviews, "review", "review_id"))


def inspected(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """A run by status: how many, the mean and least confidence, and the latest commit."""
    now = current_view(snapshot, log)
    return now.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.min("confidence").alias("least_confidence"), F.max("seq").alias("last_seq"))


def salted_order(rows: DataFrame, salt: str, key: str = "source_id") -> DataFrame:
    """Rows with their ``place`` by the hash of salt and id. Ranges of hashes are ranked alone."""
    hashed = rows.withColumn("digest", F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)).withColumn("range", F.substring("digest", 1, 3))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # over 4,096 rows at most
    first = hashed.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("digest", key)) + F.col("first")
    return hashed.join(F.broadcast(first), "range").withColumn("place", place).drop("range", "first", "digest")
