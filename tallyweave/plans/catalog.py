"""All queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import answers, ids, similarity
from ..functions import text as tx
from ..operators import catalogue, cluster, decide, evaluate, frontier, ledger, retrieval
from ..operators.index import TextIndex, identity_of
from . import base, oracles
from .registry import ORACLES, QUERIES, query

ORACLES.update(oracles.ORACLES)

def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("score", F.round("score", digits) + F.lit(0.0))


def candidates(spark: SparkSession, d: str, k: int) -> DataFrame:
    return base.text_index(spark, d).search(base.benchmark(spark, d), k)


def two_lists(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    """Two retrievers over whole texts: BM25, and the overlap of tokens. Both read the stored index."""
    index, asked = base.text_index(spark, d), base.benchmark(spark, d)
    overlap = retrieval.overlap_top(asked, index.documents(), k)
    return index.search(asked, k).withColumn("retriever", F.lit("bm25")).unionByName(overlap.withColumn("retriever", F.lit("overlap")))


def holders(spark: SparkSession, d: str) -> DataFrame:
    """``query_id``, ``id`` of the documents that hold a benchmark text."""
    index = base.text_index(spark, d)
    return retrieval.holding(base.benchmark(spark, d), base.documents(spark, d), index.postings(), index.documents())


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return base.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked_vectors(v: DataFrame) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 20."""
    return v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return base.select(spark, d, base.ATTEMPTS)


def results(spark: SparkSession, d: str) -> DataFrame:
    return decide.derive_status(attempts(spark, d))


def judged(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.judged(results(spark, d), base.gold_sets(spark, d))


def at_floors(spark: SparkSession, d: str, accept: float, review: float) -> DataFrame:
    return decide.derive_status(attempts(spark, d), accept_at=accept, review_floor=review)


@query
def bm25_topk(spark, d):
    return rounded(candidates(spark, d, 10))


@query
def bm25_postings_stats(spark, d):
    docs = base.documents(spark, d)
    index = retrieval.postings(docs).groupBy("term").agg(F.count("*").alias("df")).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return retrieval.corpus_stats(docs).crossJoin(index).withColumn("mean_size", F.round("mean_size", 6))


@query
def exact_lookup(spark, d):
    part = base.table(spark, d, "part")
    asked = base.table(spark, d, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey") * 3, "left")
    mention = F.concat(F.coalesce("p_name", F.lit("none")), F.when(F.col("s_suppkey") % 3 == 0, " x").otherwise("!"))
    return retrieval.exact_lookup(asked.select(F.col("s_suppkey").alias("source_id"), mention.alias("mention")), part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query
def exact_boosted_search(spark, d):
    docs = base.documents(spark, d).withColumn("forms", F.array("text"))
    return rounded(retrieval.exact_first(base.benchmark(spark, d), docs))


@query
def exact_weight_search(spark, d):
    """Parts by name: equal names weigh ten times as much."""
    docs = base.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.array("p_name", "p_type").alias("forms"))
    asked = base.table(spark, d, "supplier").join(base.table(spark, d, "part"), F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("query_id"), F.upper("p_name").alias("text"))
    return rounded(retrieval.exact_boosted(asked, docs)).select("query_id", "id", "score", "rank")


@query
def fuzzy_vocabulary_expand(spark, d):
    """Terms of the benchmark against all terms of the documents."""
    asked = base.benchmark(spark, d).select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    return retrieval.fuzzy_terms(asked, base.text_index(spark, d).vocabulary())


@query
def fuzzy_search(spark, d):
    index = base.text_index(spark, d)
    return rounded(retrieval.fuzzy_top(base.benchmark(spark, d), index.documents(), index.vocabulary(), 10)).select("query_id", "id", "score", "rank")


@query
def index_upkeep(spark, d):
    """An index that took documents in by three steps and lost some again answers as one built from what is left."""
    docs = base.table(spark, d, "documents")
    part = F.col("source")
    sources = sorted(r.source for r in docs.select("source").distinct().where("source is not null").collect())  # a short list of sources
    half = sources[: len(sources) // 2]
    rows = docs.select(F.col("doc_id").alias("id"), "text", "source")
    index = TextIndex.build(rows.where(part.isin(half)), f"{store.Work(spark, 'upkeep').root}/index", identity_of(table="documents"), inverted=False)
    index.add(rows.where(~part.isin(half) | part.isNull()))
    index.add(rows.where(part.isin(half[:1])).withColumn("text", F.upper("text")))
    index.remove(base.table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("id")))
    return rounded(index.search(base.benchmark(spark, d), 10))


@query
def dense_topk(spark, d):
    v = vectors(spark, d)
    return rounded(retrieval.dense_topk(asked_vectors(v), v)).select("query_id", "id", "score", "rank")


@query
def dense_best_per_record(spark, d):
    v = vectors(spark, d)
    return rounded(retrieval.dense_topk(asked_vectors(v), v, record=F.floor(F.col("id") / 4)))


@query
def matryoshka_topk(spark, d):
    v = vectors(spark, d)
    return rounded(retrieval.dense_topk(asked_vectors(v), v, dimensions=16)).select("query_id", "id", "score", "rank")


@query
def rrf_multi_query(spark, d):
    return rounded(retrieval.top(retrieval.fuse(two_lists(spark, d)), 10), 9)


@query
def rrf_weighted(spark, d):
    return rounded(retrieval.top(retrieval.fuse(two_lists(spark, d), weights={"bm25": 2.0}).drop("evidence"), 10), 9)


@query
def combsum(spark, d):
    return rounded(retrieval.top(retrieval.comb_sum(two_lists(spark, d)), 10))


@query
def rrf_excluding(spark, d):
    """Ranks are those of the full pool; excluded documents leave after fusion, so they shorten nothing."""
    out = base.table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return rounded(retrieval.top(retrieval.fuse(two_lists(spark, d)).drop("evidence").join(out, "id", "left_anti"), 5), 9).select("query_id", "id", "score", "rank")


def overlaps(spark, d):
    """Candidates of the benchmark texts with the share of words that both hold."""
    words = lambda c: F.array_distinct(F.split(tx.match_key(F.col(c)), " "))
    asked = base.benchmark(spark, d).select("query_id", words("text").alias("q"))
    texts = base.documents(spark, d).select("id", words("text").alias("t"))
    hits = store.Work(spark, "overlaps").save(candidates(spark, d, 12), "hits")  # read twice: to be counted, and to be joined
    return texts.join(store.few(hits), "id").join(asked, "query_id").withColumn("overlap", F.round(tx.jaccard(F.col("q"), F.col("t")), 4)).drop("q", "t")


def sized(spark, d):
    text = base.documents(spark, d).select("id", F.length("text").alias("size"))
    hits = store.Work(spark, "sized").save(candidates(spark, d, 12), "hits")  # read twice: to be counted, and to be joined
    return text.join(store.few(hits), "id").select("query_id", "id", "score", "rank", "size")


@query
def candidate_keys(spark, d):
    return retrieval.with_keys(sized(spark, d)).select("query_id", "id", "rank", "key")


@query
def budget_prefix(spark, d):
    return retrieval.within_budget(sized(spark, d), F.col("size"), 10, 8000).select("query_id", "id", "rank", "used", "kept")


@query
def shortlist(spark, d):
    return rounded(retrieval.shortlist(candidates(spark, d, 15).drop("rank"), 15, 20.0)).select("query_id", "id", "score", "rank")


@query
def resolve_keys(spark, d):
    issued = F.create_map(*(F.lit(x) for i in range(1, 5) for x in (f"C0{i}", f"id{i}")))
    rows = base.select(spark, d, base.SELECTIONS)
    return rows.select("event_id", tx.resolve_key(F.col("answer"), issued).alias("r")).select("event_id", "r.id", "r.resolution")


@query
def resolve_keys_legacy(spark, d):
    issued = F.create_map(*(F.lit(x) for i in range(1, 5) for x in (f"C0{i}", f"Go:{i}")))
    rows = base.select(spark, d, base.SELECTIONS)
    return rows.select("event_id", tx.resolve_key(F.col("answer"), issued, legacy=True).alias("r")).select("event_id", "r.id", "r.resolution")


@query
def overlap_choose(spark, d):
    """The offline decider: of each list, the candidate with most shared words, and its share of all overlaps."""
    best = decide.overlap_choice(overlaps(spark, d))
    return best.select("query_id", "id", F.round("overlap", 6).alias("overlap"), F.round("p_choice", 6).alias("p_choice"), F.round("p_none", 6).alias("p_none"))


@query
def normalise_query(spark, d):
    return base.table(spark, d, "documents").select("doc_id", F.md5(tx.normalise_query(F.col("text"))).alias("digest"))


@query
def tidy_text(spark, d):
    return base.table(spark, d, "documents").select("doc_id", F.md5(tx.tidy(F.col("text"))).alias("digest"))


@query
def sanitise_query(spark, d):
    return base.table(spark, d, "pages").select("page_id", F.md5(tx.sanitise_query(F.concat("url", F.lit(" AND "), "url"))).alias("digest"))


@query
def multivalue_split(spark, d):
    cell = F.concat("p_type", F.lit(" ||"), "p_name")
    return base.table(spark, d, "part").select("p_partkey", F.array_join(tx.multivalue(cell, " "), ",").alias("parts"))


@query
def curie_urls(spark, d):
    p = F.col("page_id")
    uri = F.when(p % 3 == 0, F.concat(F.lit("http://purl.obolibrary.org/obo/GO_"), p)).when(p % 3 == 1, F.concat(F.lit("http://x.org/a#frag"), p)).otherwise(F.replace("url", F.lit("#"), F.lit("")))
    return base.table(spark, d, "pages").select("page_id", tx.curie(uri).alias("curie"))


@query
def redact_urls(spark, d):
    """Parameters that only look like credentials stay: max_tokens, monkey."""
    p = F.col("page_id").cast("string")
    secret = F.when(F.col("page_id") % 3 == 0, "api_key").when(F.col("page_id") % 3 == 1, "max_tokens").otherwise("x-token")
    url = F.concat(F.lit("https://me:pw@Host:80/"), p, F.lit("?a=1&"), secret, F.lit("="), p, F.lit("&monkey=2&Authorization=b"))
    return base.table(spark, d, "pages").select("page_id", tx.redact_url(url).alias("url"))


@query
def partition_split(spark, d):
    drawn = base.table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), ids.draw("salt", F.col("c_custkey")).alias("draw"))
    return drawn.select("source_id", F.round("draw", 9).alias("draw"), ids.partition_of(F.col("draw"), {"prompt_train": 0.5, "validation": 0.25, "test": 0.25}).alias("part"))


@query
def holdout_deal(spark, d):
    rows = base.table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"))
    return evaluate.deal_holdout(rows, ids.draw("fit", F.col("source_id"))).select("source_id", "part")


@query
def audit_sample(spark, d):
    score = F.col("score")
    return attempts(spark, d).select("source_id", "attempt", decide.should_verify(score, 0.6, 0.8).alias("verify"), decide.should_audit("run", F.col("source_id"), score, 0.8, 0.1).alias("audit"))


@query
def record_digest(spark, d):
    return base.table(spark, d, "part").select("p_partkey", ids.record_digest(F.col("p_partkey"), name=F.col("p_name"), brand=F.col("p_brand")).alias("digest"))


@query
def changed_records(spark, d):
    part = base.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    stored = part.where("p_size <= 40").select("id", ids.record_digest(F.col("id"), name=F.col("name")).alias("digest"))
    edited = F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("*"))).otherwise(F.col("name"))
    return ledger.upsert(stored, part.where("p_size >= 5").select("id", ids.record_digest(F.col("id"), name=edited).alias("digest")))


@query
def derive_status(spark, d):
    return results(spark, d)


@query
def decider_status(spark, d):
    rows = base.select(spark, d, base.SIGNALS).withColumn("v", decide.decider_status())
    return rows.groupBy("v.status", "v.reason").agg(F.count("*").alias("n"), F.sum("order_id").alias("orders"))


def log(spark, d):
    return base.select(spark, d, base.LOG)


def snapshot(spark, d):
    return base.select(spark, d, base.SNAPSHOT)


@query
def ledger_current(spark, d):
    return ledger.current_view(snapshot(spark, d), log(spark, d)).select("source_id", "status", "seq", "matched_id")


@query
def ledger_history(spark, d):
    return ledger.history(log(spark, d)).select("source_id", "seq", "status", "revision", "current")


@query
def removed_sources(spark, d):
    return ledger.removed_sources(log(spark, d), snapshot(spark, d))


@query
def resume_todo(spark, d):
    return ledger.resume_todo(snapshot(spark, d), log(spark, d))


@query
def snapshot_dedupe(spark, d):
    return ledger.distinct_snapshots(base.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("digest")))


@query
def failing_streaks(spark, d):
    return ledger.failing_streak(log(spark, d))


@query
def status_counts(spark, d):
    return ledger.latest(log(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query
def duplicate_targets(spark, d):
    return ledger.duplicate_targets(ledger.latest(log(spark, d)))


@query
def failure_groups(spark, d):
    return ledger.top_groups(results(spark, d), "reason")


@query
def results_page(spark, d):
    return ledger.page(results(spark, d), 100, 50).select("source_id", "status", "total", "next_offset")


def reviews(spark, d):
    return ledger.applicable_reviews(base.select(spark, d, base.REVIEWS), log(spark, d))


@query
def review_history(spark, d):
    return reviews(spark, d).select("review_id", "source_id", "state")


@query
def adjudicated(spark, d):
    return ledger.adjudicated(ledger.latest(log(spark, d)), reviews(spark, d))


@query
def eval_metrics(spark, d):
    return evaluate.metrics(judged(spark, d))


@query
def threshold_curve(spark, d):
    """Each source's evidence is gathered once, and meets its gold once; only then do thresholds multiply the rows."""
    known = decide.evidence(attempts(spark, d)).join(base.gold_sets(spark, d), "source_id", "left")
    rows = evaluate.at_thresholds(known)
    found = decide.status_of(rows, ("source_id", "threshold", "gold_ids"), F.col("threshold"), F.least(F.lit(decide.REVIEW_FLOOR), F.col("threshold")))
    return evaluate.metrics(evaluate.judged_rows(found), ("threshold",))


@query
def calibration(spark, d):
    return evaluate.calibration(judged(spark, d))


@query
def ceiling_buckets(spark, d):
    a = attempts(spark, d)
    seen = a.groupBy("source_id").agg(F.collect_set("chosen_id").alias("retrieved"), F.collect_set(F.when(F.col("candidate_count") > 1, F.col("chosen_id"))).alias("keyed"), F.coalesce(F.bool_or(F.col("reason") == "candidate_budget_exceeded"), F.lit(False)).alias("cut"), F.coalesce(F.bool_or(F.col("retrieval_failures") > 0), F.lit(False)).alias("degraded"))
    rows = judged(spark, d).join(seen, "source_id").withColumn("known_gold", F.filter("gold_ids", lambda x: x % 19 != 0))
    return rows.groupBy(evaluate.ceiling_bucket().alias("bucket")).agg(F.count("*").alias("n"))


@query
def replay_transitions(spark, d):
    return evaluate.transitions(results(spark, d), at_floors(spark, d, 0.8, 0.5))


@query
def fit_grid(spark, d):
    rows = judged(spark, d).withColumn("p_choice", (F.col("source_id") % 10) / 10)
    return evaluate.fit_grid(rows, [0.5, 0.6, 0.7, 0.8, 0.9], [0.3, 0.5, 0.7], 0.4)


@query
def retrieval_recall(spark, d):
    return evaluate.recall_at(candidates(spark, d, 50), holders(spark, d), (1, 5, 50))


@query
def partition_scores(spark, d):
    return evaluate.partition_scores(base.select(spark, d, "SELECT vec_id AS item_id, vec_id % 40 AS cluster_id, label AS gold_id FROM {embeddings}"))


@query
def order_sensitivity(spark, d):
    one = base.select(spark, d, "SELECT vec_id AS item_id, vec_id % 40 AS cluster_id FROM {embeddings}")
    two = base.select(spark, d, "SELECT vec_id AS item_id, vec_id % 60 AS cluster_id FROM {embeddings}")
    return evaluate.order_sensitivity(one, two)


@query
def exact_mention_clusters(spark, d):
    return cluster.by_exact_mention(base.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("label")))


@query
def gold_clusters(spark, d):
    return cluster.by_gold_set(base.gold_sets(spark, d))


@query
def cluster_sizes(spark, d):
    return cluster.with_outcomes(base.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("cluster_id")))


@query
def member_changes(spark, d):
    members = base.table(spark, d, "events").groupBy(F.col("user_id").alias("cluster_id"), F.col("event_type").alias("revision")).agg(F.collect_set(F.col("event_id") % 20).alias("members"))
    return cluster.member_changes(members)


@query
def merge_ancestry(spark, d):
    return cluster.merge_ancestry(spark, base.table(spark, d, "nation").where("n_nationkey > 0").selectExpr("n_nationkey AS child", "CAST(n_nationkey DIV 2 AS INT) AS parent"))


@query
def leader_clusters(spark, d):
    """Greedy leaders within blocks of one brand and type."""
    part = base.table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("label"), F.concat_ws("|", "p_brand", "p_type").alias("block"))
    return cluster.by_leaders(part, "block")


@query
def usage_totals(spark, d):
    rows = base.table(spark, d, "orders").join(base.table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("calls"), F.sum("l_linenumber").alias("prompt_tokens"), F.sum("l_quantity").cast("long").alias("completion_tokens"), F.count_if(F.col("l_returnflag") == "N").alias("cache_hits"))


@query
def agreement(spark, d):
    a = results(spark, d).selectExpr("source_id", "status = 'matched' AS m1", "matched_id AS id1")
    b = at_floors(spark, d, 0.8, 0.5).selectExpr("source_id", "status = 'matched' AS m2", "matched_id AS id2")
    both = F.when(F.col("m1") & F.col("m2"), F.when(F.col("id1") == F.col("id2"), "same").otherwise("different"))
    verdict = both.when(F.col("m1"), "only_first").when(F.col("m2"), "only_second").otherwise("neither")
    return a.join(b, "source_id").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query
def compare_runs(spark, d):
    known = decide.evidence(attempts(spark, d)).join(base.gold_sets(spark, d), "source_id", "left")
    rows = known.withColumn("run", F.explode(F.array(F.lit(0.5), F.lit(0.7), F.lit(0.9))))
    runs = evaluate.metrics(evaluate.judged_rows(decide.status_of(rows, ("source_id", "run", "gold_ids"), F.col("run"), 0.4)), ("run",))
    all_runs = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each run
    p = F.col("accepted_precision")
    return runs.select("run", "accepted_precision", "coverage", F.round(p - F.first(p).over(all_runs), 4).alias("delta"), (p == F.max(p).over(all_runs)).alias("best"))


@query
def retry_metrics(spark, d):
    gold = base.gold_sets(spark, d)
    first = attempts(spark, d).where("attempt = 0").join(gold, "source_id").select("source_id", (F.coalesce(decide.acceptable(), F.lit(False)) & F.coalesce(F.array_contains("gold_ids", F.col("chosen_id")), F.lit(False))).alias("first_right"))
    rows = judged(spark, d).where("labelled").join(first, "source_id").withColumn("right", (F.col("status") == "matched") & F.col("correct"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("right") & ~F.col("first_right")).alias("recovered"), F.count_if(F.col("first_right") & ~F.col("right")).alias("broken"))


@query
def decision_diagnostics(spark, d):
    one = attempts(spark, d).groupBy("source_id").agg(F.bool_or(F.col("verifier") == "disagree").alias("v"), F.bool_or(F.col("resolution") == "unresolved").alias("u"), F.bool_or(F.col("retrieval_failures") > 0).alias("d"), F.count("attempt").alias("n"))
    return one.agg(F.count_if("v").alias("verifier_disagreed"), F.count_if("u").alias("unresolved"), F.count_if("d").alias("degraded"), F.count_if(F.col("n") > 1).alias("retried"))


@query
def failures_by_role(spark, d):
    s, c = F.col("status"), F.col("correct")
    role = F.when((s == "matched") & ~c, "wrong_match").when((s == "unmatched") & ~F.col("no_match"), "missed").when((s == "needs_review") & c, "needless_review").when(s == "failed", "failed")
    rows = judged(spark, d).where("labelled").select(role.alias("role"), "source_id").where("role is not null")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy("source_id"))).where("place <= 20")


@query
def confidence_values(spark, d):
    return base.select(spark, d, base.ANSWERS).select("event_id", tx.confidence(F.col("answer")).alias("score"))


@query
def name_similarity(spark, d):
    part = base.table(spark, d, "part")
    return part.select("p_partkey", F.round(similarity.similarity(F.col("p_name"), F.col("p_type")), 6).alias("score"))


@query
def route_proposals(spark, d):
    issued = base.select(spark, d, "SELECT DISTINCT user_id AS source_id, concat('C0', event_id % 4) AS key FROM {events}")
    seen = base.select(spark, d, "SELECT DISTINCT user_id AS source_id, concat('term ', event_id % 5) AS query FROM {events} WHERE event_type = 'signup'")
    return frontier.route_proposals(base.select(spark, d, base.PROPOSALS), issued, seen)


@query
def dispatch_calls(spark, d):
    requests = base.select(spark, d, "SELECT event_id AS seq, concat(event_type, user_id % 40) AS request_key FROM {events}")
    return frontier.dispatch(requests, base.select(spark, d, "SELECT concat(event_type, user_id % 40) AS request_key FROM {events} WHERE event_type = 'view'"), 90)


@query
def stop_reasons(spark, d):
    return frontier.stop_reason(base.select(spark, d, "SELECT user_id AS run, event_id AS iteration, event_type AS digest FROM {events}"), 900)


@query
def max_live_clusters(spark, d):
    return frontier.max_live(base.select(spark, d, "SELECT user_id AS run, event_id - event_id % 7 AS step, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END AS delta FROM {events}"))


@query
def join_passes(spark, d):
    hits = two_lists(spark, d)
    return frontier.join_passes(*(hits.where(F.col("retriever") == r).select("query_id", "id", "rank") for r in ("overlap", "bm25")))


@query
def preflight_counts(spark, d):
    rows = base.select(spark, d, "SELECT doc_id - doc_id % 3 * (doc_id % 2) AS id, CASE WHEN doc_id % 10 = 0 THEN ' ' WHEN doc_id % 10 = 1 THEN NULL ELSE text END AS text FROM {documents}")
    return catalogue.preflight(rows, "text")


@query
def gold_restricted(spark, d):
    return catalogue.restricted_gold(base.select(spark, d, base.GOLD_FLAT), base.select(spark, d, "SELECT p_partkey AS id FROM {part} WHERE p_size <= 40"))


@query
def gold_alias_closure(spark, d):
    aliases = base.select(spark, d, "SELECT p_partkey AS id, p_partkey + 1 AS alias FROM {part} WHERE p_size < 10")
    return catalogue.alias_closure(base.select(spark, d, base.GOLD_FLAT), aliases)


@query
def hop_headroom(spark, d):
    shown = base.select(spark, d, "SELECT DISTINCT l_orderkey AS source_id, l_partkey AS candidate FROM {lineitem} WHERE l_linenumber > 3")
    missed = base.select(spark, d, base.GOLD_FLAT).join(shown.withColumnRenamed("candidate", "gold_id"), ["source_id", "gold_id"], "left_anti")
    return catalogue.hop_headroom(missed, shown, base.select(spark, d, base.PARENTS))


@query
def co_exposure(spark, d):
    shown = base.select(spark, d, "SELECT l_orderkey AS decision, l_partkey AS item_id FROM {lineitem}")
    return catalogue.co_exposure(shown, base.select(spark, d, "SELECT p_partkey AS item_id, p_brand AS gold_id FROM {part}"))


@query
def screen_funnel(spark, d):
    """Of the asked texts that a document holds: how many are retrieved, shortlisted, and first."""
    best = candidates(spark, d, 50).join(holders(spark, d), ["query_id", "id"], "right").groupBy("query_id").agg(F.min("rank").alias("best"))
    return best.agg(F.count("*").alias("asked"), F.count("best").alias("retrieved"), F.count_if(F.col("best") <= 5).alias("shortlisted"), F.count_if(F.col("best") == 1).alias("first"))


@query
def pair_table(spark, d):
    """Candidate pairs with their label, and the gold pairs that blocking left out."""
    gold = holders(spark, d).withColumn("gold", F.lit(True))
    pairs = candidates(spark, d, 5).select("query_id", "id").withColumn("shown", F.lit(True)).join(gold, ["query_id", "id"], "full")
    return pairs.select("query_id", "id", F.coalesce("gold", F.lit(False)).alias("same"), F.col("shown").isNull().alias("blocking_miss"))


@query
def parsed_answers(spark, d):
    return base.select(spark, d, base.REPLIES).select("event_id", answers.json_object(F.col("reply")).alias("object"))


@query
def review_problems(spark, d):
    return ledger.review_problems(base.select(spark, d, base.WORKSHEET), base.select(spark, d, base.KEYED), "t1")


@query
def run_gate(spark, d):
    rows = "SELECT domain, avg(CASE WHEN l_quantity > {0} THEN 1.0D ELSE 0.0D END) AS accuracy, avg(l_extendedprice * {1}) AS tokens FROM (SELECT *, concat(l_returnflag, l_linestatus) AS domain FROM {{lineitem}}) t GROUP BY domain"
    return evaluate.run_gate(base.select(spark, d, rows.format("25", "1.0D")), base.select(spark, d, rows.format("24 + l_linenumber % 2", "0.4D")))


@query
def selected_iterations(spark, d):
    states = base.select(spark, d, "SELECT user_id AS run, event_id AS iteration, event_type AS digest, event_id % 17 AS unresolved FROM {events}")
    return frontier.selected_iteration(states, 900)


from . import released, workflows  # noqa: E402  registers the queries over whole runs and their files, which use those above

__all__ = ["ORACLES", "QUERIES", "released", "workflows"]
