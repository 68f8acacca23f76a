"""Queries over whole runs: matching, clustering, reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import answers, ids, templates
from ..functions import text as tx
from ..operators import ann, batch, cluster, decide, engine, evaluate, ledger, matcher, pool, quantised, reports, responses, retrieval
from ..operators.index import TextIndex, identity_of
from ..sources import delta, exports, rdf, targets
from . import base, catalog
from .oracles import ALL, CAND, DOCS, DOT, GOLD, ITEMS, LOGS, METRICS, OVERLAP, PAIRS, QUERY_VECTORS, RANK, RESULTS, bm25
from .registry import ORACLES, query


def oracle(text: str):
    """The SQL that checks the query below."""

    def keep(f):
        ORACLES[f.__name__] = text
        return query(f)

    return keep


def predictions(spark, d) -> DataFrame:
    """Results as predictions: what attempts retrieved and showed, and what the first one chose."""
    a = catalog.attempts(spark, d)
    seen = a.groupBy("source_id").agg(F.collect_set("chosen_id").alias("retrieved"), F.collect_set(F.when(F.col("candidate_count") > 1, F.col("chosen_id"))).alias("shown"), F.min_by(F.struct("chosen_id"), "attempt").alias("f"), F.count("attempt").alias("n"))
    return catalog.results(spark, d).drop("attempts").join(seen, "source_id").select("source_id", "status", F.col("matched_id").alias("predicted_id"), F.when(F.col("n") > 0, F.col("retrieved")).alias("retrieved"), F.when(F.col("n") > 0, F.col("shown")).alias("shown"), F.col("f.chosen_id").alias("first_id"), (F.col("n") > 0).alias("has_first"), F.col("n").alias("attempts"))


@oracle(f"""{ALL}, seen AS (SELECT a.source_id, count(attempt) AS n, count(DISTINCT chosen_id) AS size, bool_or(g.gold_id IS NOT NULL) AS got, bool_or(g.gold_id IS NOT NULL AND candidate_count > 1) AS saw, first(chosen_id ORDER BY attempt) AS first_id, coalesce(first(g.gold_id ORDER BY attempt) IS NOT NULL, false) AS first_right
  FROM attempts a LEFT JOIN gold g ON g.source_id = a.source_id AND g.gold_id = a.chosen_id GROUP BY a.source_id),
p AS (SELECT j.*, NOT no_match AS has, n, size, got, saw, first_right, status = 'matched' AS acc FROM judged j JOIN seen USING (source_id) WHERE labelled),
s AS (SELECT count(*) AS n, count_if(has) AS with_gold, count_if(NOT has) AS gold_no_match, count_if(acc) AS accepted, count_if(acc AND correct) AS accepted_correct, count_if(status = 'needs_review') AS review, count_if(has AND correct) AS any_right, count_if(status = 'unmatched') AS said_none, count_if(status = 'unmatched' AND NOT has) AS right_none,
  count_if(NOT has AND acc) AS false_accept_on_no_match, count_if(has AND p.n > 0) AS looked, count_if(has AND p.n > 0 AND got) AS hit, count_if(has AND p.n > 0 AND saw) AS showed, count_if(has AND p.n > 0 AND got AND NOT saw) AS cut, round(avg(size) FILTER (WHERE has AND p.n > 0), 2) AS mean_candidates,
  count_if(p.n > 0 AND NOT first_right AND acc AND correct) AS recovered, count_if(p.n > 1 AND first_right AND NOT (acc AND correct)) AS broken_by_retry, round(avg(p.n) FILTER (WHERE p.n > 0), 3) AS mean_attempts FROM p),
r AS (SELECT *, round(accepted_correct / nullif(accepted, 0), 4) AS pr, round(accepted_correct / nullif(with_gold, 0), 4) AS re FROM s)
SELECT n, with_gold, gold_no_match, accepted, accepted_correct, pr AS accepted_precision, round(accepted / n, 4) AS coverage, round(review / n, 4) AS review_rate, re AS final_recall, round(2 * pr * re / nullif(pr + re, 0), 4) AS final_f1, round(any_right / nullif(with_gold, 0), 4) AS recall_any_status, round(right_none / nullif(said_none, 0), 4) AS no_match_precision, round(right_none / nullif(gold_no_match, 0), 4) AS no_match_recall, false_accept_on_no_match,
  round(hit / looked, 4) AS candidate_recall, round(showed / looked, 4) AS candidate_recall_shown, cut AS truncated, mean_candidates, recovered, broken_by_retry, mean_attempts FROM r""")
def matching_metrics(spark, d):
    return reports.matching_metrics(predictions(spark, d), base.gold_sets(spark, d))


@oracle(f"""WITH s AS ({base.plain(base.SIGNALS)}), m AS (SELECT count(*) AS pairs, count_if(exact_key) AS positives, count_if(exact_key AND p_choice >= 0.5) AS tp, count_if(NOT exact_key AND p_choice >= 0.5) AS fp, count_if(exact_key AND p_choice < 0.5) AS fn FROM s)
SELECT *, round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall, round(2 * round(tp / nullif(tp + fp, 0), 4) * round(tp / nullif(tp + fn, 0), 4) / (round(tp / nullif(tp + fp, 0), 4) + round(tp / nullif(tp + fn, 0), 4)), 4) AS f1 FROM m""")
def pairwise_metrics(spark, d):
    rows = base.select(spark, d, base.SIGNALS)
    return reports.pairwise_metrics(rows.select(F.col("exact_key").alias("same"), (F.col("p_choice") >= 0.5).alias("predicted")))


BUCKETS = f"""{ALL}, k AS (SELECT source_id, bool_or(gold_id % 19 <> 0) AS known FROM gold GROUP BY ALL),
got AS (SELECT a.source_id, bool_or(g.gold_id IS NOT NULL AND candidate_count > 1) AS keyed, bool_or(g.gold_id IS NOT NULL) AS got FROM attempts a LEFT JOIN gold g ON g.source_id = a.source_id AND g.gold_id = a.chosen_id GROUP BY ALL),
deg AS (SELECT source_id, coalesce(bool_or(reason = 'candidate_budget_exceeded'), false) AS cut, coalesce(bool_or(retrieval_failures > 0), false) AS degraded FROM attempts GROUP BY ALL),
bucketed AS (SELECT source_id, CASE WHEN NOT labelled THEN 'unlabelled' WHEN no_match THEN 'no_gold' WHEN NOT coalesce(known, false) THEN 'gold_unreachable' WHEN correct THEN 'found' WHEN keyed THEN 'misjudged' WHEN got AND cut THEN 'truncated' WHEN degraded THEN 'unavailable' ELSE 'never_retrieved' END AS bucket FROM judged LEFT JOIN k USING (source_id) LEFT JOIN got USING (source_id) LEFT JOIN deg USING (source_id)),
hits AS (SELECT a.source_id, attempt, resolution FROM attempts a JOIN gold g ON g.source_id = a.source_id AND g.gold_id = a.chosen_id JOIN bucketed b ON b.source_id = a.source_id AND bucket NOT IN ('unlabelled', 'no_gold', 'gold_unreachable')),
counts AS (SELECT 'bucket' AS part, bucket AS name, count(*) AS n FROM bucketed GROUP BY ALL UNION ALL SELECT 'retriever', resolution, count(DISTINCT source_id) FROM hits GROUP BY ALL UNION ALL SELECT 'attempt', f::VARCHAR, count(*) FROM (SELECT source_id, min(attempt) AS f FROM hits GROUP BY ALL) GROUP BY ALL)"""


def bucketed(spark, d):
    a = catalog.attempts(spark, d)
    seen = a.groupBy("source_id").agg(F.collect_set("chosen_id").alias("retrieved"), F.collect_set(F.when(F.col("candidate_count") > 1, F.col("chosen_id"))).alias("keyed"), F.coalesce(F.bool_or(F.col("reason") == "candidate_budget_exceeded"), F.lit(False)).alias("cut"), F.coalesce(F.bool_or(F.col("retrieval_failures") > 0), F.lit(False)).alias("degraded"))
    rows = catalog.judged(spark, d).join(seen, "source_id").withColumn("known_gold", F.filter("gold_ids", lambda x: x % 19 != 0))
    return rows.select("source_id", evaluate.ceiling_bucket().alias("bucket"))


def ceiling(spark, d):
    seen = catalog.attempts(spark, d).where("chosen_id is not null").select("source_id", "attempt", F.col("chosen_id").alias("id"), F.col("resolution").alias("retriever"))
    return reports.ceiling_counts(bucketed(spark, d), seen, base.gold_sets(spark, d))


@oracle(f"{BUCKETS} SELECT * FROM counts")
def ceiling_report(spark, d):
    """Sources by bucket, by the way a right answer was found, and by the first attempt that found it."""
    return ceiling(spark, d)


@oracle(f"""{BUCKETS}, b AS (SELECT * FROM counts WHERE part = 'bucket'), f AS (SELECT * FROM b WHERE name IN ('never_retrieved', 'truncated', 'misjudged'))
SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM b WHERE name NOT IN ('unlabelled', 'no_gold', 'gold_unreachable')) AS evaluable, (SELECT coalesce(sum(n), 0)::BIGINT FROM f) AS faults, (SELECT arg_max(name, n) FROM f) AS worst, (SELECT round(max(n) / sum(n), 4) FROM f) AS share,
  (SELECT CASE arg_max(name, n) WHEN 'never_retrieved' THEN 'retrieval' WHEN 'truncated' THEN 'the candidate budget' ELSE 'prompts' END FROM f) AS spend_on, EXISTS (SELECT 1 FROM b WHERE name = 'unavailable') AS incomplete_traces, EXISTS (SELECT 1 FROM b WHERE name = 'gold_unreachable') AS unreachable_gold""")
def ceiling_advice(spark, d):
    return reports.ceiling_advice(ceiling(spark, d))


@oracle(f"""WITH p AS (SELECT vec_id AS item_id, label AS gold_id, vec_id % 40 AS c, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN 'needs_review' WHEN vec_id % 13 = 0 THEN 'failed' ELSE 'assigned' END AS outcome FROM embeddings),
x AS (SELECT *, outcome = 'assigned' AND outcome IS NOT NULL AS ok FROM p),
a AS (WITH items AS (SELECT item_id, gold_id, CASE WHEN ok THEN 'c:' || c ELSE 's:' || item_id END AS cluster_id FROM x), {PAIRS}), b AS (WITH items AS (SELECT item_id, gold_id, c AS cluster_id FROM x WHERE ok), {PAIRS}),
s AS (SELECT round(count_if(ok) / count(*), 4) AS accepted_coverage, round(count_if(coalesce(outcome, '') = 'needs_review') / count(*), 4) AS review_coverage, count_if(outcome IS NULL) AS missing FROM x)
SELECT *, 'as_singletons' AS convention FROM a, s UNION ALL SELECT *, 'accepted_only' FROM b, s""")
def clustering_conventions(spark, d):
    rows = base.select(spark, d, "SELECT vec_id AS item_id, vec_id % 40 AS cluster_id, CASE WHEN vec_id % 7 = 0 THEN 'needs_review' WHEN vec_id % 13 = 0 THEN 'failed' ELSE 'assigned' END AS outcome, vec_id % 11 = 0 AS absent FROM {embeddings}")
    gold = base.select(spark, d, "SELECT vec_id AS item_id, label AS gold_id FROM {embeddings}")
    return reports.evaluate_clustering(rows.where("not absent").drop("absent"), gold)


@oracle(f"""WITH thresholds AS (SELECT 0.6 AS accept_at, 0.4 AS review_floor UNION ALL SELECT 0.8, 0.4 UNION ALL SELECT 0.9, 0.4), {GOLD}, {RESULTS}, m AS (SELECT accept_at, {METRICS} FROM judged GROUP BY accept_at),
l AS (SELECT accept_at, 'accepted_precision' AS metric, accepted_precision::DOUBLE AS value FROM m UNION ALL SELECT accept_at, 'coverage', coverage FROM m UNION ALL SELECT accept_at, 'recall', recall FROM m)
SELECT CASE WHEN l.accept_at < 0.85 THEN 'strict' ELSE 'stricter' END AS variant, metric, l.value, round(l.value - b.value, 4) AS delta FROM l JOIN (SELECT metric, value FROM l WHERE accept_at < 0.7) b USING (metric) WHERE l.accept_at > 0.7""")
def ablation_delta(spark, d):
    run = lambda accept=0.6: catalog.at_floors(spark, d, accept, 0.4)
    return reports.ablate(run, base.gold_sets(spark, d), {"strict": {"accept": 0.8}, "stricter": {"accept": 0.9}}, ["accepted_precision", "coverage", "recall"])


@oracle(f"""WITH thresholds AS (SELECT 0.6 AS accept_at, 0.4 AS review_floor UNION ALL SELECT 0.8, 0.5), {GOLD}, {RESULTS},
a AS (SELECT source_id, CASE WHEN status = 'matched' THEN matched_id END AS a, coalesce(confidence, 0) AS ca FROM results WHERE accept_at = 0.6), b AS (SELECT source_id, CASE WHEN status = 'matched' THEN matched_id + source_id % 2 END AS b, coalesce(confidence, 0) - CASE WHEN source_id % 3 = 0 THEN 0.25 ELSE 0 END AS cb FROM results JOIN orders ON o_orderkey = source_id WHERE accept_at = 0.8 AND o_orderstatus <> 'P'),
m AS (SELECT source_id, a, b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a = b THEN 'consensus' WHEN abs(ca - coalesce(cb, 0)) >= 0.2 THEN CASE WHEN ca > cb THEN 'surer_first' ELSE 'surer_second' END ELSE 'conflict' END WHEN a IS NOT NULL THEN 'only_first' WHEN b IS NOT NULL THEN 'only_second' ELSE 'none' END AS method FROM a LEFT JOIN b USING (source_id))
SELECT source_id, method, CASE WHEN method IN ('consensus', 'surer_first', 'only_first') THEN a WHEN method IN ('surer_second', 'only_second') THEN b END AS matched_id, CASE WHEN method = 'conflict' THEN 'needs_review' WHEN method = 'none' THEN 'unmatched' ELSE 'matched' END AS status FROM m""")
def ensemble(spark, d):
    """Two runs, of which the second lacks the orders that are partly shipped and answers odd ones otherwise."""
    orders = base.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), "o_orderstatus")
    second = catalog.at_floors(spark, d, 0.8, 0.5).join(orders.where("o_orderstatus <> 'P'"), "source_id").withColumn("matched_id", F.col("matched_id") + F.col("source_id") % 2).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)) - F.when(F.col("source_id") % 3 == 0, 0.25).otherwise(0.0))
    return reports.ensemble(orders, catalog.results(spark, d), second)


@oracle(f"""{LOGS}, n AS (SELECT count(*) AS snapshot_size, count_if(status IS NULL) AS pending, count_if(status = 'failed') AS failed, count_if(status = 'needs_review') AS review FROM snapshot LEFT JOIN cur USING (source_id))
SELECT *, (SELECT count(*) FROM log) AS history, (SELECT count(*) FROM cur) AS sources_seen, CASE WHEN failed > 0 THEN 'failed' WHEN pending > 0 THEN 'partial' ELSE 'complete' END AS state, CASE WHEN failed > 0 THEN 3 WHEN review > 0 OR pending > 0 THEN 1 ELSE 0 END AS exit_code FROM n""")
def run_counts(spark, d):
    return reports.run_state(reports.counts(catalog.snapshot(spark, d), catalog.log(spark, d)))


@oracle(f"{LOGS} SELECT source_id FROM snapshot WHERE source_id NOT IN (SELECT source_id FROM cur WHERE status <> 'failed') ORDER BY source_id LIMIT 25")
def first_unfinished(spark, d):
    return reports.first_unfinished(catalog.snapshot(spark, d), catalog.log(spark, d), 25)


def log_with_usage(spark, d):
    usage = F.struct((F.col("seq") % 900).alias("prompt_tokens"), (F.col("seq") % 70).alias("completion_tokens"), F.lit(2).alias("calls"), F.lit(0).alias("unknown_calls"), (F.col("seq") % 3).alias("cache_hits"), F.lit(0.0).alias("cost_usd"))
    return catalog.log(spark, d).withColumn("reason", F.concat(F.lit("because_"), "status")).withColumn("usage", usage)


@oracle(f"""{LOGS} SELECT source_id::VARCHAR AS source_id, coalesce(matched_id::VARCHAR, '') AS matched_id, coalesce(status, 'pending') AS status, coalesce('because_' || status, 'pending') AS reason, '' AS explanation, '' AS attempts, coalesce((seq % 900)::VARCHAR, '') AS prompt_tokens, coalesce((seq % 70)::VARCHAR, '') AS completion_tokens,
  CASE WHEN seq IS NULL THEN '' ELSE '2' END AS llm_calls, '' AS elapsed_seconds, CASE WHEN seq IS NULL THEN '' ELSE '0' END AS unknown_calls, coalesce((seq % 3)::VARCHAR, '') AS cache_hits FROM snapshot LEFT JOIN cur USING (source_id)""")
def mapping_export(spark, d):
    """The mapping file's rows, less the two columns that are printed as floating-point numbers."""
    return exports.mapping(catalog.snapshot(spark, d), log_with_usage(spark, d)).drop("confidence", "cost_usd")


@oracle(f"""{LOGS}, n AS (SELECT source_id, count(*) AS now FROM log GROUP BY ALL), f AS (SELECT r.* FROM reviews r JOIN n USING (source_id) WHERE result_revision = now QUALIFY row_number() OVER (PARTITION BY r.source_id ORDER BY review_id DESC) = 1)
SELECT s.source_id::VARCHAR AS source_id, coalesce((CASE decision WHEN 'replace' THEN corrected_id WHEN 'reject' THEN NULL WHEN 'no_match' THEN NULL ELSE matched_id END)::VARCHAR, '') AS final_matched_id, CASE WHEN decision IN ('accept', 'replace') THEN 'matched' WHEN decision IN ('reject', 'no_match') THEN 'unmatched' WHEN decision = 'defer' THEN 'needs_review' ELSE coalesce(status, 'pending') END AS final_status,
  coalesce(decision, '') AS review_decision, coalesce(corrected_id::VARCHAR, '') AS corrected_target_id, '' AS reviewer, '' AS review_note, '' AS reviewed_at, coalesce(matched_id::VARCHAR, '') AS model_matched_id, coalesce(status, '') AS model_status, '' AS model_reason, '' AS result_key FROM snapshot s LEFT JOIN cur c USING (source_id) LEFT JOIN f ON f.source_id = c.source_id""")
def reviewed_export(spark, d):
    return exports.reviewed(catalog.snapshot(spark, d), catalog.log(spark, d), catalog.reviews(spark, d)).drop("confidence")


@oracle("SELECT event_id AS seq, user_id::VARCHAR AS source_id, (event_id % 50)::VARCHAR AS matched_id, event_type AS status, (event_id % 900)::BIGINT AS prompt_tokens, 1 AS n_attempts, 'q' || event_id AS first_query FROM events")
def results_round_trip(spark, d):
    """Results as JSON and back."""
    rows = base.table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").cast("string").alias("result_key"), (F.col("event_id") % 50).alias("matched_id"), F.col("event_type").alias("status"), F.struct((F.col("event_id") % 900).alias("prompt_tokens"), *(F.lit(0).cast(t).alias(n) for n, t in (("completion_tokens", "long"), ("calls", "long"), ("unknown_calls", "long"), ("cache_hits", "long"), ("cost_usd", "double")))).alias("usage"))
    query = F.concat(F.lit("q"), "result_key")
    tried = F.array(F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name != "query" else query.alias("query") for f in exports.ATTEMPT.fields)))
    back = exports.from_json(exports.to_json(rows.withColumn("attempts", tried)))
    return back.select(F.col("result_key").cast("long").alias("seq"), "source_id", "matched_id", "status", F.col("usage.prompt_tokens").alias("prompt_tokens"), F.size("attempts").alias("n_attempts"), F.col("attempts")[0].query.alias("first_query"))


@oracle("SELECT p_partkey::VARCHAR AS item_id, CASE WHEN p_size > 45 THEN '' ELSE p_name END AS cluster_id, CASE WHEN p_size > 45 THEN 'needs_review' WHEN count(*) OVER (PARTITION BY CASE WHEN p_size > 45 THEN '' ELSE p_name END) > 1 THEN 'assigned' ELSE 'singleton' END AS outcome FROM part")
def read_assignments(spark, d):
    return exports.assignments(base.select(spark, d, "SELECT concat(' ', p_partkey) AS source_id, CASE WHEN p_size > 45 THEN NULL ELSE p_name END AS cluster_id, CASE WHEN p_size > 45 THEN 'needs_review' END AS outcome FROM {part}"))


DRAWN = "(('0x' || substr(sha256('salt' || chr(0) || c_custkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


@oracle(f"SELECT c_custkey AS source_id, CASE WHEN c_nationkey = 3 THEN 'test' WHEN {DRAWN} < 0.5 THEN 'prompt_train' WHEN {DRAWN} < 0.75 THEN 'validation' ELSE 'test' END AS partition FROM customer")
def partition_overrides(spark, d):
    rows = base.table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), "c_nationkey")
    named = rows.where("c_nationkey = 3").select("source_id", F.lit("test").alias("partition"))
    return exports.partitioned(rows, ids.partition_of(ids.draw("salt", F.col("source_id")), {"prompt_train": 0.5, "validation": 0.25, "test": 0.25}), named)


@oracle(r"SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY trim(regexp_replace(lower(p_name || '  ' || p_type), '\s+', ' ', 'g')), p_partkey) AS place FROM part")
def order_sources(spark, d):
    """Sources of a block in the order of their labels."""
    label = tx.order_key(F.concat("p_name", F.lit("  "), "p_type"))
    return base.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.row_number().over(Window.partitionBy("p_brand").orderBy(label, "p_partkey")).alias("place"))


@oracle("SELECT c_custkey AS source_id, row_number() OVER (ORDER BY sha256('pilot' || c_custkey), c_custkey) AS place FROM customer")
def salted_order(spark, d):
    return ledger.salted_order(base.table(spark, d, "customer").select(F.col("c_custkey").alias("source_id")), "pilot")


@oracle("""SELECT p_partkey, lower(p_name) || CASE WHEN lower(p_name) = lower(p_type) THEN '' ELSE '|' || lower(p_type) END AS forms, p_name || CASE WHEN p_size > 25 AND upper(p_name) <> p_name THEN '|' || upper(p_name) ELSE '' END || '|' || p_type AS queries,
  array_to_string(list_transform(regexp_extract_all(lower(p_name || 's ' || p_type || 'ies'), '[a-z0-9]+'), lambda w: CASE WHEN len(w) > 3 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN len(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END), ' ') AS singular,
  substr(sha256('{"fields":{"name":"' || p_name || '"' || CASE WHEN p_size > 25 THEN ',"size":' || p_size ELSE '' END || '},"id":"' || p_partkey || '"}'), 1, 16) AS digest FROM part""")
def record_forms(spark, d):
    """Exact forms, rendered queries, singular keys and canonical hashes of records."""
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size")
    forms = tx.exact_forms(F.array(F.upper(name), name), F.array(kind))
    queries = tx.rendered_queries(F.concat(F.lit(" "), name), F.when(size > 25, F.upper(name)), kind, F.when(size < 10, kind), F.lit(" "))
    digest = ids.short_hash(ids.canonical_record(F.col("p_partkey"), name=name, size=F.when(size > 25, size)))
    return base.table(spark, d, "part").select("p_partkey", F.array_join(forms, "|").alias("forms"), F.array_join(queries, "|").alias("queries"), tx.singular_key(F.concat(name, F.lit("s "), kind, F.lit("ies"))).alias("singular"), digest.alias("digest"))


@oracle("""WITH m AS (SELECT event_id, event_id % 5 <> 0 AS a1, event_id % 3 AS v1, event_id % 2 AS v2, event_id % 7 <> 0 AS b1 FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN a1 <> b1 OR (a1 AND b1 AND v1 <> v2) THEN 'depth' END, CASE WHEN v1 <> 0 THEN 'engine' END], lambda x: x IS NOT NULL), ',') AS differ FROM m""")
def component_differences(spark, d):
    e = F.col("event_id")
    before = F.map_from_entries(F.filter(F.array(F.struct(F.lit("engine").alias("k"), F.lit(0).cast("long").alias("v")), F.struct(F.lit("depth").alias("k"), F.when(e % 5 != 0, e % 3).alias("v"))), lambda x: x.v.isNotNull()))
    after = F.map_from_entries(F.filter(F.array(F.struct(F.lit("engine").alias("k"), (e % 3).alias("v")), F.struct(F.lit("depth").alias("k"), F.when(e % 7 != 0, e % 2).alias("v"))), lambda x: x.v.isNotNull()))
    return base.table(spark, d, "events").select("event_id", F.array_join(tx.component_differences(before, after), ",").alias("differ"))


@oracle(f"""WITH q AS ({QUERY_VECTORS}), s AS (SELECT query_id, vec_id AS id, vec_id // 4 AS record, {DOT.format('q', 'embedding')} AS score FROM q, embeddings), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS r FROM s QUALIFY r <= 50),
b AS (SELECT query_id, record AS id, max(score) AS score FROM n GROUP BY ALL) SELECT query_id, id, round(score, 6) + 0.0 AS score, {RANK} AS rank FROM b QUALIFY {RANK} <= 10""")
def nearest_records(spark, d):
    """Records by their best row among five times as many nearest rows."""
    v = catalog.vectors(spark, d)
    return catalog.rounded(retrieval.nearest_records(catalog.asked_vectors(v), v, F.floor(F.col("id") / 4)))


@oracle("SELECT p_partkey AS id, o.ord, CASE WHEN o.ord = 0 THEN 'doc' ELSE 'name' END AS kind, CASE o.ord WHEN 0 THEN CASE WHEN p_size > 45 THEN '' ELSE p_name || ' ' || p_type END WHEN 1 THEN p_name ELSE p_type END AS text, CASE WHEN o.ord = 0 AND p_size > 45 THEN 0.0 ELSE 1.0 END AS length FROM part, (SELECT unnest([0, 1, 2])::INT AS ord) o")
def dense_rows(spark, d):
    """What is encoded of each record, its text and names, and the length of each vector."""
    part = base.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type", "p_size")
    rows = targets.vector_rows(part, F.array("p_name", "p_type"), F.when(F.col("p_size") <= 45, F.concat_ws(" ", "p_name", "p_type")))
    done = targets.encoded(rows, dimensions=16)
    return done.select("id", "ord", "kind", "text", F.round(F.sqrt(tx.dot(F.col("vector"), F.col("vector"))), 6).alias("length"))


@oracle(f"""{CAND}, k AS (SELECT query_id, id, rank, sum(size + CASE WHEN rank > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) <= 600 AS kept FROM sized)
SELECT query_id, count_if(kept) AS kept, count_if(NOT kept) AS dropped, CASE WHEN count_if(kept) = 0 THEN 'candidate_budget_exceeded' END AS reason FROM k GROUP BY query_id""")
def budget_outcome(spark, d):
    return retrieval.budget_outcome(retrieval.within_budget(catalog.sized(spark, d), F.col("size"), 12, 600))


@oracle(f"WITH {bm25(ITEMS, DOCS, 'a')}, r AS (SELECT query_id, id, {RANK} AS rank FROM a QUALIFY {RANK} <= 12) SELECT query_id, id, rank FROM r WHERE id IN (SELECT doc_id FROM labels)")
def known_hits(spark, d):
    """Hits whose document is among the labelled ones."""
    return retrieval.known(catalog.candidates(spark, d, 12), base.table(spark, d, "labels").select(F.col("doc_id").alias("id"))).select("query_id", "id", "rank")


@oracle("SELECT p_partkey AS id, 0 AS ord, p_name AS text FROM part WHERE NOT (p_size <= 30 AND p_size > 10)")
def missing_vectors(spark, d):
    """Rows whose vector a store lacks: those never stored, and those stored of another text."""
    rows = base.select(spark, d, "SELECT p_partkey AS id, 0 AS ord, p_name AS text, p_size FROM {part}")
    folder = targets.Targets(spark, f"{store.Work(spark, 'targets').root}/targets")
    held = rows.where("p_size <= 30").withColumn("text", F.when(F.col("p_size") <= 10, F.upper("text")).otherwise(F.col("text")))
    folder.add_vectors("parts", targets.encoded(held.select("id", "ord", "text"), dimensions=4), 4)
    return folder.missing_vectors("parts", rows.select("id", "ord", "text"))


@oracle("SELECT CASE WHEN p_size > 40 THEN 'insert' WHEN p_size < 5 THEN 'prune' WHEN p_size % 3 = 0 THEN 'update' ELSE 'keep' END AS action, count(*) AS n FROM part GROUP BY ALL")
def target_load(spark, d):
    """A catalogue loaded, then loaded again with changed, new and missing records."""
    rows = base.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), "p_size")
    folder = targets.Targets(spark, f"{store.Work(spark, 'targets').root}/targets")
    folder.load("parts", rows.where("p_size <= 40"))
    return folder.load("parts", rows.where("p_size >= 5").withColumn("label", F.when((F.col("p_size") % 3 == 0) & (F.col("p_size") <= 40), F.upper("label")).otherwise(F.col("label"))), prune=True)


@oracle(f"""WITH a AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 0.25 WHEN 5 THEN 1.0 END AS value, CASE event_id % 8 WHEN 1 THEN 'out_of_bounds' WHEN 2 THEN 'not_a_number' WHEN 3 THEN 'missing' WHEN 4 THEN 'not_an_object' WHEN 6 THEN 'not_a_number' WHEN 7 THEN 'not_an_object' END AS error FROM events) SELECT event_id, value::DOUBLE AS value, error FROM a""")
def typed_decisions(spark, d):
    """Answers against their contract: nothing is coerced or clamped."""
    said = F.array(*map(F.lit, ['{"value": 0.25}', '{"value": 1.5}', '{"value": "0.5"}', '{"other": 1}', "no", '```json\n{"value": 1,}\n```', '{"value": true}', "[0.5]"]))
    return base.table(spark, d, "events").select("event_id", answers.decision(F.get(said, (F.col("event_id") % 8).cast("int"))).alias("a")).select("event_id", "a.value", "a.error")


@oracle("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'x y' END AS queries, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'C01,C02' ELSE '' END AS keys FROM events")
def scorer_lists(spark, d):
    """A scorer's lists of queries and keys: strings only, keys that were issued only."""
    said = F.get(F.array(*map(F.lit, ['[" a", "b", "a", ""]', "null", '["c01", 3, "C02", "C09", null]', '["x y", {"q": 1}]'])), (F.col("event_id") % 4).cast("int"))
    keyed = F.array(F.lit("C01"), F.lit("C02"))
    return base.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 2, F.array_join(answers.clean_list(said), ",")).otherwise("").alias("queries"), F.array_join(answers.clean_list(said, keyed), ",").alias("keys"))


@oracle(f"{LOGS} SELECT coalesce(status, 'pending') AS status, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, min(confidence) AS least_confidence, max(seq) AS last_seq FROM snapshot LEFT JOIN cur USING (source_id) GROUP BY 1")
def inspect_run(spark, d):
    return ledger.inspected(catalog.snapshot(spark, d), catalog.log(spark, d))


@oracle("SELECT user_id AS run, max(event_id) AS seq, coalesce(arg_max(CASE WHEN event_type = 'signup' THEN 'none' ELSE event_type END, event_id), 'interrupted') AS s, CASE WHEN s = 'none' THEN 'interrupted' ELSE s END AS state FROM events GROUP BY user_id")
def last_invocation(spark, d):
    rows = base.select(spark, d, "SELECT user_id AS run, event_id AS seq, CASE WHEN event_type <> 'signup' THEN event_type END AS state FROM {events}")
    last = ledger.last_invocation(rows)
    return last.select("run", "seq", F.when(F.col("state") == "interrupted", "none").otherwise(F.col("state")).alias("s"), "state")


@oracle(f"""{ALL}, s AS (SELECT source_id::VARCHAR AS source_id, status, matched_id FROM results), c AS (SELECT source_id AS item_id, CASE WHEN status = 'matched' AND matched_id IS NOT NULL THEN 't:' || matched_id WHEN status = 'unmatched' THEN 's:' || source_id ELSE 'r:' || source_id END AS cluster_id, status FROM s)
SELECT item_id::BIGINT AS item_id, cluster_id, CASE WHEN cluster_id LIKE 'r:%' THEN CASE WHEN status = 'needs_review' THEN 'needs_review' ELSE 'failed' END WHEN count(*) OVER (PARTITION BY cluster_id) > 1 THEN 'assigned' ELSE 'singleton' END AS outcome FROM c""")
def clusters_via_matching(spark, d):
    return cluster.by_matching(catalog.results(spark, d))


@oracle(f"""WITH {bm25(ITEMS, DOCS, 'a')}, h AS (SELECT query_id, id, {RANK} AS rank FROM a QUALIFY {RANK} <= 300),
o AS (SELECT query_id, id, rank, len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))) AS j FROM (SELECT h.*, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS t FROM h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.id)),
s AS (SELECT query_id, id, rank, round(j, 4) AS p FROM o), n AS (SELECT query_id, count(*) AS candidate_count, max(p) AS best FROM s GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, rank) AS place FROM s JOIN n USING (query_id) WHERE best >= 0.3 QUALIFY place <= 15), k AS (SELECT * FROM l WHERE p >= 0.2),
c AS (SELECT query_id, first(id ORDER BY p DESC, rank DESC) AS chosen, max(p) AS p, max(p) / sum(p) AS p_choice FROM k GROUP BY ALL),
v AS (SELECT i.item_id AS query_id, candidate_count, best, chosen, p, p_choice, CASE WHEN best IS NULL THEN 'unmatched:no_candidates' WHEN best < 0.3 THEN 'unmatched:below_review_floor' WHEN p >= 0.85 AND p_choice >= 0.5 AND round(p * 3, 0) >= 2 THEN 'matched:accept_threshold' ELSE 'needs_review:below_accept_threshold' END AS v FROM benchmark i LEFT JOIN n ON n.query_id = i.item_id LEFT JOIN c ON c.query_id = i.item_id)
SELECT query_id::VARCHAR AS source_id, CASE WHEN v LIKE 'unmatched%' THEN NULL ELSE chosen::VARCHAR END AS matched_id, string_split(v, ':')[1] AS status, string_split(v, ':')[2] AS reason, coalesce(candidate_count, 0) AS candidate_count, round(p_choice, 6) AS p_choice FROM v""")
def decider_match(spark, d):
    """The decider's path over the benchmark texts: screen, shortlist, choose, gate, status."""
    docs, index = base.documents(spark, d), base.text_index(spark, d)
    sources = base.benchmark(spark, d).withColumnRenamed("query_id", "source_id")
    found = matcher.decide_sources(sources, docs, index.search, matcher.lexical_decider())
    return found.select("source_id", "matched_id", "status", "reason", "candidate_count", F.round("p_choice", 6).alias("p_choice"))


@oracle("SELECT p_partkey, 'K' || substr(sha256('run|' || p_partkey), 1, 16) AS cluster_id FROM part")
def minted_ids(spark, d):
    """Names of clusters by run and seed."""
    return base.table(spark, d, "part").select("p_partkey", cluster.mint_id("run", F.col("p_partkey")).alias("cluster_id"))


@oracle(f"""WITH s AS ({base.plain(base.SIGNALS)}) SELECT order_id, part_id, supp_id, line, md5(array_to_string(list_filter([CASE WHEN screen_best IS NOT NULL THEN 'best screen ' || printf('%.2f', screen_best) END, CASE WHEN screen_chosen IS NOT NULL THEN 'chosen screen ' || printf('%.2f', screen_chosen) END,
  CASE WHEN p_choice IS NOT NULL THEN 'choice ' || printf('%.2f', p_choice) END, CASE WHEN p_none IS NOT NULL THEN 'none ' || printf('%.2f', p_none) END], lambda x: x IS NOT NULL), '; ')) AS digest FROM s""")
def decider_explanation(spark, d):
    """The numbers behind each decision, in one line."""
    return base.select(spark, d, base.SIGNALS).select("order_id", "part_id", "supp_id", "line", F.md5(decide.explanation()).alias("digest"))


@oracle(f"""WITH {bm25("SELECT 0 AS query_id, 'red anvil of promo' AS text", "SELECT p_partkey AS id, p_name || ' ' || p_type AS text FROM part", 'a')}, {OVERLAP},
hits AS (SELECT 'bm25' AS retriever, query_id, id, {RANK} AS rank FROM a QUALIFY {RANK} <= 20 UNION ALL SELECT 'overlap', query_id, id, {RANK} FROM b QUALIFY {RANK} <= 20),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, string_agg(retriever || ':' || rank, '|' ORDER BY retriever || ':' || rank) AS evidence FROM hits GROUP BY ALL)
SELECT id, {RANK} AS rank, round(score, 9) AS score, evidence, p_name || ' ' || p_type AS text FROM f JOIN part ON p_partkey = id QUALIFY {RANK} <= 20""")
def interactive_search(spark, d):
    """One text asked of two retrievers: ranks, how each ranked it, and the texts."""
    docs = base.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    index = retrieval.postings(docs)
    lists = {"bm25": lambda q, k: retrieval.bm25_topk(q, docs, k), "overlap": lambda q, k: retrieval.top(retrieval.overlap_scores(q, index), k)}
    return catalog.rounded(retrieval.search_one("red anvil of promo", lists, docs), 9)


@oracle(f"""{LOGS}, s AS (SELECT min(source_id) AS one FROM log) SELECT 'result' AS what, seq AS at FROM log, s WHERE source_id = one UNION ALL SELECT 'review', review_id FROM reviews, s WHERE source_id = one""")
def explain_source(spark, d):
    """All that the ledger holds of its first source."""
    log = catalog.log(spark, d)
    first = log.agg(F.min("source_id")).first()[0]
    none = log.select("source_id", F.lit(0).alias("attempt")).where("false")
    return ledger.explained(first, log, none, base.select(spark, d, base.REVIEWS)).select("what", "at")


@query
def ann_topk(spark, d):
    """Approximate neighbours by an inverted file; ``ann_recall`` measures it."""
    v = catalog.vectors(spark, d)
    return catalog.rounded(ann.topk(catalog.asked_vectors(v), v))


@query
def ann_recall(spark, d):
    """The share of the exact ten nearest that the inverted file finds."""
    v = catalog.vectors(spark, d)
    asked = catalog.asked_vectors(v)
    return ann.recall(ann.topk(asked, v), retrieval.dense_topk(asked, v))


def quantised_search(spark, d) -> DataFrame:
    v = catalog.vectors(spark, d)
    index = quantised.QuantisedIndex.build(v, f"{store.Work(spark, 'codes').root}/index")
    return index.search(catalog.asked_vectors(v))


@query
def quantised_topk(spark, d):
    """Approximate neighbours by short codes, compared exactly at the end."""
    return catalog.rounded(quantised_search(spark, d))


@oracle("SELECT count(*) AS hits, true AS reached FROM (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0) q, range(1, 11) r(rank) WHERE rank <= (SELECT count(*) FROM embeddings)")
def quantised_reach(spark, d):
    """How many exact hits there are, and whether the short codes find nine in ten of them."""
    v = catalog.vectors(spark, d)
    measured = ann.recall(quantised_search(spark, d), retrieval.dense_topk(catalog.asked_vectors(v), v))
    return measured.select("hits", (F.col("recall") >= 0.9).alias("reached"))


@query
def engine_warnings(spark, d):
    """Blocks of the engine's runs that a reader should look at."""
    return engine.warnings(engine_log(spark, d))


@query
def decider_match_rewriting(spark, d):
    """The same with a second pass, by the first half of a text, for what the first one missed."""
    docs, index = base.documents(spark, d), base.text_index(spark, d)
    sources = base.benchmark(spark, d).withColumnRenamed("query_id", "source_id")
    half = lambda text: F.array(F.array_join(F.slice(F.split(text, " "), 1, F.greatest(F.lit(1), F.floor(F.size(F.split(text, " ")) / 2).cast("int"))), " "))
    return matcher.decide_sources(sources, docs, index.search, matcher.lexical_decider(half)).drop("properties")


@query
def stemmed_search(spark, d):
    """BM25 over English stems: an index of its own."""
    index = TextIndex.build(base.documents(spark, d), f"{store.Work(spark, 'stems').root}/index", identity_of("en_stem"), inverted=False)
    return catalog.rounded(index.search(base.benchmark(spark, d), 10))


@query
def match_loop(spark, d):
    """The retry loop over the benchmark texts: results, with how many attempts each took."""
    docs, index = base.documents(spark, d), base.text_index(spark, d)
    sources = base.benchmark(spark, d).withColumnRenamed("query_id", "source_id")
    return matcher.match(sources, docs, index.search, matcher.lexical_models())[0]


#: Logs of engine runs that this process has written, by session and tables.
LOGS_OF: dict[tuple[str, str], DataFrame] = {}


def engine_log(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in LOGS_OF:
        rows = base.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("label"), F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("b"))
        LOGS_OF[key] = engine.cluster_blocks(rows, F.col("b"))
    return LOGS_OF[key]


@query
def engine_members(spark, d):
    """Parts clustered by the engine, each brand and size by itself: where every part ends."""
    return engine.selected_members(engine_log(spark, d))


@query
def engine_summary(spark, d):
    """How each block's run ended."""
    return engine.run_summary(engine_log(spark, d))


@query
def fuzzy_best(spark, d):
    """The nearest part name of each supplier's text, over all names."""
    part = base.table(spark, d, "part")
    asked = base.table(spark, d, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("source_id"), F.concat(F.substring("p_name", 2, 100), F.lit("s")).alias("mention"))
    return retrieval.fuzzy_best(asked, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@oracle(f"""{ALL}, m AS (SELECT {METRICS} FROM judged), l AS (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM m) ON COLUMNS(*) INTO NAME name VALUE value),
u AS (SELECT 'metrics' AS section, name, value FROM l UNION ALL SELECT 'status', status, count(*)::DOUBLE FROM results GROUP BY ALL
  UNION ALL SELECT 'partition', CASE WHEN d < 0.5 THEN 'fit' ELSE 'test' END, count(*)::DOUBLE FROM (SELECT ('0x' || substr(sha256('r' || chr(0) || source_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS d FROM results) GROUP BY ALL
  UNION ALL SELECT 'attempts', n::VARCHAR, count(*)::DOUBLE FROM (SELECT source_id, count(*) AS n FROM attempts WHERE attempt IS NOT NULL GROUP BY ALL) GROUP BY ALL) SELECT * FROM u""")
def full_report(spark, d):
    results = catalog.results(spark, d)
    parts = results.select("source_id", ids.partition_of(ids.draw("r", F.col("source_id")), {"fit": 0.5, "test": 0.5}).alias("part"))
    return reports.full_report(results, catalog.attempts(spark, d), base.gold_sets(spark, d), parts)



@oracle("""
WITH c AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer),
changed AS (SELECT id, segment, CASE WHEN balance < 0 THEN 0.0 ELSE balance END AS balance FROM c WHERE NOT (segment = 'BUILDING' AND balance > 5000)),
grown AS (SELECT * FROM changed UNION ALL SELECT -id, 'NEW', 1.0 FROM c WHERE id BETWEEN 1 AND 100)
SELECT 'before' AS version, segment, count(*) AS n, round(sum(balance), 2) AS total FROM c GROUP BY segment
UNION ALL SELECT 'changed', segment, count(*), round(sum(balance), 2) FROM changed GROUP BY segment
UNION ALL SELECT 'compacted', segment, count(*), round(sum(balance), 2) FROM grown GROUP BY segment
""")
def table_versions(spark, d):
    """A table that changes in place, as three of its versions show it: deltas and marks, then merged buckets."""
    rows = base.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    table = delta.DeltaTable(spark, f"{store.Work(spark, 'versions').root}/customers")
    first = table.create(rows, ["id"], 16)
    table.change(rows.where("balance < 0").withColumn("balance", F.lit(0.0)), rows.where("segment = 'BUILDING' and balance > 5000"))
    second = table.version()
    table.change(rows.where("id between 1 and 100").select((-F.col("id")).alias("id"), F.lit("NEW").alias("segment"), F.lit(1.0).alias("balance")))
    table.compact(1)
    every = [table.read(v).withColumn("version", F.lit(n)) for n, v in (("before", first), ("changed", second), ("compacted", None))]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("version", "segment").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("total"))


PART_TEMPLATE = """{# what a part is #}{{ p_name | upper }}{% if p_size > 30 %} large{% elif p_size > 10 %} middle{% else %} small{% endif %}
{% for w in words %}{{ loop.index }}.{{ w }}{% if not loop.last %}, {% endif %}{% endfor %} {{ 'brass' if 'BRASS' in words else 'other' }}"""


@oracle("""
WITH p AS (SELECT p_partkey AS id, p_name, p_size, string_split(p_type, ' ') AS words FROM part)
SELECT id, upper(p_name) || CASE WHEN p_size > 30 THEN ' large' WHEN p_size > 10 THEN ' middle' ELSE ' small' END || chr(10)
  || array_to_string(list_transform(range(1, len(words) + 1), lambda i: i || '.' || words[i]), ', ') || CASE WHEN list_contains(words, 'BRASS') THEN ' brass' ELSE ' other' END AS text FROM p
""")
def compiled_template(spark, d):
    """Parts as a template with branches and a loop says them, compiled to one column."""
    rows = base.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size", F.split("p_type", " ").alias("words"))
    return rows.select("id", templates.compiled(PART_TEMPLATE, rows.schema).alias("text"))


@oracle("""
WITH c AS (SELECT c_custkey AS source_id, CASE WHEN c_acctbal < 0 THEN 'unmatched' WHEN c_mktsegment = 'BUILDING' THEN 'needs_review' ELSE 'matched' END AS status FROM customer)
SELECT 'current' AS section, status AS name, count(*) AS n FROM c GROUP BY status
UNION ALL SELECT 'invocation', 'partial', (SELECT count(*) // 4 FROM c)
UNION ALL SELECT 'invocation', 'complete', (SELECT count(*) - count(*) // 4 FROM c)
""")
def batch_lifecycle(spark, d):
    """A run of customers in two invocations: a quarter first, then what is left; nothing is decided twice."""
    rows = base.table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), "c_acctbal", "c_mktsegment")
    status = F.when(F.col("c_acctbal") < 0, "unmatched").when(F.col("c_mktsegment") == "BUILDING", "needs_review").otherwise("matched")
    run = batch.BatchRun(spark, f"{store.Work(spark, 'batch').root}/run", {"rule": "balance"})
    decide_all = lambda some: some.join(rows, "source_id").select("source_id", status.alias("status"), F.lit(None).cast("string").alias("matched_id"), F.lit(1.0).alias("confidence"))
    sources = rows.select("source_id")
    quarter = rows.count() // 4
    run.invoke(sources, decide_all, passes=2, limit=quarter)
    run.invoke(sources, decide_all, passes=3)
    now = run.results().groupBy("status").agg(F.count("*").alias("n")).select(F.lit("current").alias("section"), F.col("status").alias("name"), "n")
    return now.unionByName(run.invocations().select(F.lit("invocation").alias("section"), F.col("state").alias("name"), F.col("decided").alias("n")))


@oracle(f"""{ALL} SELECT source_id, status, (SELECT count(*) FROM results WHERE status = 'matched') AS total,
CASE WHEN (SELECT count(*) FROM results WHERE status = 'matched') > 150 THEN 150 END::BIGINT AS next_offset FROM results WHERE status = 'matched' ORDER BY source_id LIMIT 50 OFFSET 100""")
def matched_page(spark, d):
    """A page of the matched results, read from the ranges that it lies in."""
    return ledger.Pages(catalog.results(spark, d)).page(100, 50, "matched").select("source_id", "status", "total", "next_offset")


@oracle(f"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS e FROM embeddings WHERE vec_id % 11 <> 0),
l AS (SELECT id, list_transform(e, lambda x: x / sqrt({DOT.format('e', 'e')})) AS u FROM v), q AS ({QUERY_VECTORS}),
s AS (SELECT query_id, id, {DOT.format('q', 'u')} / sqrt({DOT.format('q', 'q')}) AS score FROM q, l WHERE id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def vector_pool(spark, d):
    """A pool that was built, changed and thinned, searched without each query's own row."""
    v = catalog.vectors(spark, d).select("id", "vector")
    turned = F.transform("vector", lambda x: -x)
    held = pool.VectorPool(spark, f"{store.Work(spark, 'pool').root}/vectors")
    held.upsert(v.where("id % 3 <> 0").withColumn("vector", F.when(F.col("id") % 5 == 0, turned).otherwise(F.col("vector"))))
    held.upsert(v.where("id % 3 = 0 or id % 5 = 0 or id % 7 = 0").withColumn("vector", F.when(F.col("id") % 7 == 0, turned).otherwise(F.col("vector"))))
    held.remove(v.where("id % 11 = 0"))
    asked = catalog.asked_vectors(catalog.vectors(spark, d))
    found = held.search(asked, 10, asked.select("query_id", F.col("query_id").alias("id")))
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


#: Parts as classes: how they are written, and the rows that reading them gives.
PART_CLASSES = """
WITH p AS (SELECT concat('P:', p_partkey) AS id, p_name AS label, array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), '|') AS synonyms, concat('"', p_brand, '" ', chr(92), ' ', p_type) AS definition,
  concat('S:', p_size) AS parents, p_size > 45 AS obsolete FROM part)
SELECT 'nt' AS syntax, * FROM p UNION ALL SELECT 'turtle', * FROM p
"""


@oracle(PART_CLASSES)
def ontology_syntaxes(spark, d):
    """Parts as an ontology, written as N-Triples (in any order) and as Turtle, and read back as classes."""
    iri = lambda kind, column: F.concat(F.lit(f"<{rdf.NAMESPACES['obo']}{kind}_"), F.col(column).cast("string"), F.lit(">"))
    quoted = lambda text: F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\\\])', r"\\$1"), F.lit('"'))
    at = lambda name: F.lit(f"<{rdf.address(name)}>")
    said = F.concat(
        F.array(F.struct(at("rdf:type").alias("p"), at("owl:Class").alias("o")), F.struct(at("rdfs:label").alias("p"), quoted(F.col("p_name")).alias("o")), F.struct(at("rdfs:subClassOf").alias("p"), iri("S", "p_size").alias("o")),
                F.struct(at("obo:IAO_0000115").alias("p"), quoted(F.concat(F.lit('"'), "p_brand", F.lit('" \\ '), "p_type")).alias("o")), F.struct(at("owl:deprecated").alias("p"), F.when(F.col("p_size") > 45, '"true"').otherwise('"false"').alias("o"))),
        F.transform(F.split("p_type", " "), lambda w: F.struct(at("oboInOwl:hasExactSynonym").alias("p"), quoted(w).alias("o"))),
    )
    parts = base.table(spark, d, "part").select(iri("P", "p_partkey").alias("s"), said.alias("said"))
    folder = store.Work(spark, "ontology").root
    lines = parts.select("s", F.explode("said").alias("t")).select(F.concat_ws(" ", "s", "t.p", "t.o", F.lit(".")).alias("value"))
    lines.repartition(8, F.xxhash64("value")).write.text(f"{folder}/nt")
    parts.select(F.concat("s", F.lit("\n  "), F.array_join(F.transform("said", lambda t: F.concat_ws(" ", t.p, t.o)), " ;\n  "), F.lit(" .\n")).alias("value")).write.text(f"{folder}/turtle")
    read = [rdf.rdf_records(spark, f"{folder}/{x}", x, include_obsolete=True).select(F.lit(x).alias("syntax"), "id", "label", F.array_join("synonyms", "|").alias("synonyms"), "definition", F.array_join("parents", "|").alias("parents"), "obsolete") for x in rdf.READERS]
    return read[0].unionByName(read[1])


@oracle("""
WITH e AS (SELECT event_id AS seq, event_type AS t, concat(event_type, ' ', user_id % 40) AS req FROM events),
m1 AS (SELECT req, min(seq) AS f, row_number() OVER (ORDER BY min(seq), req) AS r FROM e WHERE t IN ('view', 'click') GROUP BY req), c1 AS (SELECT * FROM m1 WHERE r <= 120),
m2 AS (SELECT req, min(seq) AS f, row_number() OVER (ORDER BY min(seq), req) AS r FROM e WHERE req NOT IN (SELECT req FROM c1) GROUP BY req), c2 AS (SELECT * FROM m2 WHERE r <= 120 - (SELECT count(*) FROM c1)),
a AS (SELECT 1 AS pass, CASE WHEN c.req IS NULL THEN 'refused' WHEN seq = f THEN 'call' ELSE 'shared' END AS answer, c.req FROM e LEFT JOIN c1 c ON c.req = e.req WHERE t IN ('view', 'click')
  UNION ALL SELECT 2, CASE WHEN k.req IS NOT NULL THEN 'cached' WHEN c.req IS NULL THEN 'refused' WHEN seq = c.f THEN 'call' ELSE 'shared' END, coalesce(k.req, c.req) FROM e LEFT JOIN c1 k ON k.req = e.req LEFT JOIN c2 c ON c.req = e.req)
SELECT pass, answer, count(*) AS n, count(DISTINCT req) AS requests, coalesce(sum(length(req) + 3), 0)::BIGINT AS characters FROM a GROUP BY ALL
""")
def stored_responses(spark, d):
    """Two passes of requests over one stored cache and one budget of 120 calls: what was asked, shared, kept and refused."""
    rows = base.select(spark, d, "SELECT event_id AS seq, event_type, concat(event_type, ' ', user_id % 40) AS user FROM {events}").withColumn("request_key", responses.request_key("upper case", "user"))
    folder = store.Work(spark, "responses").root
    cache, budget = responses.ResponseCache(spark, f"{folder}/cache"), responses.CallBudget(spark, f"{folder}/budget", 120)
    model = lambda asked: asked.select("request_key", F.concat(F.lit("re "), F.upper("user")).alias("response"))
    first = cache.answered(rows.where("event_type in ('view', 'click')"), model, budget, "first").withColumn("pass", F.lit(1))
    both = first.unionByName(cache.answered(rows, model, budget, "second").withColumn("pass", F.lit(2)))
    return both.groupBy("pass", "answer").agg(F.count("*").alias("n"), F.count_distinct("response").alias("requests"), F.coalesce(F.sum(F.length("response")), F.lit(0)).cast("long").alias("characters"))
