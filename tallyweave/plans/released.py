"""Queries over replays, what a run gives out as files, and files that are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import store
from ..functions import text as tx
from ..operators import evaluate, matcher, reports
from ..sources import exports, files
from . import base, catalog
from .oracles import DOCS, GOLD, ITEMS, RANK, RESULTS, bm25
from .registry import ORACLES
from .workflows import oracle

OUTCOME = """CASE WHEN NOT labelled THEN 'unlabelled' WHEN status = 'matched' THEN CASE WHEN correct THEN 'accepted_correct' ELSE 'accepted_wrong' END
  WHEN status = 'unmatched' THEN CASE WHEN no_match THEN 'correct_no_match' ELSE 'incorrect_no_match' END WHEN status = 'needs_review' THEN 'review' ELSE 'failed' END"""


@oracle(f"""WITH thresholds AS (SELECT 0.6 AS accept_at, 0.4 AS review_floor UNION ALL SELECT 0.8, 0.5), {GOLD}, {RESULTS}, o AS (SELECT source_id, accept_at, status, {OUTCOME} AS outcome FROM judged)
SELECT 'status' AS matrix, a.status AS before, b.status AS after, count(*) AS n FROM o a JOIN o b USING (source_id) WHERE a.accept_at = 0.6 AND b.accept_at = 0.8 GROUP BY ALL
UNION ALL SELECT 'gold', a.outcome, b.outcome, count(*) FROM o a JOIN o b USING (source_id) WHERE a.accept_at = 0.6 AND b.accept_at = 0.8 GROUP BY ALL""")
def replay_matrices(spark, d):
    """What stricter floors would have made of the recorded attempts, by status and against gold."""
    recorded = matcher.Policy(accept_at=0.6, review_floor=0.4)
    return evaluate.replay(catalog.attempts(spark, d), base.gold_sets(spark, d), recorded, matcher.Policy(accept_at=0.8, review_floor=0.5))


@oracle(f"SELECT accept_at, choose_at, accepted, precision FROM ({ORACLES['fit_grid']}) f WHERE precision >= 0.295 ORDER BY accepted DESC, accept_at DESC, choose_at DESC LIMIT 1")
def recommended_floors(spark, d):
    """The pair of floors that accepts most at the wanted precision."""
    return evaluate.recommended(catalog.fit_grid(spark, d).withColumn("good", F.col("precision") >= 0.295))


@oracle(f"""WITH log AS ({base.plain(base.LOG)}), snapshot AS ({base.plain(base.SNAPSHOT)}),
now AS (SELECT s.source_id, coalesce(l.status, 'pending') AS status, l.matched_id FROM snapshot s LEFT JOIN (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) = 1) l USING (source_id)),
twice AS (SELECT matched_id, string_agg(source_id::VARCHAR, '|' ORDER BY source_id) AS sources FROM now WHERE status = 'matched' GROUP BY matched_id HAVING count(*) > 1)
SELECT 'counts' AS section, status AS name, count(*)::VARCHAR AS value FROM now GROUP BY status
UNION ALL SELECT 'duplicate_targets', matched_id::VARCHAR, sources FROM twice
UNION ALL SELECT 'duplicate_target_count', '', count(*)::VARCHAR FROM twice
UNION ALL SELECT 'removed_sources', '', count(DISTINCT source_id)::VARCHAR FROM log WHERE source_id NOT IN (SELECT source_id FROM snapshot)
UNION ALL SELECT 'history', 'results', count(*)::VARCHAR FROM log
UNION ALL SELECT 'snapshot', 'size', count(*)::VARCHAR FROM snapshot
UNION ALL SELECT 'run_state', '', CASE WHEN count_if(status = 'failed') > 0 THEN 'failed' WHEN count_if(status = 'pending') > 0 THEN 'partial' ELSE 'complete' END FROM now""")
def run_manifest(spark, d):
    """The manifest of a run, a row for each of its entries."""
    made = exports.manifest(catalog.snapshot(spark, d), catalog.log(spark, d))
    rows = [(k, n, str(v)) for k in ("counts", "duplicate_targets", "history") for n, v in made[k].items()]
    rows += [(k, "", str(made[k])) for k in ("duplicate_target_count", "removed_sources", "run_state")] + [("snapshot", "size", str(made["snapshot"]["size"]))]
    return spark.createDataFrame(rows, "section string, name string, value string")


@oracle("""
WITH m AS (SELECT p_partkey AS id, p_brand AS cluster, count(*) OVER (PARTITION BY p_brand) AS size, min(p_partkey) OVER (PARTITION BY p_brand) AS seed FROM part)
SELECT 'members' AS file, id::VARCHAR AS key, concat_ws(',', id, id, CASE WHEN size > 1 THEN 'assigned' ELSE 'singleton' END, cluster, size, '', '', '', '') AS line FROM m
UNION ALL SELECT 'clusters', cluster, concat_ws(',', cluster, 1, count(*), 'live', min(seed), 'minted', string_agg(id::VARCHAR, '|' ORDER BY id), '') FROM m GROUP BY cluster
UNION ALL SELECT 'decisions', id::VARCHAR, '{"decision_id":' || id || ',"cluster_id":"' || cluster || '","confidence":null}' FROM m WHERE size > 1
""")
def cluster_files(spark, d):
    """Parts of a brand as a cluster: its files as they are written, read back."""
    parts = base.table(spark, d, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("cluster_id"))
    clusters = parts.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("source_id").alias("seed_id"), F.array_join(F.array_sort(F.collect_list("source_id")), "|").alias("member_ids"))
    members = parts.join(clusters.select("cluster_id", F.col("size").alias("cluster_size")), "cluster_id").withColumn("order_index", F.col("source_id")).withColumn("outcome", F.when(F.col("cluster_size") > 1, "assigned").otherwise("singleton"))
    decisions = members.where("cluster_size > 1").select(F.col("source_id").alias("decision_id"), "cluster_id", F.lit(None).cast("double").alias("confidence"))
    folder = store.Work(spark, "cluster_files").root
    exports.write_clusters(members, clusters.withColumns({"revision": F.lit(1), "status": F.lit("live"), "mint_provenance": F.lit("minted"), "created_seq": F.col("seed_id")}), decisions, folder)

    def lines(name: str, key: str) -> DataFrame:
        rows = spark.read.csv(f"{folder}/{name}", header=True, quote='"', escape='"', inferSchema=False)
        return rows.select(F.lit(name).alias("file"), F.col(key).alias("key"), F.concat_ws(",", *(F.coalesce(F.col(c), F.lit("")) for c in rows.columns)).alias("line"))

    said = spark.read.text(f"{folder}/decisions").select(F.lit("decisions").alias("file"), F.get_json_object("value", "$.decision_id").alias("key"), F.col("value").alias("line"))
    return lines("members", "source_id").unionByName(lines("clusters", "cluster_id")).unionByName(said)


@oracle(f"""WITH g AS ({base.plain(base.GOLD_FLAT)}), l AS ({base.plain(base.LABELLED)}),
a AS (SELECT source_id, gold_id::VARCHAR AS id FROM g UNION SELECT source_id, 'a' || gold_id FROM g JOIN part ON p_partkey = gold_id AND p_size > 25),
s AS (SELECT l.source_id::VARCHAR AS source_id, coalesce(string_agg(id, '|' ORDER BY id), '') AS gold_ids FROM l LEFT JOIN a USING (source_id) GROUP BY l.source_id)
SELECT 'csv' AS kind, * FROM s UNION ALL SELECT 'jsonl', * FROM s""")
def gold_files(spark, d):
    """Gold sets written as CSV and as JSON lines, read back with the aliases of their ids."""
    gold = base.gold_sets(spark, d).select(F.col("source_id").cast("string").alias("source_id"), F.transform("gold_ids", lambda x: x.cast("string")).alias("gold_ids"))
    folder = store.Work(spark, "gold_files").root
    exports.write_csv(gold.withColumn("gold_ids", exports.multivalue_cell(F.col("gold_ids"))), f"{folder}/gold.csv")
    exports.write_json_lines(gold, f"{folder}/gold.jsonl")
    aliases = base.table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("alias"))
    read = [files.gold_file(spark, f"{folder}/gold.{kind}", aliases=aliases).select(F.lit(kind).alias("kind"), "source_id", F.array_join(F.array_sort("gold_ids"), "|").alias("gold_ids")) for kind in ("csv", "jsonl")]
    return read[0].unionByName(read[1])


@oracle("""
WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT *, pow(2.0, greatest(floor(log2(greatest(abs(x), pow(2.0, -24)))) - 10, -24)) AS step FROM v)
SELECT vec_id AS id, sum(i * (sign(x) * round_even(abs(x) / step, 0) * step * 16777216)::BIGINT)::BIGINT AS digest FROM s GROUP BY vec_id""")
def half_vectors(spark, d):
    """Embeddings in half precision, as an exact digest: parts in units of the smallest half, by their places."""
    units = F.transform(tx.half(F.col("vector")), lambda x, i: (i + 1) * (x * 16777216).cast("long"))
    return catalog.vectors(spark, d).select("id", F.aggregate(units, F.lit(0).cast("long"), lambda a, b: a + b).alias("digest"))


@oracle(f"""WITH {bm25(ITEMS, DOCS, 'a')}, r AS (SELECT query_id, id, {RANK} AS rank FROM a QUALIFY {RANK} <= 20),
c AS (SELECT query_id, rank, length(text) AS size FROM r JOIN documents ON doc_id = id), p AS (SELECT unnest([8, 4, 2, 1]) AS per),
t AS (SELECT query_id, per, (rank - 1) // per AS chunk, sum(size) AS total FROM c, p GROUP BY ALL),
w AS (SELECT query_id, max(per) AS per FROM (SELECT query_id, per, max(total) AS worst FROM t GROUP BY ALL) WHERE per = 1 OR worst <= 4000 GROUP BY query_id)
SELECT query_id, rank, ((rank - 1) // per)::INTEGER AS chunk FROM c JOIN w USING (query_id)""")
def screen_chunks(spark, d):
    """The candidates of each benchmark text in chunks of eight at most that hold 4,000 characters at most, if one alone doesn't pass that."""
    hits = store.Work(spark, "chunks").save(catalog.candidates(spark, d, 20).select("query_id", "id", "rank"), "hits")  # read twice: to be counted, and to be joined
    ranked = base.documents(spark, d).join(store.few(hits), "id")
    return reports.chunked(ranked, F.length("text"), 8, 4000).select("query_id", "rank", "chunk")
