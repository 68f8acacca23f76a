"""DuckDB SQL that checks the queries, written apart from the operators."""

from __future__ import annotations

from .base import ANSWERS, ATTEMPTS, GOLD_FLAT, KEYED, LABELLED, LOG, PARENTS, PROPOSALS, REVIEWS, SELECTIONS, SIGNALS, SNAPSHOT, WORKSHEET, plain

FAILURES = "('provider_failure', 'retriever_failure', 'fatal_provider_failure', 'unresolved_output', 'candidate_budget_exceeded')"


def words(text: str) -> str:
    """Case-folded words of any script."""
    return rf"regexp_extract_all(replace(replace(replace(lower(coalesce({text}, '')), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's'), '[\p{{L}}\p{{N}}_]+')"


def bm25(queries: str, docs: str, name: str = "bm25") -> str:
    """CTEs up to ``{name}(query_id, id, score)``."""
    n = name
    return f"""
{n}_t AS (SELECT id, len(w) AS size, unnest(w) AS term FROM (SELECT id, {words('text')} AS w FROM ({docs}))),
{n}_s AS (SELECT count(*) AS n, avg(len({words('text')})) AS m FROM ({docs})),
{n}_p AS (SELECT id, size, term, count(*) AS tf FROM {n}_t GROUP BY ALL),
{n}_d AS (SELECT term, count(*) AS df FROM {n}_p GROUP BY term),
{n}_q AS (SELECT DISTINCT query_id, unnest({words('text')}) AS term FROM ({queries})),
{n} AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m))) AS score
  FROM {n}_q JOIN {n}_p USING (term) JOIN {n}_d USING (term), {n}_s GROUP BY query_id, id)"""


DOCS, ITEMS = "SELECT doc_id AS id, text FROM documents", "SELECT item_id AS query_id, text FROM benchmark"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)"
OVERLAP = """ow AS (SELECT DISTINCT query_id, term FROM a_q), oq AS (SELECT query_id, count(*) AS nq FROM ow GROUP BY ALL), od AS (SELECT id, count(*) AS nd FROM a_p GROUP BY ALL),
b AS (SELECT query_id, id, n / (nq + nd - n) AS score FROM (SELECT query_id, id, count(*) AS n FROM ow JOIN a_p USING (term) GROUP BY ALL) JOIN oq USING (query_id) JOIN od USING (id))"""
TOP20 = f"""WITH {bm25(ITEMS, DOCS, 'a')}, {OVERLAP},
hits AS (
  SELECT 'bm25' AS retriever, query_id, id, score, {RANK} AS rank FROM a QUALIFY {RANK} <= 20
  UNION ALL SELECT 'overlap', query_id, id, score, {RANK} FROM b QUALIFY {RANK} <= 20)"""
RESULTS = f"""attempts AS ({plain(ATTEMPTS)}),
flagged AS (SELECT *, attempt IS NOT NULL AS real,
  attempt IS NOT NULL AND reason IS NULL AND chosen_id IS NOT NULL AND score BETWEEN 0 AND 1 AND score >= accept_at AND resolution = 'exact_key' AND (verifier IS NULL OR verifier = 'support') AS ok,
  attempt IS NOT NULL AND chosen_id IS NOT NULL AND score BETWEEN 0 AND 1 AS scored, coalesce(reason IN {FAILURES}, false) AS bad,
  attempt IS NOT NULL AND (coalesce(reason IN ('provider_failure', 'retriever_failure'), false) OR retrieval_failures > 0) AS blocking
  FROM attempts, thresholds),
summed AS (SELECT source_id, accept_at, review_floor, count(attempt) AS n, count(*) FILTER (WHERE real AND reason IS NULL) AS n_clear,
  coalesce(bool_or(reason = 'fatal_provider_failure'), false) AS fatal, coalesce(bool_or(ok), false) AS won,
  first(chosen_id ORDER BY score DESC, attempt) FILTER (WHERE ok) AS win_id, first(score ORDER BY score DESC, attempt) FILTER (WHERE ok) AS win_score,
  last(reason ORDER BY attempt) FILTER (WHERE real) AS last_reason, coalesce(bool_or(reason = 'candidate_budget_exceeded'), false) AS over,
  coalesce(bool_or(scored), false) AS any_scored,
  first(chosen_id ORDER BY score DESC, bad, attempt) FILTER (WHERE scored) AS best_id, first(score ORDER BY score DESC, bad, attempt) FILTER (WHERE scored) AS best_score,
  first(coalesce(verifier, '') ORDER BY score DESC, bad, attempt) FILTER (WHERE scored) AS best_verifier, first(resolution ORDER BY score DESC, bad, attempt) FILTER (WHERE scored) AS best_resolution,
  coalesce(bool_or(resolution = 'unresolved'), false) AS unresolved, coalesce(bool_or(candidate_count > 0), false) AS any_candidates, coalesce(bool_or(blocking), false) AS blocked,
  last(CASE WHEN reason IN ('provider_failure', 'retriever_failure') THEN reason ELSE 'retriever_failure' END ORDER BY attempt) FILTER (WHERE blocking) AS block_reason
  FROM flagged GROUP BY ALL),
reduced AS (SELECT *, CASE
    WHEN n = 0 THEN 'failed:provider_failure' WHEN fatal THEN 'failed:fatal_provider_failure' WHEN won THEN 'matched:accept_threshold'
    WHEN n_clear = 0 THEN 'failed:' || last_reason WHEN over THEN 'needs_review:candidate_budget_exceeded'
    WHEN any_scored THEN CASE WHEN best_verifier IN ('disagree', 'no_match') THEN 'needs_review:verifier_disagreement' WHEN best_verifier NOT IN ('', 'support') THEN 'needs_review:provider_failure'
      WHEN best_resolution <> 'exact_key' THEN 'needs_review:unresolved_output' WHEN best_score >= accept_at THEN 'needs_review:provider_failure'
      WHEN best_score >= review_floor THEN 'needs_review:below_accept_threshold' WHEN blocked THEN 'failed:' || block_reason ELSE 'unmatched:below_review_floor' END
    WHEN unresolved THEN 'needs_review:unresolved_output' WHEN blocked THEN 'failed:' || block_reason
    WHEN any_candidates THEN 'unmatched:selector_abstained' ELSE 'unmatched:no_candidates' END AS verdict FROM summed),
results AS (SELECT source_id, accept_at, string_split(verdict, ':')[1] AS status, string_split(verdict, ':')[2] AS reason,
  CASE WHEN string_split(verdict, ':')[1] IN ('matched', 'needs_review') THEN CASE WHEN won THEN win_id ELSE best_id END END AS matched_id,
  CASE WHEN won THEN win_score ELSE best_score END AS confidence, n AS attempts FROM reduced),
judged AS (SELECT r.*, l.source_id IS NOT NULL AS labelled, l.source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.source_id = r.source_id) AS no_match,
  l.source_id IS NOT NULL AND EXISTS (SELECT 1 FROM gold g WHERE g.source_id = r.source_id AND g.gold_id = r.matched_id) AS correct
  FROM results r LEFT JOIN labelled l USING (source_id))"""
FIXED = "WITH thresholds AS (SELECT 0.6 AS accept_at, 0.4 AS review_floor)"
GOLD = f"gold AS ({plain(GOLD_FLAT)}), labelled AS ({plain(LABELLED)})"
ALL = f"{FIXED}, {GOLD}, {RESULTS}"
METRICS = """count(*) AS total, count_if(labelled) AS n_labelled, count_if(status = 'matched') AS n_matched, count_if(status = 'needs_review') AS n_review,
  count_if(status = 'unmatched') AS n_unmatched, count_if(status = 'failed') AS n_failed,
  round(count_if(labelled AND status = 'matched' AND correct) / nullif(count_if(labelled AND status = 'matched'), 0), 4) AS accepted_precision,
  round(count_if(labelled AND status = 'matched') / nullif(count_if(labelled), 0), 4) AS coverage,
  round(count_if(labelled AND status = 'matched' AND correct) / nullif(count_if(labelled) - count_if(no_match), 0), 4) AS recall,
  round(count_if(labelled AND status = 'unmatched' AND no_match) / nullif(count_if(labelled AND status = 'unmatched'), 0), 4) AS no_match_precision,
  round(count_if(labelled AND status = 'unmatched' AND no_match) / nullif(count_if(no_match), 0), 4) AS no_match_recall"""
LOGS = f"WITH log AS ({plain(LOG)}), snapshot AS ({plain(SNAPSHOT)}), reviews AS ({plain(REVIEWS)}), cur AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) = 1)"
NAME_KEY = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')"
DRAW = "(('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
PAIRS = """cells AS (SELECT cluster_id, gold_id, count(*) AS n FROM items GROUP BY ALL),
ca AS (SELECT cluster_id, count(*) AS a, count(DISTINCT gold_id) AS golds FROM items GROUP BY ALL), cb AS (SELECT gold_id, count(*) AS b, count(DISTINCT cluster_id) AS clusters FROM items GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS tp, (SELECT sum(a * (a - 1) / 2) FROM ca) AS pp, (SELECT sum(b * (b - 1) / 2) FROM cb) AS gp, (SELECT count(*) FROM items) AS items,
  (SELECT sum(n * n / a) FROM cells JOIN ca USING (cluster_id)) AS bp, (SELECT sum(n * n / b) FROM cells JOIN cb USING (gold_id)) AS br),
r AS (SELECT *, round(tp / nullif(pp, 0), 4) AS pair_precision, round(tp / nullif(gp, 0), 4) AS pair_recall, round(bp / items, 4) AS b3_precision, round(br / items, 4) AS b3_recall FROM s)
SELECT items, (SELECT count(*) FROM ca) AS n_clusters, (SELECT count(*) FROM cb) AS n_gold, (SELECT count_if(a = 1) FROM ca) AS singletons, (SELECT count_if(golds > 1) FROM ca) AS false_merges,
  (SELECT count_if(clusters > 1) FROM cb) AS splits, tp::BIGINT AS true_pairs, (pp - tp)::BIGINT AS false_pairs, (gp - tp)::BIGINT AS missed_pairs, pair_precision, pair_recall,
  round(2 * pair_precision * pair_recall / nullif(pair_precision + pair_recall, 0), 4) AS pair_f1, b3_precision, b3_recall, round(2 * b3_precision * b3_recall / nullif(b3_precision + b3_recall, 0), 4) AS b3_f1 FROM r"""
BY_HASH = "SELECT vec_id AS item_id, vec_id % 40 AS cluster_id, label AS gold_id FROM embeddings"
QUERY_VECTORS = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0"
DOT = "list_reduce(list_prepend(0.0, list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i])), lambda a, b: a + b)"
SUMMED = "sum({w} / (60 + rank))"
FORM = r"trim(regexp_replace(replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), 'ς', 'σ'), '\s+', ' ', 'g'))"
#: DuckDB counts edits in bytes: letters with accents become free letters of one byte.
ACCENTS = ("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%")
NEAR = f"""va AS (SELECT DISTINCT unnest({words('text')}) AS query_term FROM benchmark), vb AS (SELECT DISTINCT unnest({words('text')}) AS term FROM documents),
ca AS (SELECT query_term, translate(query_term, '{ACCENTS[0]}', '{ACCENTS[1]}') AS c FROM va WHERE length(query_term) >= 5), cb AS (SELECT term, translate(term, '{ACCENTS[0]}', '{ACCENTS[1]}') AS d FROM vb WHERE length(term) >= 3),
near AS (SELECT query_term, term, damerau_levenshtein(c, d) AS edits FROM ca JOIN cb ON abs(length(c) - length(d)) <= 2 AND c <> d WHERE damerau_levenshtein(c, d) <= 2)"""
SELECTED = rf"""WITH a AS ({plain(SELECTIONS)}), k AS (SELECT event_id, trim(trim(trim(coalesce(answer, '')), ' .,:;''"`()[]' || chr(9) || chr(10) || chr(13))) AS bare, upper(bare) AS key, lower(bare) IN ('', 'null', 'none', 'nil', 'no_match', 'nomatch', 'no match', 'n/a', 'na') AS none FROM a)"""
CAND = f"""WITH {bm25(ITEMS, DOCS, 'a')}, ranked AS (SELECT query_id, id, score, {RANK} AS rank FROM a QUALIFY {RANK} <= 12), sized AS (SELECT r.*, length(d.text) AS size FROM ranked r JOIN documents d ON d.doc_id = r.id)"""

ORACLES: dict[str, str] = {
    "bm25_topk": f"WITH {bm25(ITEMS, DOCS)} SELECT query_id, id, round(score, 6) AS score, {RANK} AS rank FROM bm25 QUALIFY {RANK} <= 10",
    "bm25_postings_stats": f"WITH {bm25(ITEMS, DOCS)} SELECT n AS n_docs, round(m, 6) AS mean_size, (SELECT count(*) FROM bm25_d) AS n_terms, (SELECT count(*) FROM bm25_p) AS n_postings FROM bm25_s",
    "exact_lookup": f"""WITH names AS (SELECT p_partkey AS id, {NAME_KEY.format('p_name')} AS key FROM part), m AS (SELECT s_suppkey AS source_id, {NAME_KEY.format("coalesce(p_name, 'none') || CASE WHEN s_suppkey % 3 = 0 THEN ' x' ELSE '!' END")} AS key FROM supplier LEFT JOIN part ON p_partkey = s_suppkey * 3)
SELECT source_id, count(DISTINCT id) AS n_hits, CASE WHEN count(DISTINCT id) = 1 THEN 'matched' WHEN count(DISTINCT id) > 1 THEN 'needs_review' ELSE 'unmatched' END AS status, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS matched_id FROM m LEFT JOIN names USING (key) GROUP BY source_id""",
    "exact_boosted_search": f"""WITH {bm25(ITEMS, DOCS)}, same AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON {FORM.format('d.text')} = {FORM.format('b.text')}),
f AS (SELECT coalesce(b.query_id, s.query_id) AS query_id, coalesce(b.id, s.id) AS id, coalesce(score, 0) AS score, CASE WHEN s.id IS NULL THEN 0 ELSE 1 END AS is_exact FROM bm25 b FULL JOIN same s ON b.query_id = s.query_id AND b.id = s.id)
SELECT query_id, id, round(score, 6) AS score, is_exact, row_number() OVER (PARTITION BY query_id ORDER BY is_exact DESC, round(score, 9) DESC, id) AS rank FROM f QUALIFY rank <= 10""",
    "exact_weight_search": f"""WITH {bm25("SELECT s_suppkey AS query_id, upper(p_name) AS text FROM supplier JOIN part ON p_partkey = s_suppkey", "SELECT p_partkey AS id, p_name || ' ' || p_type AS text FROM part")},
same AS (SELECT s.s_suppkey AS query_id, p.p_partkey AS id FROM supplier s JOIN part x ON x.p_partkey = s.s_suppkey JOIN part p ON {FORM.format('x.p_name')} IN ({FORM.format('p.p_name')}, {FORM.format('p.p_type')})),
w AS (SELECT query_id, 10 * ln(1 + ((SELECT count(*) FROM part) - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM same GROUP BY ALL),
f AS (SELECT coalesce(b.query_id, s.query_id) AS query_id, coalesce(b.id, s.id) AS id, coalesce(score, 0) + coalesce(CASE WHEN s.id IS NOT NULL THEN w END, 0) AS score FROM bm25 b FULL JOIN same s ON b.query_id = s.query_id AND b.id = s.id LEFT JOIN w ON w.query_id = s.query_id)
SELECT query_id, id, round(score, 6) AS score, {RANK} AS rank FROM f QUALIFY {RANK} <= 10""",
    "fuzzy_vocabulary_expand": f"""WITH {NEAR} SELECT query_term, term, edits, 0.5::DOUBLE AS weight FROM near""",
    "fuzzy_search": f"""WITH {bm25(ITEMS, DOCS, 'a')}, {NEAR},
x AS (SELECT DISTINCT q.query_id, q.term AS query_term, p.id FROM a_q q JOIN (SELECT query_term, term FROM near UNION SELECT DISTINCT term, term FROM a_q) n ON n.query_term = q.term JOIN a_p p ON p.term = n.term WHERE length(q.term) >= 5),
e AS (SELECT query_id, id, 0.5 * count(*) AS extra FROM x GROUP BY ALL),
f AS (SELECT query_id, id, coalesce(score, 0) + coalesce(extra, 0) AS score FROM a FULL JOIN e USING (query_id, id))
SELECT query_id, id, round(score, 6) AS score, {RANK} AS rank FROM f QUALIFY {RANK} <= 10""",
    "index_upkeep": f"""WITH s AS (SELECT source, row_number() OVER (ORDER BY source) AS n, count(*) OVER () AS m FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
{bm25(ITEMS, "SELECT doc_id AS id, CASE WHEN source IN (SELECT source FROM s WHERE n = 1 AND m > 1) THEN upper(text) ELSE text END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")}
SELECT query_id, id, round(score, 6) AS score, {RANK} AS rank FROM bm25 QUALIFY {RANK} <= 10""",
    "dense_topk": f"""WITH q AS ({QUERY_VECTORS}), s AS (SELECT query_id, vec_id AS id, {DOT.format('q', 'embedding')} AS score FROM q, embeddings) SELECT query_id, id, round(score, 6) + 0.0 AS score, {RANK} AS rank FROM s QUALIFY {RANK} <= 10""",
    "dense_best_per_record": f"""WITH q AS ({QUERY_VECTORS}), s AS (SELECT query_id, vec_id // 4 AS record, vec_id, {DOT.format('q', 'embedding')} AS score FROM q, embeddings),
b AS (SELECT query_id, record AS id, arg_min(score, (-round(score, 9), vec_id)) AS score, arg_min(vec_id, (-round(score, 9), vec_id)) AS best_id FROM s GROUP BY ALL) SELECT query_id, id, round(score, 6) + 0.0 AS score, best_id, {RANK} AS rank FROM b QUALIFY {RANK} <= 10""",
    "matryoshka_topk": f"""WITH e AS (SELECT vec_id, label, list_slice(embedding::DOUBLE[], 1, 16) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt({DOT.format('v', 'v')})) AS v FROM e),
q AS (SELECT vec_id AS query_id, v AS q FROM u WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS id, {DOT.format('q', 'v')} AS score FROM q, u) SELECT query_id, id, round(score, 6) + 0.0 AS score, {RANK} AS rank FROM s QUALIFY {RANK} <= 10""",
    "rrf_multi_query": f"""{TOP20}, f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, string_agg(retriever || ':' || rank, '|' ORDER BY retriever || ':' || rank) AS evidence FROM hits GROUP BY ALL) SELECT query_id, id, round(score, 9) AS score, evidence, {RANK} AS rank FROM f QUALIFY {RANK} <= 10""",
    "rrf_weighted": f"""{TOP20}, f AS (SELECT query_id, id, sum(CASE retriever WHEN 'bm25' THEN 2.0 ELSE 1.0 END / (60 + rank)) AS score FROM hits GROUP BY ALL) SELECT query_id, id, round(score, 9) AS score, {RANK} AS rank FROM f QUALIFY {RANK} <= 10""",
    "combsum": f"""{TOP20}, x AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM hits WINDOW w AS (PARTITION BY query_id, retriever)),
f AS (SELECT query_id, id, sum(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END) AS score FROM x GROUP BY ALL) SELECT query_id, id, round(score, 6) AS score, {RANK} AS rank FROM f QUALIFY {RANK} <= 10""",
    "rrf_excluding": f"""{TOP20}, f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM hits GROUP BY ALL), k AS (SELECT * FROM f WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) SELECT query_id, id, round(score, 9) AS score, {RANK} AS rank FROM k QUALIFY {RANK} <= 5""",
    "candidate_keys": f"""{CAND} SELECT query_id, id, rank, 'C' || lpad(rank::VARCHAR, greatest(2, length((count(*) OVER (PARTITION BY query_id))::VARCHAR))::INT, '0') AS key FROM sized""",
    "budget_prefix": f"""{CAND}, u AS (SELECT *, sum(size + CASE WHEN rank > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM sized) SELECT query_id, id, rank, used::BIGINT AS used, used <= 8000 AND rank <= 10 AS kept FROM u""",
    "shortlist": f"""WITH {bm25(ITEMS, DOCS, 'a')}, w AS (SELECT query_id, id, score, {RANK} AS rank FROM a) SELECT query_id, id, round(score, 6) AS score, rank FROM w WHERE rank <= 15 AND score >= 20""",
    "resolve_keys": f"""{SELECTED} SELECT event_id, CASE WHEN NOT none AND key IN ('C01', 'C02', 'C03', 'C04') THEN 'id' || substr(key, 3, 1) END AS id,
  CASE WHEN none THEN 'abstain' WHEN key IN ('C01', 'C02', 'C03', 'C04') THEN 'exact_key' ELSE 'unresolved' END AS resolution FROM k""",
    "resolve_keys_legacy": f"""{SELECTED}, r AS (SELECT event_id, CASE WHEN none THEN 'abstain:' WHEN key IN ('C01', 'C02', 'C03', 'C04') THEN 'exact_key:' || substr(key, 3, 1) WHEN regexp_matches(bare, '^go:[1-4]$') THEN 'legacy_fuzzy:' || substr(bare, 4, 1)
  WHEN regexp_matches(bare, '^[1-4]$') THEN 'legacy_fuzzy:' || bare ELSE 'unresolved:' END AS r FROM k) SELECT event_id, CASE WHEN string_split(r, ':')[2] <> '' THEN 'Go:' || string_split(r, ':')[2] END AS id, string_split(r, ':')[1] AS resolution FROM r""",
    "overlap_choose": f"""{CAND}, t AS (SELECT s.query_id, s.id, s.rank, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS qa, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS da FROM sized s JOIN benchmark b ON b.item_id = s.query_id JOIN documents d ON d.doc_id = s.id),
o AS (SELECT query_id, id, rank, round(CASE WHEN len(qa) = 0 OR len(da) = 0 THEN 0.0 ELSE len(list_intersect(qa, da)) / len(list_distinct(list_concat(qa, da))) END, 4) AS overlap FROM t),
m AS (SELECT query_id, first(id ORDER BY overlap DESC, rank DESC) AS id, max(overlap) AS overlap, sum(overlap) AS total FROM o GROUP BY query_id)
SELECT query_id, CASE WHEN overlap > 0 THEN id END AS id, round(overlap, 6) AS overlap, CASE WHEN overlap > 0 THEN round(overlap / total, 6) ELSE 0.0 END AS p_choice, CASE WHEN overlap > 0 THEN 0.0 ELSE 1.0 END AS p_none FROM m""",
    "normalise_query": r"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents""",
    "tidy_text": r"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS digest FROM documents""",
    "sanitise_query": r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(url || ' AND ' || url, '[`+\-!(){}\[\]^"~*?:\\/]', ' ', 'g'), '\b(AND|OR|NOT|IN)\b', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""",
    "multivalue_split": "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type || ' ||' || p_name, ' '), lambda x: trim(x)), lambda x: x <> ''), ',') AS parts FROM part",
    "curie_urls": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'GO:' || page_id WHEN page_id % 3 = 1 THEN 'frag' || page_id ELSE url END AS curie FROM (SELECT page_id, replace(url, '#', '') AS url FROM pages)""",
    "redact_urls": """SELECT page_id, 'https://host:80/' || page_id || '?a=1' || CASE WHEN page_id % 3 = 1 THEN '&max_tokens=' || page_id ELSE '' END || '&monkey=2' AS url FROM pages""",
    "partition_split": f"""WITH d AS (SELECT c_custkey AS source_id, {DRAW.format("'salt' || chr(0) || c_custkey")} AS draw FROM customer) SELECT source_id, round(draw, 9) AS draw, CASE WHEN draw < 0.5 THEN 'prompt_train' WHEN draw < 0.75 THEN 'validation' ELSE 'test' END AS part FROM d""",
    "holdout_deal": f"""WITH d AS (SELECT c_custkey AS source_id, {DRAW.format("'fit' || chr(0) || c_custkey")} AS draw FROM customer) SELECT source_id, CASE WHEN row_number() OVER (ORDER BY draw, source_id) % 2 = 1 THEN 'fit' ELSE 'holdout' END AS part FROM d""",
    "audit_sample": f"""WITH {GOLD}, attempts AS ({plain(ATTEMPTS)}) SELECT source_id, attempt, coalesce(score BETWEEN 0.6 AND 0.8, false) AS verify, coalesce(score > 0.8 AND {DRAW.format("'run' || chr(0) || source_id")} < 0.1, false) AS audit FROM attempts""",
    "record_digest": """SELECT p_partkey, substr(sha256('id=' || p_partkey || chr(31) || 'brand=' || p_brand || chr(31) || 'name=' || p_name), 1, 16) AS digest FROM part""",
    "changed_records": """SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN 'insert' WHEN p_size < 5 THEN 'prune' WHEN p_partkey % 3 = 0 THEN 'update' ELSE 'keep' END AS action FROM part""",
    "derive_status": f"{ALL} SELECT source_id, status, reason, matched_id, confidence, attempts FROM results",
    "decider_status": f"""WITH s AS ({plain(SIGNALS)}), v AS (SELECT *, CASE WHEN failed THEN 'failed:retriever_failure' WHEN screen_best IS NULL THEN 'unmatched:no_candidates' WHEN screen_best < 0.3 THEN 'unmatched:below_review_floor'
  WHEN abstained AND p_none >= 0.7 THEN 'unmatched:selector_abstained' WHEN abstained OR NOT exact_key OR screen_chosen IS NULL THEN 'needs_review:unresolved_output'
  WHEN screen_chosen >= 0.85 AND p_choice >= 0.5 AND rubric BETWEEN 2 AND 3 AND least_property >= 0.5 THEN 'matched:accept_threshold' ELSE 'needs_review:below_accept_threshold' END AS v FROM s),
w AS (SELECT *, CASE WHEN v LIKE 'unmatched%' AND degraded THEN 'failed:retriever_failure' ELSE v END AS w FROM v) SELECT string_split(w, ':')[1] AS status, string_split(w, ':')[2] AS reason, count(*) AS n, sum(order_id)::BIGINT AS orders FROM w GROUP BY ALL""",
    "ledger_current": f"{LOGS} SELECT source_id, coalesce(status, 'pending') AS status, seq, matched_id FROM snapshot LEFT JOIN cur USING (source_id)",
    "ledger_history": f"{LOGS} SELECT source_id, seq, status, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS revision, seq = max(seq) OVER (PARTITION BY source_id) AS current FROM log",
    "removed_sources": f"{LOGS} SELECT DISTINCT source_id FROM log WHERE source_id NOT IN (SELECT source_id FROM snapshot)",
    "resume_todo": f"{LOGS} SELECT source_id FROM snapshot WHERE source_id NOT IN (SELECT source_id FROM cur WHERE status <> 'failed')",
    "snapshot_dedupe": "WITH s AS (SELECT user_id AS run, event_id AS seq, event_type AS digest, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT run, seq, digest FROM s WHERE b IS DISTINCT FROM digest",
    "failing_streaks": f"{LOGS}, i AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq) - row_number() OVER (PARTITION BY source_id, status ORDER BY seq) AS g FROM log) SELECT source_id, count(*) AS length, min(seq) AS first_seq FROM i WHERE status = 'failed' GROUP BY source_id, g HAVING count(*) >= 3",
    "status_counts": f"{LOGS} SELECT status, count(*) AS n FROM cur GROUP BY ALL",
    "duplicate_targets": f"{LOGS} SELECT matched_id, count(*) AS n, string_agg(source_id::VARCHAR, '|' ORDER BY source_id) AS sources FROM cur WHERE status = 'matched' GROUP BY ALL HAVING count(*) > 1",
    "failure_groups": f"{ALL}, c AS (SELECT reason, count(*) AS n FROM results GROUP BY ALL), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, reason) AS place FROM c) SELECT CASE WHEN place <= 5 THEN reason ELSE 'other' END AS reason, sum(n)::BIGINT AS n FROM p GROUP BY 1",
    "results_page": f"{ALL} SELECT source_id, status, (SELECT count(*) FROM results) AS total, CASE WHEN (SELECT count(*) FROM results) > 150 THEN 150 END::BIGINT AS next_offset FROM results ORDER BY source_id LIMIT 50 OFFSET 100",
    "review_history": f"{LOGS}, n AS (SELECT source_id, count(*) AS now FROM log GROUP BY ALL), f AS (SELECT r.*, result_revision = now AS fits FROM reviews r JOIN n USING (source_id)) SELECT review_id, source_id, CASE WHEN NOT fits THEN 'stale' WHEN review_id = max(CASE WHEN fits THEN review_id END) OVER (PARTITION BY source_id) THEN 'applied' ELSE 'superseded' END AS state FROM f",
    "adjudicated": f"{LOGS}, n AS (SELECT source_id, count(*) AS now FROM log GROUP BY ALL), f AS (SELECT r.* FROM reviews r JOIN n USING (source_id) WHERE result_revision = now QUALIFY row_number() OVER (PARTITION BY r.source_id ORDER BY review_id DESC) = 1) SELECT c.source_id, CASE decision WHEN 'replace' THEN corrected_id WHEN 'reject' THEN NULL WHEN 'no_match' THEN NULL ELSE matched_id END AS final_id, CASE WHEN decision IN ('accept', 'replace') THEN 'matched' WHEN decision IN ('reject', 'no_match') THEN 'unmatched' WHEN decision = 'defer' THEN 'needs_review' ELSE status END AS final_status, decision, matched_id AS model_id, status AS model_status FROM cur c LEFT JOIN f USING (source_id)",
    "eval_metrics": f"{ALL} SELECT {METRICS} FROM judged",
    "threshold_curve": f"WITH thresholds AS (SELECT round(i / 20.0, 4) AS accept_at, least(0.4, round(i / 20.0, 4)) AS review_floor FROM range(21) t(i)), {GOLD}, {RESULTS} SELECT accept_at AS threshold, {METRICS} FROM judged GROUP BY accept_at",
    "calibration": f"{ALL}, s AS (SELECT count_if(correct) AS n_right, count_if(NOT correct) AS n_wrong, round(avg(confidence) FILTER (WHERE correct), 6) AS mean_right, round(avg(confidence) FILTER (WHERE NOT correct), 6) AS mean_wrong FROM judged WHERE labelled AND confidence IS NOT NULL AND matched_id IS NOT NULL) SELECT *, coalesce(n_right >= 3 AND n_wrong >= 3 AND mean_right - mean_wrong < 0.1, false) AS warning FROM s",
    "ceiling_buckets": f"""{ALL}, k AS (SELECT source_id, bool_or(gold_id % 19 <> 0) AS known FROM gold GROUP BY ALL),
r AS (SELECT a.source_id, bool_or(g.gold_id IS NOT NULL AND candidate_count > 1) AS keyed, bool_or(g.gold_id IS NOT NULL) AS got FROM attempts a LEFT JOIN gold g ON g.source_id = a.source_id AND g.gold_id = a.chosen_id GROUP BY ALL),
d AS (SELECT source_id, coalesce(bool_or(reason = 'candidate_budget_exceeded'), false) AS cut, coalesce(bool_or(retrieval_failures > 0), false) AS degraded FROM attempts GROUP BY ALL)
SELECT CASE WHEN NOT labelled THEN 'unlabelled' WHEN no_match THEN 'no_gold' WHEN NOT coalesce(known, false) THEN 'gold_unreachable' WHEN correct THEN 'found' WHEN keyed THEN 'misjudged' WHEN got AND cut THEN 'truncated' WHEN degraded THEN 'unavailable' ELSE 'never_retrieved' END AS bucket, count(*) AS n
FROM judged LEFT JOIN k USING (source_id) LEFT JOIN r USING (source_id) LEFT JOIN d USING (source_id) GROUP BY ALL""",
    "replay_transitions": f"WITH thresholds AS (SELECT 0.6 AS accept_at, 0.4 AS review_floor UNION ALL SELECT 0.8, 0.5), {GOLD}, {RESULTS} SELECT a.status AS status_before, b.status AS status_after, count(*) AS n FROM results a JOIN results b USING (source_id) WHERE a.accept_at = 0.6 AND b.accept_at = 0.8 GROUP BY ALL",
    "fit_grid": f"{ALL}, p AS (SELECT *, (source_id % 10) / 10.0 AS p_choice FROM judged), g AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS accept_at2), h AS (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS choose_at), c AS (SELECT accept_at2 AS accept_at, choose_at, count_if(confidence >= accept_at2 AND p_choice >= choose_at AND labelled) AS accepted, count_if(confidence >= accept_at2 AND p_choice >= choose_at AND labelled AND correct) AS \"right\" FROM p, g, h GROUP BY ALL) SELECT *, round(\"right\" / nullif(accepted, 0), 4) AS precision, coalesce(round(\"right\" / nullif(accepted, 0), 4) >= 0.4, false) AS good FROM c",
    "retrieval_recall": f"WITH {bm25(ITEMS, DOCS, 'a')}, ranked AS (SELECT query_id, id, {RANK} AS rank FROM a QUALIFY {RANK} <= 50), gold AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), f AS (SELECT g.query_id, min(rank) AS first FROM gold g LEFT JOIN ranked USING (query_id, id) GROUP BY ALL) SELECT count(*) AS n, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN first <= 50 THEN 1.0 ELSE 0 END), 6) AS recall_50, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f",
    "partition_scores": f"WITH items AS ({BY_HASH}), {PAIRS}",
    "order_sensitivity": "WITH x AS (SELECT vec_id, vec_id % 40 AS one, vec_id % 60 AS two FROM embeddings), c AS (SELECT one, two, count(*) AS n FROM x GROUP BY ALL), a AS (SELECT one, count(*) AS a FROM x GROUP BY ALL), b AS (SELECT two, count(*) AS b FROM x GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS tp, (SELECT sum(a * (a - 1) / 2) FROM a) AS p, (SELECT sum(b * (b - 1) / 2) FROM b) AS q), r AS (SELECT round(tp / p, 4) AS p, round(tp / q, 4) AS r FROM s) SELECT round(2 * p * r / nullif(p + r, 0), 4) AS pair_f1, (SELECT coalesce(sum(n), 0)::BIGINT FROM c JOIN a USING (one) JOIN b USING (two) WHERE n <> a OR n <> b) AS unstable_items FROM r",
    "exact_mention_clusters": f"WITH k AS (SELECT p_partkey AS item_id, {NAME_KEY.format('p_name')} AS key FROM part) SELECT item_id, min(item_id) OVER (PARTITION BY key) AS cluster_id FROM k",
    "gold_clusters": f"WITH {GOLD} SELECT source_id, coalesce('g:' || string_agg(gold_id::VARCHAR, '|' ORDER BY gold_id), 's:' || source_id) AS cluster_id FROM labelled LEFT JOIN gold USING (source_id) GROUP BY source_id",
    "cluster_sizes": "SELECT p_partkey AS item_id, p_name AS cluster_id, count(*) OVER (PARTITION BY p_name) AS size, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN 'assigned' ELSE 'singleton' END AS outcome FROM part",
    "member_changes": "WITH r AS (SELECT user_id AS cluster_id, event_type AS revision, list_sort(list_distinct(list(event_id % 20))) AS m FROM events GROUP BY ALL), b AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY cluster_id ORDER BY revision), []) AS p FROM r) SELECT cluster_id, revision, array_to_string(list_sort(list_filter(m, lambda x: NOT list_contains(p, x))), '|') AS added, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(m, x))), '|') AS removed FROM b",
    "merge_ancestry": "WITH RECURSIVE m AS (SELECT n_nationkey AS child, n_nationkey // 2 AS parent FROM nation WHERE n_nationkey > 0), up AS (SELECT child, parent AS ancestor, 1 AS steps FROM m UNION ALL SELECT u.child, m.parent, u.steps + 1 FROM up u JOIN m ON m.child = u.ancestor) SELECT child, ancestor, steps FROM up",
    "usage_totals": "SELECT o_orderpriority AS kind, count(*) AS calls, sum(l_linenumber)::BIGINT AS prompt_tokens, sum(l_quantity)::BIGINT AS completion_tokens, count_if(l_returnflag = 'N') AS cache_hits FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "agreement": f"WITH thresholds AS (SELECT 0.6 AS accept_at, 0.4 AS review_floor UNION ALL SELECT 0.8, 0.5), {GOLD}, {RESULTS} SELECT CASE WHEN a.status = 'matched' AND b.status = 'matched' THEN CASE WHEN a.matched_id = b.matched_id THEN 'same' ELSE 'different' END WHEN a.status = 'matched' THEN 'only_first' WHEN b.status = 'matched' THEN 'only_second' ELSE 'neither' END AS verdict, count(*) AS n FROM results a JOIN results b USING (source_id) WHERE a.accept_at = 0.6 AND b.accept_at = 0.8 GROUP BY ALL",
    "compare_runs": f"WITH thresholds AS (SELECT 0.5::DOUBLE AS accept_at, 0.4 AS review_floor UNION ALL SELECT 0.7, 0.4 UNION ALL SELECT 0.9, 0.4), {GOLD}, {RESULTS}, c AS (SELECT accept_at AS run, {METRICS} FROM judged GROUP BY accept_at) SELECT run, accepted_precision, coverage, round(accepted_precision - first(accepted_precision ORDER BY run) OVER (), 4) AS delta, accepted_precision = max(accepted_precision) OVER () AS best FROM c",
    "retry_metrics": f"""{ALL}, f AS (SELECT source_id, (reason IS NULL AND chosen_id IS NOT NULL AND score >= 0.6 AND resolution = 'exact_key' AND (verifier IS NULL OR verifier = 'support')) AS ok, EXISTS (SELECT 1 FROM gold g WHERE g.source_id = a.source_id AND g.gold_id = a.chosen_id) AS hit FROM attempts a WHERE attempt = 0)
SELECT count(*) AS n, count_if(j.status = 'matched' AND j.correct AND NOT (f.ok AND f.hit)) AS recovered, count_if(f.ok AND f.hit AND NOT (j.status = 'matched' AND j.correct)) AS broken FROM judged j JOIN f USING (source_id) WHERE labelled""",
    "decision_diagnostics": f"{ALL} SELECT count_if(v) AS verifier_disagreed, count_if(u) AS unresolved, count_if(d) AS degraded, count_if(n > 1) AS retried FROM (SELECT source_id, bool_or(verifier = 'disagree') AS v, bool_or(resolution = 'unresolved') AS u, bool_or(retrieval_failures > 0) AS d, count(attempt) AS n FROM attempts GROUP BY ALL)",
    "failures_by_role": f"{ALL}, r AS (SELECT source_id, CASE WHEN status = 'matched' AND NOT correct THEN 'wrong_match' WHEN status = 'unmatched' AND NOT no_match THEN 'missed' WHEN status = 'needs_review' AND correct THEN 'needless_review' WHEN status = 'failed' THEN 'failed' END AS role FROM judged WHERE labelled) SELECT role, source_id, row_number() OVER (PARTITION BY role ORDER BY source_id) AS place FROM r WHERE role IS NOT NULL QUALIFY place <= 20",
    "confidence_values": f"SELECT event_id, CASE WHEN answer IN ('0.75', '1') THEN answer::DOUBLE END AS score FROM ({plain(ANSWERS)})",
    "route_proposals": f"""WITH p AS (SELECT source_id, place, kind, trim(value) AS value, CASE WHEN kind = 'candidate' THEN upper(trim(value)) ELSE lower(regexp_replace(trim(value), ' +', ' ', 'g')) END AS form FROM ({plain(PROPOSALS)})),
q AS (SELECT *, row_number() OVER (PARTITION BY source_id, kind, form ORDER BY place) AS n,
  CASE WHEN kind = 'candidate' THEN EXISTS (SELECT 1 FROM events e WHERE e.user_id = source_id AND 'C0' || e.event_id % 4 = form) ELSE EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'signup' AND e.user_id = source_id AND 'term ' || e.event_id % 5 = form) END AS known FROM p)
SELECT source_id, place, kind, value, CASE WHEN value = '' THEN 'blank' WHEN kind = 'candidate' AND NOT known THEN 'not_issued' WHEN kind = 'candidate' AND n > 1 THEN 'duplicate' WHEN kind = 'candidate' THEN 'candidate' WHEN known OR n > 1 THEN 'already_tried' ELSE 'query' END AS outcome FROM q""",
    "dispatch_calls": """WITH r AS (SELECT event_id AS seq, event_type || user_id % 40 AS request_key, event_type = 'view' AS hit FROM events), m AS (SELECT request_key, min(seq) AS f, row_number() OVER (ORDER BY min(seq)) AS n FROM r WHERE NOT hit GROUP BY request_key)
SELECT seq, request_key, CASE WHEN hit THEN 'cached' WHEN n > 90 THEN 'refused' WHEN seq = f THEN 'call' ELSE 'shared' END AS answer FROM r LEFT JOIN m USING (request_key)""",
    "stop_reasons": "SELECT user_id AS run, event_id AS iteration, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 'converged' WHEN count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 THEN 'oscillation' WHEN event_id >= 900 THEN 'max_iterations' END AS reason FROM events",
    "max_live_clusters": "WITH s AS (SELECT user_id AS run, event_id - event_id % 7 AS step, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END) AS delta FROM events GROUP BY ALL), l AS (SELECT run, sum(delta) OVER (PARTITION BY run ORDER BY step) AS live FROM s) SELECT run, max(live)::BIGINT AS max_live FROM l GROUP BY run",
    "join_passes": f"{TOP20}, o AS (SELECT query_id, id, min(CASE retriever WHEN 'overlap' THEN 0 ELSE 1000 END + rank) AS spot FROM hits GROUP BY ALL) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY spot, id) AS rank FROM o",
    "preflight_counts": "WITH i AS (SELECT doc_id - doc_id % 3 * (doc_id % 2) AS id, doc_id % 10 <= 1 OR trim(coalesce(text, '')) = '' AS blank FROM documents), g AS (SELECT id, count(*) AS n FROM i GROUP BY id) SELECT (SELECT count(*) FROM i) AS rows, (SELECT count(*) FROM g WHERE n > 1) AS duplicate_ids, (SELECT count(*) FROM i WHERE blank) AS empty_texts",
    "gold_restricted": f"SELECT source_id, count_if(k) AS kept, count_if(NOT k) AS dropped FROM (SELECT source_id, gold_id IN (SELECT p_partkey FROM part WHERE p_size <= 40) AS k FROM ({plain(GOLD_FLAT)})) GROUP BY ALL",
    "gold_alias_closure": f"WITH g AS ({plain(GOLD_FLAT)}) SELECT source_id, gold_id FROM g UNION SELECT source_id, gold_id + 1 FROM g WHERE gold_id IN (SELECT p_partkey FROM part WHERE p_size < 10)",
    "hop_headroom": f"""WITH g AS ({plain(GOLD_FLAT)}), s AS (SELECT DISTINCT l_orderkey AS source_id, l_partkey AS candidate FROM lineitem WHERE l_linenumber > 3), h AS ({plain(PARENTS)}),
m AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source_id = g.source_id AND candidate = gold_id))
SELECT count(*) AS missed, count_if(EXISTS (SELECT 1 FROM s JOIN h ON (h.id = candidate AND h.parent = gold_id) OR (h.parent = candidate AND h.id = gold_id) WHERE s.source_id = m.source_id)) AS one_hop FROM m""",
    "co_exposure": "WITH s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS i, p_brand AS b FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT (SELECT count(*) FROM (SELECT DISTINCT x.i, y.i FROM s x JOIN s y ON x.o = y.o AND x.b = y.b AND x.i < y.i)) AS exposed_pairs, (SELECT sum(n * (n - 1) // 2)::BIGINT FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)) AS gold_pairs",
    "screen_funnel": f"WITH {bm25(ITEMS, DOCS, 'a')}, r AS (SELECT query_id, id, {RANK} AS rank FROM a QUALIFY {RANK} <= 50), g AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), f AS (SELECT query_id, min(rank) AS best FROM g LEFT JOIN r USING (query_id, id) GROUP BY ALL) SELECT count(*) AS asked, count(best) AS retrieved, count_if(best <= 5) AS shortlisted, count_if(best = 1) AS \"first\" FROM f",
    "pair_table": f"WITH {bm25(ITEMS, DOCS, 'a')}, r AS (SELECT query_id, id, true AS shown FROM a QUALIFY {RANK} <= 5), g AS (SELECT item_id AS query_id, doc_id AS id, true AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT query_id, id, coalesce(gold, false) AS same, shown IS NULL AS blocking_miss FROM r FULL JOIN g USING (query_id, id)",
    "parsed_answers": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '{"a":2}' WHEN 2 THEN '{"a":"}","b":{"c":3}}' END AS object FROM events""",
    "review_problems": f"SELECT w.*, CASE WHEN k.result_key IS NULL THEN 'unknown_key' WHEN w.source_hash IS DISTINCT FROM k.source_hash THEN 'source_changed' WHEN NOT current THEN 'not_current' WHEN proposed_id IS DISTINCT FROM matched_id THEN 'recomputed' WHEN target_digest <> 't1' THEN 'targets_changed' END AS problem FROM ({plain(WORKSHEET)}) w LEFT JOIN ({plain(KEYED)}) k USING (result_key)",
    "run_gate": "WITH d AS (SELECT l_returnflag || l_linestatus AS domain, round(avg(CASE WHEN l_quantity > 24 + l_linenumber % 2 THEN 1.0::DOUBLE ELSE 0 END) - avg(CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0 END), 6) AS delta, round(avg(l_extendedprice * 0.4) / avg(l_extendedprice), 6) AS token_ratio FROM lineitem GROUP BY ALL), p AS (SELECT *, delta >= -0.02 AND token_ratio <= 0.5 AS domain_passes FROM d) SELECT *, bool_and(domain_passes) OVER () AND round(avg(delta) OVER (), 6) >= 0 AS run_passes FROM p",
    "selected_iterations": """WITH e AS (SELECT user_id AS run, event_id AS i, event_id % 17 AS u, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 'converged' WHEN count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 THEN 'oscillation' WHEN event_id >= 900 THEN 'max_iterations' END AS reason FROM events),
f AS (SELECT run, min(i) AS last, arg_min(reason, i) AS reason FROM e WHERE reason IS NOT NULL GROUP BY run)
SELECT run, last, f.reason AS reason, CASE WHEN f.reason = 'converged' THEN last ELSE arg_min(i, u * 1000000000 + i) END AS selected FROM f JOIN e USING (run) WHERE i <= last GROUP BY run, last, f.reason""",
}
