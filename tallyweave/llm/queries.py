"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, filter_audit, langid, licences, personal_data, quality
from .collocations import collocations
from .neighbours import nearest
from .packing import pack_documents
from .sharding import shuffle_to_shards
from .simhash_dedup import near_groups
from .substring_dedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PROBE = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layouts: the table's rows by turn, and conversation -1 as a JSON document of messages."""
    rows = table(spark, sf_dir, "conversations")
    turns = F.array(*(F.struct(F.lit(role).alias("role"), F.lit(PROBE).alias("content")) for role in ("user", "assistant")))
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(turns.alias("messages"))).alias("document"))
    return chat_format.digests(chat_format.format_sources([rows], [(probe, "document")]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = table(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 3"
    voters = quality.fit(docs, table(spark, sf_dir, "labels"), f"{remainder} <> 1")
    scored = quality.score(docs, voters, carry=["doc_id"])
    return scored.select("doc_id", F.coalesce(F.expr(f"{remainder} = 1"), F.lit(False)).alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_to_shards(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return licences.scan(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", *(f"found.{n}" for n in names))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item found in a document, with its best region; clean documents give none."""
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.edits", "hit.start", "hit.end")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = table(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 4"
    found = langid.identify(docs, langid.fit(docs, f"{remainder} <> 2"), carry=["doc_id"])
    return found.select("doc_id", F.coalesce(F.expr(f"{remainder} = 2"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"), carry=["doc_id"])


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_quality, op3_simhash, op4_sharding, op5_packing, op6_licences, op7_decontaminate, op8_substring_dedup, op9_neighbours, op10_langid,
        op11_collocations, op12_filter_audit, op13_personal_data,
    )
}
ORACLES: dict[str, str] = {
    "op1_chat_format": r"""
WITH rows AS (
  SELECT 'turn rows' AS layout, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT 'messages', -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT 'messages', -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), chats AS (
  SELECT conv_id, layout, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(20 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
      + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))) AS formatted_chars
  FROM rows GROUP BY conv_id, layout
)
SELECT conv_id, layout, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM chats
""",
    "op9_neighbours": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS number FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1),
      lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.number <> c.number AND len(q.e) = len(c.e)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score, vec_id) AS place FROM pairs)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 10
""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT lang, doc, generate_subscripts(parts, 1) AS piece, unnest(parts) AS piece_text FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
      string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS parts FROM documents)
), words AS (
  SELECT lang, doc, piece, generate_subscripts(ws, 1) AS place, unnest(ws) AS w FROM (
    SELECT lang, doc, piece, list_filter(string_split_regex(piece_text, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces)
), runs AS (
  SELECT lang, w AS w1, lead(w, 1) OVER win AS w2, lead(w, 2) OVER win AS w3 FROM words WINDOW win AS (PARTITION BY doc, piece ORDER BY place)
), one AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
held AS (
  SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL
), cuts AS (
  SELECT lang, w1 || ' ' || w2 AS phrase, two.f AS a, 1 AS k, p.f AS l, q.f AS r FROM two JOIN one p USING (lang, w1) JOIN (SELECT lang, w1 AS w2, f FROM one) q USING (lang, w2)
    LEFT JOIN held USING (lang, w1, w2) WHERE most IS NULL OR 100 * most < 50 * two.f
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, three.f, 1, p.f, q.f FROM three JOIN one p USING (lang, w1) JOIN (SELECT lang, w1 AS w2, w2 AS w3, f FROM two) q USING (lang, w2, w3)
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, three.f, 2, p.f, q.f FROM three JOIN two p USING (lang, w1, w2) JOIN (SELECT lang, w1 AS w3, f FROM one) q USING (lang, w3)
), best AS (
  SELECT lang, phrase, a, l, r, CAST((1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (l::HUGEINT * r::HUGEINT) AS BIGINT) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (l::HUGEINT * r::HUGEINT), k) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) USING (lang) WHERE rank <= 2000
""",
    "op12_filter_audit": r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), flags AS (
  SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 5 * length(body) AS c, regexp_matches(body, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS e FROM docs
), marks AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), marked AS (
  SELECT part, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM flags LEFT JOIN marks USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT part, filter_order, step, filter_order[step] AS filter, n_fails, good, toxic, fails[filter_order[step]] AS fails_here,
    len(list_filter(range(1, step), lambda i: fails[filter_order[i]])) > 0 AS gone
  FROM marked, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counts AS (
  SELECT part, filter_order, step, filter, count(*) FILTER (NOT gone AND NOT fails_here) AS kept, count(*) FILTER (NOT gone AND fails_here) AS removed,
    count(*) FILTER (gone AND fails_here) AS redundant, count(*) FILTER (fails_here AND n_fails = 1) AS unique_fails,
    count(*) FILTER (NOT gone AND fails_here AND good) AS good_lost, count(*) FILTER (NOT gone AND fails_here AND toxic) AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM counts
""",
}
