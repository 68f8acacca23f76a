"""Hand-computed cases: ties, nulls, empty lists, thresholds that are met exactly."""

import math

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import ids
from tallyweave.functions import text as tx
from tallyweave.operators import cluster, decide, evaluate, ledger, retrieval
from tallyweave.sources import files

ATTEMPT = "source_id long, attempt int, score double, chosen_id long, resolution string, verifier string, reason string, candidate_count int, retrieval_failures int"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_text(spark):
    r = one(spark, tidy=tx.tidy(F.lit("  a \t b \n\n c  ")), clean=tx.sanitise_query(F.lit('a+b AND (c) "d"')), parts=tx.multivalue(F.lit(" x| |y "), r"\|"), none=tx.multivalue(F.lit(None).cast("string"), r"\|"), key=tx.match_key(F.lit("The CAT's  hat!")), words=tx.tokens(F.lit("Été_1 b")))
    assert (r.tidy, r.clean, r.parts, r.none, r.key, r.words) == ("a b\nc", "a b c d", ["x", "y"], [], "the cat s hat", ["été_1", "b"])


def test_keys_and_scores(spark):
    issued = F.create_map(F.lit("C01"), F.lit("x"))
    r = one(spark, a=tx.resolve_key(F.lit(" c01."), issued), b=tx.resolve_key(F.lit("none"), issued), c=tx.resolve_key(F.lit("C7"), issued), wide=tx.candidate_key(F.lit(7), F.lit(120)), nan=tx.is_valid_score(F.lit(float("nan"))), low=tx.is_valid_score(F.lit(0.0)), null=tx.is_valid_score(F.lit(None).cast("double")))
    assert (r.a.id, r.a.resolution, r.b.resolution, r.c.resolution, r.wide, r.nan, r.low, r.null) == ("x", "exact_key", "abstain", "unresolved", "C007", False, True, False)


def test_draw_is_that_of_sha256(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"s\x0017").digest()[:8], "big") / 2**64
    assert one(spark, d=ids.draw("s", F.lit(17))).d == pytest.approx(want, abs=1e-15)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, ""), (4, "a b")], "id long, text string")
    asked = spark.createDataFrame([(9, "B b"), (8, "")], "query_id long, text string")
    got = retrieval.bm25_topk(asked, docs, 5).orderBy("rank").collect()
    idf, mean = math.log(1 + (4 - 2 + 0.5) / 2.5), 7 / 4
    assert [(r.query_id, r.id, r["rank"]) for r in got] == [(9, 1, 1), (9, 4, 2)]
    assert got[0].score == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / mean)))


def test_fusion_counts_one_vote_per_list(spark):
    hits = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "a", 3), (1, 6, "a", 2), (1, 6, "b", 1)], "query_id int, id int, retriever string, rank int")
    got = {r.id: r.score for r in retrieval.fuse(hits).collect()}
    assert got == {5: pytest.approx(1 / 61), 6: pytest.approx(1 / 62 + 1 / 61)}


def test_budget_is_a_prefix(spark):
    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 90), (1, 3, 1)], "query_id int, rank int, size int")
    got = retrieval.within_budget(ranked, F.col("size"), 10, 20).orderBy("rank").collect()
    assert [r.kept for r in got] == [True, False, False]


@pytest.mark.parametrize(
    ("rows", "status", "reason", "matched"),
    [
        ([(1, None, None, None, None, None, None, None, None)], "failed", "provider_failure", None),
        ([(1, 0, 0.6, 7, "exact_key", None, None, 2, 0)], "matched", "accept_threshold", 7),
        ([(1, 0, 0.9, 7, "exact_key", None, None, 2, 0), (1, 1, 0.9, 8, "exact_key", "support", None, 2, 0)], "matched", "accept_threshold", 7),
        ([(1, 0, 0.9, 7, "exact_key", "disagree", None, 2, 0)], "needs_review", "verifier_disagreement", 7),
        ([(1, 0, 0.4, 7, "exact_key", None, None, 2, 0)], "needs_review", "below_accept_threshold", 7),
        ([(1, 0, 0.39, 7, "exact_key", None, None, 2, 0)], "unmatched", "below_review_floor", None),
        ([(1, 0, 0.39, 7, "exact_key", None, None, 2, 1)], "failed", "retriever_failure", None),
        ([(1, 0, float("nan"), 7, "exact_key", None, None, 2, 0)], "unmatched", "selector_abstained", None),
        ([(1, 0, None, None, "abstain", None, None, 0, 0)], "unmatched", "no_candidates", None),
        ([(1, 0, 0.9, 7, "exact_key", None, None, 1, 0), (1, 1, None, None, None, None, "fatal_provider_failure", 0, 0)], "failed", "fatal_provider_failure", None),
        ([(1, 0, None, None, None, None, "candidate_budget_exceeded", 3, 0), (1, 1, 0.1, 7, "exact_key", None, None, 3, 0)], "needs_review", "candidate_budget_exceeded", 7),
    ],
)
def test_derive_status(spark, rows, status, reason, matched):
    r = decide.derive_status(spark.createDataFrame(rows, ATTEMPT)).first()
    assert (r.status, r.reason, r.matched_id) == (status, reason, matched)


def test_three_kinds_of_gold(spark):
    results = spark.createDataFrame([(1, "matched", 5, 0.9), (2, "unmatched", None, 0.1), (3, "matched", 6, 0.8)], "source_id int, status string, matched_id int, confidence double")
    gold = spark.createDataFrame([(1, [5, 6]), (2, [])], "source_id int, gold_ids array<int>")
    r = evaluate.metrics(evaluate.judged(results, gold)).first()
    assert (r.total, r.n_labelled, r.accepted_precision, r.no_match_precision, r.no_match_recall, r.coverage) == (3, 2, 1.0, 1.0, 1.0, 0.5)


def test_ratios_of_nothing_are_null(spark):
    empty = spark.createDataFrame([], "source_id int, status string, matched_id int, confidence double, gold_ids array<int>, labelled boolean, no_match boolean, correct boolean")
    assert evaluate.metrics(empty).first().coverage is None


def test_partition_scores(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "y")], "item_id int, cluster_id string, gold_id string")
    r = evaluate.partition_scores(rows).first()
    assert (r.true_pairs, r.false_pairs, r.missed_pairs, r.pair_precision, r.pair_recall, r.b3_precision) == (1, 2, 1, 0.3333, 0.5, 0.6667)


def test_ledger_views(spark):
    log = spark.createDataFrame([(1, 1, "failed"), (1, 2, "matched"), (2, 3, "failed"), (9, 4, "matched")], "source_id int, seq int, status string")
    snap = spark.createDataFrame([(1,), (2,), (3,)], "source_id int")
    assert {r.source_id: r.status for r in ledger.current_view(snap, log).collect()} == {1: "matched", 2: "failed", 3: "pending"}
    assert {r.source_id for r in ledger.resume_todo(snap, log).collect()} == {2, 3}
    assert [r.source_id for r in ledger.removed_sources(log, snap).collect()] == [9]


def test_leaders_ignore_row_order(spark):
    rows = [(1, "red cat big", "k"), (2, "Red cat bigs", "k"), (3, "blue dog", "k"), (4, "red cat big", "j")]
    for part in (rows, rows[::-1]):
        got = cluster.by_leaders(spark.createDataFrame(part, "item_id long, label string, block string"), "block").collect()
        assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,label,synonyms\n 1 ,x,a| |b\n2,,\n", encoding="utf-8")
    got = files.csv_records(spark, str(tmp_path / "a.csv"), "id", multivalue=("synonyms",)).orderBy("id").collect()
    assert [(r.id, r.label, r.synonyms) for r in got] == [("1", "x", ["a", "b"]), ("2", "", [])]
    (tmp_path / "b.csv").write_text("id,label\n ,x\n")
    with pytest.raises(Exception, match="no id"):
        files.csv_records(spark, str(tmp_path / "b.csv"), "id").collect()
    (tmp_path / "a.jsonl").write_text('{"k": "1", "n": 2}\n\n{"k": "2", "n": null}\n')
    assert [(r.id, r.n) for r in files.jsonl_records(spark, str(tmp_path / "a.jsonl"), "k").orderBy("id").collect()] == [("1", 2), ("2", None)]
    (tmp_path / "a.obo").write_text('format-version: 1.2\n\n[Term]\nid: X:1\nname: one\ndef: "A \\"q\\" b." [s]\nsynonym: "uno" EXACT []\nis_a: X:0 ! root\n\n[Term]\nid: X:2\nname: two\nis_obsolete: true\n\n[Typedef]\nid: r\nname: rel\n')
    got = files.obo_records(spark, str(tmp_path / "a.obo")).collect()
    assert [(r.id, r.label, r.synonyms, r.parents) for r in got] == [("X:1", "one", ["uno"], ["X:0"])]
    assert files.obo_records(spark, str(tmp_path / "a.obo"), include_obsolete=True).count() == 2


def test_owl(spark, tmp_path):
    (tmp_path / "a.owl").write_text("""<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#">
<owl:Class rdf:about="http://purl.obolibrary.org/obo/X_1"><rdfs:label>one</rdfs:label><oboInOwl:hasExactSynonym>uno</oboInOwl:hasExactSynonym><rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/X_0"/></owl:Class>
<owl:Class rdf:about="http://purl.obolibrary.org/obo/X_2"><rdfs:label>two</rdfs:label><owl:deprecated>true</owl:deprecated></owl:Class>
</rdf:RDF>""")
    got = files.owl_records(spark, str(tmp_path / "a.owl")).collect()
    assert [(r.id, r.label, r.synonyms, r.parents) for r in got] == [("X:1", "one", ["uno"], ["X:0"])]


def test_gold_alias_closure(spark):
    gold = files.gold_sets(spark.createDataFrame([("1", "a|b"), ("2", "")], "source_id string, gold_ids string"))
    aliases = spark.createDataFrame([("a", "c")], "id string, alias string")
    assert {r.source_id: sorted(r.gold_ids) for r in files.expanded_gold(gold, aliases).collect()} == {"1": ["a", "b", "c"], "2": []}


def test_stream_settles_each_source_once(spark, tmp_path):
    from tallyweave.streaming.incremental import match_stream

    (tmp_path / "in").mkdir()
    for k, ids_ in enumerate(([1, 2], [2, 3])):
        spark.createDataFrame([(i,) for i in ids_], "source_id long").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema("source_id long").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        match = lambda todo: todo.select("source_id", F.when(F.col("source_id") == 1, "failed").otherwise("matched").alias("status"))
        match_stream(stream, match, str(tmp_path / "ledger"), str(tmp_path / "checkpoint"), "source_id long, status string").awaitTermination(120)
    got = sorted((r.source_id, r.status) for r in spark.read.parquet(str(tmp_path / "ledger")).collect())
    assert got == [(1, "failed"), (2, "matched"), (3, "matched")]


def test_similarity_takes_the_larger_measure(spark):
    from tallyweave.functions.similarity import similarity

    rows = spark.createDataFrame([("red apple", "apple red"), ("colour", "color"), ("", "x"), (None, "x")], "a string, b string")
    got = [r.s for r in rows.select(similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == 1.0 and abs(got[1] - 10 / 11) < 1e-9 and got[2] == 0.0


def test_confidence_is_never_coerced_or_clamped(spark):
    answers = ["0", "1.0", "1e-3", "1.0001", "-1", "NaN", "Infinity", '"0.5"', "true", "null", "[0.5]", "", None]
    rows = spark.createDataFrame([(x,) for x in answers], "a string")
    assert [r.c for r in rows.select(tx.confidence(F.col("a")).alias("c")).collect()] == [0.0, 1.0, 0.001] + [None] * 10


def test_dispatch_calls_once_for_equal_requests_and_stops_at_the_budget(spark):
    from tallyweave.operators import frontier

    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "d"), (6, "c")], "seq long, request_key string")
    cache = spark.createDataFrame([("d",), ("d",)], "request_key string")
    got = {r.seq: r.answer for r in frontier.dispatch(asked, cache, 2).collect()}
    assert got == {1: "call", 2: "call", 3: "shared", 4: "refused", 5: "cached", 6: "refused"}
    assert frontier.dispatch(asked.limit(0), cache, 2).count() == 0


def test_json_objects_of_odd_answers(spark):
    from tallyweave.functions import answers

    cases = {
        '{"a": [1, 2,], }': '{"a":[1,2]}',
        'x {"a": "\\"}"} y': '{"a":"\\"}"}',
        "} {": None,
        '"{" {"a": 1}': '{"a":1}',
        "<think>never closed {": None,
        "```\n{\"b\": null}\n``` {\"a\": 1}": '{"b":null}',
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, a string")
    got = [r.o for r in rows.select("i", answers.json_object(F.col("a")).alias("o")).orderBy("i").collect()]
    assert got == list(cases.values())


def test_reviews_apply_all_or_none(spark):
    results = spark.createDataFrame([(1, "h", 5, True, "t"), (2, "h", None, True, None)], "result_key long, source_hash string, matched_id long, current boolean, target_digest string")
    good = spark.createDataFrame([(1, "h", 5), (2, "h", None)], "result_key long, source_hash string, proposed_id long")
    bad = good.union(spark.createDataFrame([(3, "h", 5)], good.schema))
    assert ledger.applied_batch(ledger.review_problems(good, results, "t")).count() == 2
    assert ledger.applied_batch(ledger.review_problems(bad, results, "t")).count() == 0
