"""Whole runs by hand: the match loop, the decider's path, the clustering engine, indexes, stores and exports."""

import collections
import json
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave import store
from tallyweave.functions import answers
from tallyweave.functions import text as tx
from tallyweave.operators import cluster, decide, engine, ledger, matcher, reports, retrieval
from tallyweave.operators.index import IncompatibleIndex, TextIndex, identity_of
from tallyweave.sources import exports, targets


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize("text", ["München großé", "É  x ß", "ệ ệ", "ΣΑΣ ς", "á́ ñ", "plain  TEXT", "İx ſt"])
def test_exact_form_is_composed_and_folded(spark, text):
    want = " ".join(unicodedata.normalize("NFC", text).replace("İ", "i̇").casefold().split())
    assert one(spark, f=tx.exact_form(F.lit(text))).f == want


def test_tokens_of_any_script(spark):
    assert one(spark, t=tx.tokens(F.lit("Été_1, straße Ελλάς 東京-2"))).t == ["été_1", "strasse", "ελλάσ", "東京", "2"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://me:pw@Host.X:80/p?a=1&api_key=s&max_tokens=5&monkey=2&x-token=1&b=c+d*e~f&g#frag", "https://host.x:80/p?a=1&max_tokens=5&monkey=2&b=c+d%2Ae~f&g=#frag"),
        ("not a url", "not a url"), ("/rel?token=1", "/rel?token=1"), ("http://h?token=1", "http://h"), ("postgresql://u:p@db/x?sslmode=on&passwd=1", "postgresql://db/x?sslmode=on"),
    ],
)
def test_urls_lose_credentials_only(spark, url, want):
    assert one(spark, u=tx.redact_url(F.lit(url))).u == want


@pytest.mark.parametrize(("answer", "want"), [("nil", (None, "abstain")), ("\tC02\n", ("GO:2", "exact_key")), ("{C01}", (None, "unresolved")), (None, (None, "abstain")), ("GO:2", (None, "unresolved"))])
def test_keys_are_resolved_exactly(spark, answer, want):
    issued = F.create_map(*map(F.lit, ("C01", "go:1", "C02", "GO:2")))
    assert tuple(one(spark, r=tx.resolve_key(F.lit(answer).cast("string"), issued)).r) == want


@pytest.mark.parametrize(("answer", "want"), [("GO:2", ("GO:2", "legacy_exact_id")), ("go:2", ("GO:2", "legacy_fuzzy")), ("2", ("GO:2", "legacy_fuzzy")), ("99", (None, "unresolved")), ("1", ("x", "legacy_rank"))])
def test_legacy_ways_are_named(spark, answer, want):
    issued = F.create_map(*map(F.lit, ("C01", "x", "C02", "GO:2")))
    assert tuple(one(spark, r=tx.resolve_key(F.lit(answer), issued, legacy=True)).r) == want


@pytest.mark.parametrize(
    ("said", "want"),
    [("<think>x</think> a", "a"), ("so </THINK> b", "b"), ("x <reasoning>never", "x"), ("<think>a<thinking>b</think>c", "c"), ("a <think>b</think> c </think> d", "d"), ("plain", "plain"), ("thinking aloud", "thinking aloud"), ("<thinker>x", "<thinker>x")],
)
def test_reasoning_is_left_out(spark, said, want):
    assert one(spark, r=answers.without_reasoning(F.lit(said))).r == want


def test_half_precision(spark):
    v = [0.1, -3.14159, 65504.0, 1e-7, 2**-25, 2**-24 * 0.51, 0.0, 1 / 3, 2049.0, 2051.0]
    assert one(spark, h=tx.half(F.array(*map(F.lit, v)))).h == [float(x) for x in np.array(v).astype(np.float16)]
    with pytest.raises(Exception, match="half precision"):
        one(spark, h=tx.half(F.array(F.lit(1e9))))


def damerau(a, b):
    last, d = {}, {(-1, -1): len(a) + len(b)}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = len(a) + len(b), i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = len(a) + len(b), j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m, cost = last.get(b[j - 1], 0), seen, a[i - 1] != b[j - 1]
            if not cost:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_fuzzy_terms_count_a_transposition_once(spark):
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abc"), int(n))) for n in rng.integers(3, 9, 150)})
    df = spark.createDataFrame([(w,) for w in words], "term string")
    got = {(r.query_term, r.term): r.edits for r in retrieval.fuzzy_terms(df, df).collect()}
    assert got == {(a, b): damerau(a, b) for a in words for b in words if len(a) >= 5 and 0 < damerau(a, b) <= 2}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "red cat big"), (2, "red cat"), (3, "blue dog small house"), (4, "green fish"), (5, "")], "id long, text string")


def test_index_answers_alike_whatever_its_history(spark, docs, tmp_path):
    asked = spark.createDataFrame([(7, "red dog"), (8, "fish")], "query_id long, text string")
    whole = TextIndex.build(docs, str(tmp_path / "a"), identity_of(table="x"))
    steps = TextIndex.build(docs.where("id <= 2").withColumn("text", F.lit("old words")), str(tmp_path / "b"), identity_of(table="x"))
    steps.add(docs.where("id <> 4"))
    steps.add(docs.where("id = 4").union(spark.createDataFrame([(9, "red red")], "id long, text string")))
    steps.remove(spark.createDataFrame([(9,)], "id long"))
    found = lambda index: sorted(map(tuple, index.search(asked, 5).collect()))
    assert found(whole) == found(steps) == sorted(map(tuple, retrieval.bm25_topk(asked, docs, 5).select("query_id", "id", "score", "rank").collect()))
    assert whole.digest() == steps.digest()
    again = TextIndex.open(spark, str(tmp_path / "b"), identity_of(table="x"))
    assert again.step == steps.step and found(again) == found(steps)
    again.add(docs.where("id = 1"))
    assert again.digest() == whole.digest()
    with pytest.raises(IncompatibleIndex, match="table"):
        TextIndex.open(spark, str(tmp_path / "a"), identity_of(table="y"))
    with pytest.raises(FileNotFoundError):
        TextIndex.open(spark, str(tmp_path / "none"), identity_of(table="x"))
    assert TextIndex.opened_or_built(docs.where("id = 3"), str(tmp_path / "a"), identity_of(table="y")).stats().first().n_docs == 1
    assert [r.id for r in whole.search(asked.where("query_id = 7"), 1, exclude=spark.createDataFrame([(2,)], "id long")).collect()] != [2]


def test_store_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_folder(Session)


def test_holders_equal_contains(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"], 12)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    items = [texts[3][1:-1], texts[5][:11], "b cd e", "ab", "zz yy xx ww", texts[8] + " x", ""]
    asked = spark.createDataFrame(list(enumerate(items)), "query_id long, text string")
    got = sorted(map(tuple, retrieval.holding(asked, docs, retrieval.postings(docs)).collect()))
    assert got == sorted((q, i) for q, x in enumerate(items) for i, t in enumerate(texts) if x in t)


def test_fuzzy_best_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    names = [(i, "".join(rng.choice(list("abcd "), 9)).strip()) for i in range(80)]
    asked = [(i, "".join(c for c in names[i][1] if rng.random() < 0.9) + ("x" if i % 3 else "")) for i in range(40)] + [(99, ""), (98, None)]
    got = {r.source_id: (r.matched_id, r.score, r.status) for r in retrieval.fuzzy_best(spark.createDataFrame(asked, "source_id long, mention string"), spark.createDataFrame(names, "id long, name string")).collect()}
    key = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    for source, text in asked:
        ratio, best = max(((SequenceMatcher(None, key(n), key(text)).ratio(), -i) for i, n in names), default=(0, None))
        want = (-best, round(ratio, 4), "matched" if ratio >= 0.9 else "needs_review") if ratio >= 0.75 else (None, None, "unmatched")
        assert got[source] == want


def test_dense_tiles_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 5)), 1)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    for size in (100_000, 7):
        monkeypatch.setattr(retrieval, "TILE_VECTORS", size)
        got = collections.defaultdict(list)
        for r in retrieval.dense_topk(v.where("id % 9 = 0").withColumnRenamed("id", "query_id"), v, 4, record=F.floor(F.col("id") / 3)).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.id, r.best_id))
        for q in range(0, 90, 9):
            y = np.round(x @ x[q], 9)
            best = sorted(range(30), key=lambda k: (-y[3 * k : 3 * k + 3].max(), k))[:4]
            assert got[q] == [(k, 3 * k + int(y[3 * k : 3 * k + 3].argmax())) for k in best]


def searching(docs):
    return lambda asked, k: retrieval.bm25_topk(asked, docs, k)


def test_match_loop(spark):
    goal = spark.createDataFrame([("g1", "red cat big"), ("g2", "red cat"), ("g3", "blue dog small house"), ("g4", "green fish")], "id string, text string")
    asked = spark.createDataFrame([(1, "red cat big"), (2, "red cat bigger"), (3, "nothing here"), (4, "blue dog tiny castle of stone"), (5, None), (6, "green fish")], "source_id long, text string")
    results, attempts = matcher.match(asked, goal, searching(goal), matcher.lexical_models())
    got = {r.source_id: (r.status, r.reason, r.matched_id, r.attempts) for r in results.collect()}
    assert got == {
        "1": ("matched", "accept_threshold", "g1", 1), "2": ("matched", "accept_threshold", "g2", 1), "3": ("unmatched", "no_candidates", None, 2),
        "4": ("unmatched", "below_review_floor", None, 2), "5": ("unmatched", "no_candidates", None, 1), "6": ("matched", "accept_threshold", "g4", 1),
    }
    assert attempts.where("verifier = 'support'").count() == 1  # only scores in the band are verified


def test_match_loop_tries_the_same_work_after_an_outage(spark):
    goal = spark.createDataFrame([("g1", "red cat")], "id string, text string")
    asked = spark.createDataFrame([(1, "red cat"), (2, "red bird")], "source_id long, text string")
    plain = matcher.lexical_models()
    broken = lambda reason, upto: matcher.Models(plain.select, plain.score, plain.verify, failure=lambda source, attempt: F.when(attempt < upto, reason))
    run = lambda reason, upto: {r.source_id: (r.status, r.reason, r.attempts) for r in matcher.match(asked, goal, searching(goal), broken(reason, upto))[0].collect()}
    assert run(matcher.PROVIDER, 2) == {"1": ("matched", "accept_threshold", 3), "2": ("failed", "provider_failure", 3)}
    assert run(matcher.PROVIDER, 9)["1"] == ("failed", "provider_failure", 3)
    assert run(matcher.FATAL, 1)["1"] == ("failed", "fatal_provider_failure", 1)


def work(kind, value="q", who=None):
    return {"kind": kind, "value": value, "id": who, "attempt": 0}


STATE = f"source_id string, text string, attempt int, queue {matcher.WORK}, seen array<string>, chased array<string>, done array<string>, work struct<kind: string, value: string, id: string, attempt: int>, retry boolean, turn boolean"
OUT = "source_id string, reason string, accepted boolean, chosen_id string, verifier_lead array<string>, leads array<string>, searches array<string>, rewrites array<string>"


def test_routing_of_leads_and_queries(spark):
    def routed(state, out, policy):
        found = matcher.advanced(spark.createDataFrame([state], STATE), spark.createDataFrame([out | {"source_id": "1"}], OUT), policy).collect()
        return found[0].asDict(recursive=True) if found else None

    state = {"source_id": "1", "text": "t", "attempt": 0, "queue": [work("query", "old")], "seen": ["old", "q"], "chased": [], "done": [], "work": work("query"), "retry": False, "turn": True}
    out = {"reason": None, "accepted": False, "chosen_id": "a", "verifier_lead": ["b"], "leads": ["c", "b"], "searches": ["New  Q", "OLD"], "rewrites": ["never"]}
    policy = matcher.Policy(max_attempts=5)
    after = routed(state, out, policy)
    assert after["work"]["id"] == "b" and [(w["kind"], w["id"] or w["value"]) for w in after["queue"]] == [("query", "old"), ("candidate", "c"), ("candidate", "b"), ("query", "New  Q")]
    assert after["seen"] == ["old", "q", "new q"] and after["chased"] == ["b"] and after["attempt"] == 1
    once = routed(after, out | {"verifier_lead": ["b"], "searches": []}, matcher.Policy(max_attempts=5, deduplicate_candidates=True))
    assert sum(w["id"] == "b" for w in once["queue"]) + (once["work"]["id"] == "b") == 1
    turns = routed(after | {"turn": False}, out | {"verifier_lead": [], "leads": [], "searches": []}, matcher.Policy(max_attempts=5, alternate_queues=True))
    assert turns["work"]["kind"] == "query"
    for stop in ({"reason": matcher.FATAL}, {"reason": matcher.OVER}, {"accepted": True}):
        assert routed(state, out | stop, policy) is None
    assert routed(state | {"attempt": 4}, out, policy) is None
    alone = state | {"queue": []}
    last = out | {"verifier_lead": [], "leads": [], "searches": []}
    assert routed(alone, last, policy)["work"]["value"] == "never"
    assert routed(alone, last | {"rewrites": ["old"]}, policy) is None
    assert routed(state, out | {"reason": matcher.PROVIDER}, policy)["retry"] is True


def test_match_loop_takes_any_number_of_queries(spark):
    """None, one, two and ten queries of a source: each votes, none is dropped."""
    goal = spark.createDataFrame([(f"g{k}", f"word{k} tail") for k in range(12)], "id string, text string")
    rows = [(0, None, []), (1, "word1 tail", ["word1 tail"]), (2, "word2 tail", ["word9", "word2 tail"]), (3, "word10 tail", [f"word{k}" for k in range(1, 10)] + ["word10 tail", " ", None]), (4, None, None)]
    asked = spark.createDataFrame(rows, "source_id long, text string, queries array<string>")
    results, attempts = matcher.match(asked, goal, searching(goal), matcher.lexical_models(), matcher.Policy(max_attempts=1))
    got = {r.source_id: r for r in results.collect()}
    assert {k: got[k].matched_id for k in "123"} == {"1": "g1", "2": "g2", "3": "g10"} and set(got) == set("01234")
    assert got["0"].status == got["4"].status == "unmatched"
    counts = {r.source_id: r.candidate_count for r in attempts.collect()}
    assert counts["3"] == 12 and counts["0"] == counts["4"] == 0


def test_match_loop_searches_as_deep_as_its_policy(spark):
    goal = spark.createDataFrame([(f"g{k:02}", "same words") for k in range(40)], "id string, text string")
    asked = spark.createDataFrame([(1, "same words")], "source_id long, text string")
    for wanted in (5, 30):
        attempts = matcher.match(asked, goal, searching(goal), matcher.lexical_models(), matcher.Policy(max_attempts=1, candidates=wanted))[1]
        assert attempts.first().candidate_count == wanted


def test_decider_path_and_its_second_pass(spark):
    goal = spark.createDataFrame([("g1", "red cat big"), ("g2", "blue dog")], "id string, text string")
    asked = spark.createDataFrame([(1, "red cat big"), (2, "blue bird of the far green hill and sea"), (3, "zzz"), (4, None)], "source_id long, text string")
    got = {r.source_id: (r.status, r.reason, r.matched_id) for r in matcher.decide_sources(asked, goal, searching(goal), matcher.lexical_decider()).collect()}
    assert got == {"1": ("matched", "accept_threshold", "g1"), "2": ("unmatched", "below_review_floor", None), "3": ("unmatched", "no_candidates", None), "4": ("unmatched", "no_candidates", None)}
    more = matcher.decide_sources(asked, goal, searching(goal), matcher.lexical_decider(lambda t: F.array(F.lit("dog"), F.lit("cat"))))
    counts = {r.source_id: r.candidate_count for r in more.collect()}
    assert counts == {"1": 1, "2": 2, "3": 2, "4": 2}


def test_merged_screens_keep_the_first_order_and_the_higher_probability(spark):
    rows = lambda r: spark.createDataFrame(r, "source_id string, id string, rank int, p double")
    got = matcher.merged_screens(rows([("1", "a", 1, 0.2), ("1", "b", 2, 0.9)]), rows([("1", "c", 1, 0.5), ("1", "a", 2, 0.6)])).orderBy("rank").collect()
    assert [(r.id, r["rank"], r.p) for r in got] == [("a", 1, 0.6), ("b", 2, 0.9), ("c", 3, 0.5)]


def test_leaders_by_ratio_depend_on_order(spark):
    rows = spark.createDataFrame([(1, "abcdefgh", "k"), (2, "abcdefgx", "k"), (3, "abcdefxx", "k"), (4, "ABCDEFGH", "k"), (5, "", "k")], "item_id long, label string, block string")
    assert sorted(map(tuple, cluster.by_leaders(rows, "block").collect())) == [(1, 1), (2, 1), (3, 3), (4, 1), (5, 5)]
    assert sorted(map(tuple, cluster.by_leaders(rows, "block", reverse=True).collect())) == [(1, 4), (2, 4), (3, 3), (4, 4), (5, 5)]


LOG = "source_id string, seq long, status string, matched_id string, confidence double, reason string"


@pytest.fixture(scope="module")
def run_log(spark):
    log = spark.createDataFrame([("a", 1, "failed", None, None, "x"), ("a", 2, "matched", "t1", 0.9, "ok"), ("b", 3, "needs_review", "t1", 0.5, "low"), ("z", 4, "matched", "t2", 0.8, "ok"), ('c"d', 5, "unmatched", None, 0.1, 'a,"b"\nc')], LOG)
    return spark.createDataFrame([("a",), ("b",), ('c"d',), ("new",)], "source_id string"), log


def test_exports(spark, run_log, tmp_path):
    snapshot, log = run_log
    exports.export("raw", str(tmp_path / "raw"), snapshot, log)
    read = spark.read.csv(str(tmp_path / "raw"), header=True, quote='"', escape='"', multiLine=True)
    assert tuple(read.columns) == exports.MAPPING
    rows = {r.source_id: r for r in read.collect()}
    assert (rows["new"].status, rows["new"].reason, rows["new"].matched_id) == ("pending", "pending", None)
    assert rows['c"d'].reason == 'a,"b"\nc' and rows["a"].matched_id == "t1" and len(rows) == 4
    reviews = spark.createDataFrame([("b", "replace", "t9", "applied"), ("a", "reject", None, "stale")], "source_id string, decision string, corrected_id string, state string")
    exports.export("reviewed", str(tmp_path / "reviewed"), snapshot, log, reviews)
    seen = {r.source_id: r for r in spark.read.csv(str(tmp_path / "reviewed"), header=True, quote='"', escape='"', multiLine=True).collect()}
    assert (seen["b"].final_matched_id, seen["b"].final_status, seen["b"].model_matched_id) == ("t9", "matched", "t1") and seen["a"].final_status == "matched"
    exports.export("history", str(tmp_path / "history"), snapshot, log, reviews)
    assert sorted((r.result.seq, r.revision, r.current) for r in spark.read.json(str(tmp_path / "history")).collect()) == [(1, 1, False), (2, 2, True), (3, 1, True), (4, 1, True), (5, 1, True)]
    with pytest.raises(ValueError, match="unknown view"):
        exports.export("other", "", snapshot, log)


def test_manifest_and_state(spark, run_log):
    snapshot, log = run_log
    calls = spark.createDataFrame([("r", 1, "complete"), ("r", 2, None)], "run string, seq long, state string")
    out = exports.manifest(snapshot, log.union(spark.createDataFrame([("b", 9, "matched", "t1", 0.7, "ok")], LOG)), calls)
    assert out["counts"] == {"matched": 2, "unmatched": 1, "pending": 1} and out["duplicate_target_count"] == 1 and out["removed_sources"] == 1
    assert (out["run_state"], out["exit_code"]) == ("partial", 1) and out["last_invocation"]["seq"] == 2 and json.dumps(out)
    counted = reports.counts(snapshot, log)
    assert [reports.run_state(counted, s).first().exit_code for s in ("interrupted", "aborted", None)] == [130, 3, 1]
    assert ledger.last_invocation(calls).first().state == "interrupted"


def test_worksheet_round_trip(spark, run_log, tmp_path):
    snapshot, log = run_log
    exports.write_csv(exports.worksheet(ledger.latest(log), "run1"), str(tmp_path / "w"))
    rows = spark.read.csv(str(tmp_path / "w"), header=True)
    assert tuple(rows.columns) == exports.WORKSHEET and [r.source_id for r in rows.collect()] == ["b"]
    fill = lambda decision, target: exports.write_csv(rows.withColumn("decision", F.lit(decision)).withColumn("corrected_target_id", F.lit(target)), str(tmp_path / decision))
    fill(" Accept", "")
    assert [(r.decision, r.corrected_target_id) for r in exports.read_worksheet(spark, str(tmp_path / " Accept")).collect()] == [("accept", None)]
    for decision, said in (("replace", "without a target"), ("maybe", "unknown decision")):
        fill(decision, "")
        with pytest.raises(Exception, match=said):
            exports.read_worksheet(spark, str(tmp_path / decision)).collect()


@pytest.mark.parametrize(("rows", "said"), [([("1", "a", None), ("1", "b", None)], "repeated"), ([("1", "a", "odd")], "unknown outcome"), ([("1", None, None)], "no cluster_id"), ([(" ", "a", None)], "no item_id")])
def test_assignments_refuse(spark, rows, said):
    with pytest.raises(Exception, match=said):
        exports.assignments(spark.createDataFrame(rows, "item_id string, cluster_id string, outcome string")).collect()


def test_assignments_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", None), ("2", "a", None), ("3", "b", None), ("4", None, "needs_review")], "source_id string, cluster_id string, outcome string")
    exports.write_assignments(rows, str(tmp_path / "a"))
    assert sorted(map(tuple, exports.read_assignments(spark, str(tmp_path / "a")).collect())) == [("1", "a", "assigned"), ("2", "a", "assigned"), ("3", "b", "singleton"), ("4", "", "needs_review")]
    (tmp_path / "p.csv").write_text("source_id,partition\n 1,test\n2,other\n")
    with pytest.raises(Exception, match="unknown partition"):
        exports.read_partition(spark, str(tmp_path / "p.csv")).collect()


def test_cluster_files(spark, tmp_path):
    log = engine.cluster_blocks(spark.createDataFrame([("1", "red cat", "k"), ("2", "red cat", "k"), ("3", "dog", "k")], "id string, label string, block string"), F.col("block"))
    exports.write_clusters(engine.selected_members(log), engine.selected_clusters(log), log.where("kind = 'merge'"), str(tmp_path))
    read = {n: spark.read.csv(str(tmp_path / n), header=True) for n in ("members", "clusters", "unresolved")}
    assert tuple(read["members"].columns) == exports.MEMBERS and tuple(read["clusters"].columns) == exports.CLUSTERS and read["members"].count() == 3
    assert sorted((r.size, r.status) for r in read["clusters"].collect()) == [("1", "singleton"), ("2", "verified")]
    assert spark.read.json(str(tmp_path / "decisions")).count() == log.where("kind = 'merge'").count()


def test_targets(spark, tmp_path):
    home = targets.Targets(spark, str(tmp_path / "t"))
    rows = lambda r: spark.createDataFrame(r, "id string, label string")
    assert {r.action: r.n for r in home.load("x", rows([("1", "a"), ("2", "b")])).collect()} == {"insert": 2}
    assert {r.action: r.n for r in home.load("x", rows([("2", "B"), ("3", None)])).collect()} == {"insert": 1, "update": 1, "keep": 1}
    assert home.get("x", "2")["label"] == "B" and home.get("x", "1")["label"] == "a"
    assert {r.action: r.n for r in home.load("x", rows([("2", "B")]), prune=True).collect()} == {"keep": 1, "prune": 2}
    with pytest.raises(KeyError):
        home.get("x", "1")
    with pytest.raises(ValueError, match="repeated"):
        home.load("x", rows([("1", "a"), ("1", "b")]))
    ids = spark.createDataFrame([(0, "9"), (1, "2")], "place int, id string")
    assert [(r.place, r.label) for r in home.get_many("x", ids).collect()] == [(1, "B")]
    some = targets.encoded(targets.vector_rows(home.terms("x"), F.array("label"), F.col("label")), dimensions=8)
    home.add_vectors("x", some, 8)
    assert home.missing_vectors("x", some).count() == 0 and home.missing_vectors("x", some.withColumn("text", F.lit("other"))).count() == 2
    with pytest.raises(Exception, match="dimensions"):
        home.add_vectors("x", some.withColumn("vector", F.array(F.lit(1.0))), 8)
    assert {(t, c, n) for t, c, n, size in home.sizes() if size > 0} == {("terms", "x", 1), ("vectors", "x", 2)}
    home.drop("x")
    assert home.sizes() == []


def test_blank_texts_are_not_encoded(spark):
    rows = spark.createDataFrame([(1, " "), (2, None), (3, "word")], "id long, text string")
    got = {r.id: r.vector for r in targets.encoded(rows, lambda t: F.when(F.trim(t) == "", F.raise_error(F.lit("asked")).cast("array<double>")).otherwise(F.array(F.lit(2.0))), 1).collect()}
    assert got == {1: [0.0], 2: [0.0], 3: [2.0]}


@pytest.mark.parametrize("page", [1_000, 3])
def test_removed_gold_makes_as_many_cases_as_asked(spark, monkeypatch, page):
    monkeypatch.setattr(reports, "PAGE", page)
    rng = np.random.default_rng(5)
    gold = [(i, sorted(set(rng.integers(0, 60, int(rng.integers(0, 4))).tolist()))) for i in range(80)]
    here = spark.createDataFrame([(i,) for i in range(55)], "id long")
    gone, left = reports.removed_gold(spark.createDataFrame(gold, "source_id long, gold_ids array<long>"), here, "s", 25, 28)
    labels = {r.source_id: set(r.gold_ids) for r in left.collect()}
    assert 25 <= sum(not x for x in labels.values()) <= 28
    assert labels == {i: {x for x in ids if x < 55 and x not in gone} for i, ids in gold}


def test_chunks_are_halved_while_too_large(spark):
    rows = spark.createDataFrame([(q, k, 10 if q == 1 else 100) for q in (1, 2) for k in range(1, 9)], "query_id long, rank int, chars int")
    got = collections.defaultdict(list)
    for r in reports.chunked(rows, F.col("chars"), 4, 250).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk)
    assert got == {1: [0] * 4 + [1] * 4, 2: [0, 0, 1, 1, 2, 2, 3, 3]}


def test_ensemble_and_choice(spark):
    side = lambda r: spark.createDataFrame(r, "source_id int, status string, matched_id string, confidence double")
    rows = reports.ensemble(spark.createDataFrame([(i,) for i in range(6)], "source_id int"), side([(0, "matched", "a", 0.9), (1, "matched", "a", 0.9), (2, "matched", "a", 0.6), (3, "matched", "a", 0.6), (4, "failed", None, None)]), side([(0, "matched", "a", 0.1), (1, "matched", "b", 0.5), (2, "matched", "b", 0.9), (3, "matched", "b", 0.7)]))
    assert {r.source_id: (r.method, r.matched_id) for r in rows.collect()} == {0: ("consensus", "a"), 1: ("surer_first", "a"), 2: ("surer_second", "b"), 3: ("conflict", None), 4: ("none", None), 5: ("none", None)}
    tied = spark.createDataFrame([(1, 10, 1, 0.5), (1, 11, 2, 0.5), (2, 12, 1, 0.0)], "query_id int, id int, rank int, overlap double")
    assert {r.query_id: (r.id, r.p_choice, r.p_none) for r in decide.overlap_choice(tied).collect()} == {1: (11, 0.5, 0.0), 2: (None, 0.0, 1.0)}


def test_search_one(spark, docs):
    got = retrieval.search_one("red cat", {"bm25": searching(docs), "again": searching(docs)}, docs.where("id <> 2"), 5).collect()
    assert [(r.id, r["rank"], r.evidence) for r in got] == [(1, 1, "again:2|bm25:2")]
    with pytest.raises(ValueError, match="limit"):
        retrieval.search_one("x", {}, docs, 101)


def test_command_line(spark, tmp_path, capsys):
    from tallyweave import cli

    (tmp_path / "t.csv").write_text("id,label,more\ng1,red cat,big\ng2,blue dog,\n")
    (tmp_path / "s.csv").write_text("id,name\n1,red cat big\n2,zzz\n")
    (tmp_path / "gold.csv").write_text("source_id,gold_ids\n1,g1|g9\n2,\n")
    (tmp_path / "i.csv").write_text("id,label,kind\na,red cat,k\nb,red cat,k\nc,dog,j\n")
    (tmp_path / "bad.csv").write_text("id,label\na,x\na,\n")

    def call(*argv):
        code = cli.main(list(map(str, argv)), spark)
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    code, out = call("search", "cat", "--targets", tmp_path / "t.csv")
    assert code == 0 and [h["id"] for h in out["hits"]] == ["g1"]
    for more in ([], ["--decider"]):
        code, out = call("match", "--sources", tmp_path / "s.csv", "--targets", tmp_path / "t.csv", "--out", tmp_path / "out", *more)
        assert code == 0 and out["counts"] == {"matched": 1, "unmatched": 1}
        code, out = call("eval", "--mapping", tmp_path / "out/mapping", "--gold", tmp_path / "gold.csv")
        assert (out["accepted_precision"], out["no_match_recall"], out["n_labelled"]) == (1.0, 1.0, 2)
    code, out = call("cluster", "--items", tmp_path / "i.csv", "--block", "kind", "--out", tmp_path / "groups")
    assert out["clusters"] == 2
    assert call("validate", "--items", tmp_path / "bad.csv") == (1, {"rows": 2, "duplicate_ids": 1, "empty_texts": 1})
    assert call("cluster", "--items", tmp_path / "bad.csv", "--out", tmp_path / "x")[0] == 2


def test_loaders_of_gold_and_sql(spark, tmp_path):
    from tallyweave.sources import files

    (tmp_path / "g.jsonl").write_text('{"source_id": "1", "gold_ids": ["a", " b ", "a"]}\n{"source_id": "2", "gold_ids": []}\n')
    gold = {r.source_id: r.gold_ids for r in files.gold_file(spark, str(tmp_path / "g.jsonl"), lambda x: F.when(x != "b", F.upper(x))).collect()}
    assert gold == {"1": ["A"], "2": []}
    (tmp_path / "g.csv").write_text("source_id,gold_ids\n1,a\n1,b\n")
    with pytest.raises(ValueError, match="repeated"):
        files.gold_file(spark, str(tmp_path / "g.csv"))
    (tmp_path / "b.csv").write_text("id,label\n1,x\n ,y\n")
    with pytest.raises(Exception, match="row 2 has no id"):
        files.csv_records(spark, str(tmp_path / "b.csv"), "id").collect()
    (tmp_path / "l.csv").write_bytes("id,label\n1,é\n".encode("latin-1"))
    assert files.csv_records(spark, str(tmp_path / "l.csv"), "id", encoding="ISO-8859-1").first().label == "é"
    assert files.bound("select ':a', b::int from t where c = :c and d = :d", {"c": "x'y", "d": None}) == "select ':a', b::int from t where c = 'x''y' and d = NULL"
    with pytest.raises(KeyError):
        files.bound("select :x", {})


@pytest.mark.parametrize(("a", "b"), [("Berries", "berry"), ("red cats", "the red cat"), ("", "x"), ("abc", "xyz"), ("glass", "glasses of wine")])
def test_similarity_equals_its_definition(spark, a, b):
    from tallyweave.functions import similarity

    def one_of(w):
        return w[:-3] + "y" if len(w) > 3 and w.endswith("ies") else w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w

    x, y = (" ".join(map(one_of, t.lower().split())) for t in (a, b))
    p, q = set(x.split()), set(y.split())
    want = max(SequenceMatcher(None, x, y).ratio(), len(p & q) / len(p | q)) if x and y else 0.0
    assert one(spark, s=similarity.similarity(F.lit(a), F.lit(b))).s == pytest.approx(want)


STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consistency": "consist", "consolation": "consol", "consolidate": "consolid", "conspicuously": "conspicu", "conspiracy": "conspiraci",
    "knightly": "knight", "kneeling": "kneel", "knocked": "knock", "knives": "knive", "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "hoped": "hope", "hopping": "hop", "luxuriated": "luxuri",
    "cry": "cri", "by": "by", "say": "say", "skies": "sky", "dying": "die", "news": "news", "proceed": "proceed", "generally": "general", "generate": "generat", "communism": "communism", "relational": "relat", "national": "nation", "happiness": "happi",
    "anesthetics": "anesthet", "anesthetic": "anesthet", "running": "run", "beautiful": "beauti", "controlling": "control", "rate": "rate", "beds": "bed", "be": "be", "analogy": "analog", "agreed": "agre", "feed": "feed", "electricity": "electr", "youth": "youth",
}


def test_stems(spark, tmp_path):
    from tallyweave.functions import stem

    assert {w: stem.stem(w) for w in STEMS} == STEMS
    assert one(spark, t=stem.stemmed(F.lit("Anésthetics of RUNNING cœurs"))).t == ["anesthet", "of", "run", "coeur"]
    docs = spark.createDataFrame([(1, "an anaesthetic"), (2, "Anesthetics"), (3, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "anesthetic")], "query_id long, text string")
    index = TextIndex.build(docs, str(tmp_path / "s"), identity_of("en_stem"))
    assert [r.id for r in index.search(asked, 5).collect()] == [2] and index.stats().first().n_docs == 3
    with pytest.raises(IncompatibleIndex, match="analyzer"):
        TextIndex.open(spark, str(tmp_path / "s"), identity_of())
    with pytest.raises(ValueError, match="analyzer"):
        identity_of("other")


def test_inverted_file(spark, monkeypatch):
    from tallyweave.operators import ann

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6)) * 8
    x = centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 6))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(1000, None)], "id long, vector array<double>")
    asked = v.where("id % 30 = 0").withColumnRenamed("id", "query_id")
    exact = retrieval.dense_topk(asked.where("vector is not null"), v.where("vector is not null"), 10)
    whole = ann.topk(asked, v, 10, probes=10**6)
    assert ann.recall(whole, exact).first().recall == 1.0 and whole.count() == exact.count()
    monkeypatch.setattr(ann, "SLICE", 20)
    assert ann.recall(ann.topk(asked, v, 10, probes=8), exact).first().recall >= 0.9
    assert ann.topk(asked.limit(0), v.limit(0), 10).count() == 0


def test_ontology_of_other_predicates(spark, tmp_path):
    from tallyweave.sources import files

    (tmp_path / "o.owl").write_text("""<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:skos="s" xmlns:rdfs="d">
<owl:Class rdf:about="http://purl.obolibrary.org/obo/GO_2"><skos:prefLabel>two</skos:prefLabel><skos:altLabel>b</skos:altLabel><skos:altLabel> a </skos:altLabel><skos:altLabel>a</skos:altLabel><rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/GO_1"/></owl:Class>
<owl:Class rdf:about="http://purl.obolibrary.org/obo/GO_3"><skos:prefLabel>old</skos:prefLabel><owl:deprecated>true</owl:deprecated></owl:Class>
</rdf:RDF>""")
    read = lambda **k: files.owl_records(spark, str(tmp_path / "o.owl"), label="skos:prefLabel", synonyms=("skos:altLabel", "skos:hiddenLabel"), **k).collect()
    assert [(r.id, r.label, r.synonyms, r.parents, r.definition) for r in read()] == [("GO:2", "two", ["a", "b"], ["GO:1"], "")]
    assert len(read(include_obsolete=True)) == 2 and read(id_prefix="CL:") == []
