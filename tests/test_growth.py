"""Work that must grow with the rows, not with the pairs of rows that look alike."""

import math
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tallyweave import store
from tallyweave.llm import quality
from tallyweave.operators import engine, retrieval
from tallyweave.operators.index import TextIndex, identity_of
from tallyweave.sources import targets


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_cut_into_words_once_for_its_vector(spark):
    rows = targets.encoded(spark.createDataFrame([(1, "b a b"), (2, "  ")], "id long, text string"), dimensions=16)
    got = {r.id: r.vector for r in rows.collect()}
    assert got[2] == [0.0] * 16 and abs(sum(x * x for x in got[1]) - 1) < 1e-12 and max(got[1]) >= 2 / 5**0.5 - 1e-12
    assert optimised(rows).count("regexp_extract_all") == 1


def test_equal_names_are_counted_before_they_meet_mentions(spark):
    names = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c"), (3, "d"), (4, "d"), (None, "c")], "id long, name string")
    asked = spark.createDataFrame([(10, "a b!"), (11, "C"), (12, "x"), (13, None), (14, "c"), (14, "d"), (15, "a b"), (15, "A B")], "source_id long, mention string")
    found = retrieval.exact_lookup(asked, names)
    assert sorted(tuple(r) for r in found.collect()) == [(10, 2, "needs_review", None), (11, 1, "matched", 3), (12, 0, "unmatched", None), (13, 0, "unmatched", None), (14, 2, "needs_review", None), (15, 2, "needs_review", None)]
    once = optimised(retrieval.exact_lookup(asked.where("source_id <> 14"), names)).splitlines()
    joins = [k for k, line in enumerate(once) if "Join LeftOuter" in line]
    assert len(joins) == 1 and any("Aggregate [key" in line for line in once[joins[0] :])


def test_equal_texts_are_scored_once_and_told_apart_again(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["red anvil", "blue bolt", "red bolt"][i % 3], [["red anvil"], ["x"], ["red bolt"]][i % 3]) for i in range(300)], "id long, text string, forms array<string>")
    asked = spark.createDataFrame([(q, ["RED anvil", "bolt", "none"][q % 3]) for q in range(60)], "query_id long, text string")
    pairs, plain = [], retrieval.bm25_scores
    monkeypatch.setattr(retrieval, "bm25_scores", lambda q, d: (pairs.append((q.count(), d.count())), plain(q, d))[1])
    got = {}
    for r in retrieval.exact_boosted(asked, docs, 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, round(r.score, 6))
    assert pairs == [(3, 3)]
    assert sorted(got) == [q for q in range(60) if q % 3 < 2]
    assert [got[0][k][0] for k in range(1, 8)] == [0, 3, 6, 9, 12, 15, 18] and [got[1][k][0] for k in range(1, 8)] == [1, 2, 4, 5, 7, 8, 10]
    idf = lambda df, n=300: math.log(1 + (n - df + 0.5) / (df + 0.5))
    assert got[57][1][1] == round(idf(200) + idf(100) + 10 * idf(100), 6) and got[58][1][1] == round(idf(200), 6)


def test_searches_of_few_terms_shuffle_no_pairs(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(30))) for i in range(400)], "id long, text string")
    asked = spark.createDataFrame([(q, " ".join(f"w{(q + j) % 90}" for j in range(80))) for q in range(20)], "query_id long, text string")
    index = TextIndex.build(docs, str(tmp_path), identity_of(table="x"), inverted=False)
    assert not (tmp_path / "generation0" / "postings").exists()
    again = TextIndex.open(spark, str(tmp_path), identity_of(table="x"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    near = again.search(asked, 5)
    assert rows(near) == rows(retrieval.top(retrieval.scored(asked, index.postings(), index.stats()), 5))
    assert "Join" not in optimised(near) and "Aggregate" not in optimised(near)
    shared = retrieval.overlap_top(asked, again.documents(), 5)
    assert rows(shared) == rows(retrieval.top(retrieval.overlap_scores(asked, index.postings()), 5))
    assert "Join" not in optimised(shared) and "Aggregate" not in optimised(shared)


def test_fuzzy_and_exact_forms_score_as_by_joins(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Anvils and bolts"), (2, "anvil anvil bolt"), (3, "ANVIL  bolts"), (4, "nothing"), (5, None), (6, "anvul boltz")], "id long, text string")
    asked = spark.createDataFrame([(7, "anvil bolts"), (8, "anvils"), (9, "")], "query_id long, text string")
    index = TextIndex.build(docs, str(tmp_path), identity_of(table="x"), inverted=False)
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    want = retrieval.top(retrieval.fuzzy_scores(asked, index.postings(), index.stats(), vocabulary=index.vocabulary()), 3)
    assert rows(retrieval.fuzzy_top(asked, index.documents(), index.vocabulary(), 3)) == rows(want)
    got = {(r.query_id, r["rank"]): (r.id, r.is_exact) for r in retrieval.exact_first(asked, docs.withColumn("forms", F.array("text")), 2).collect()}
    assert got[7, 1] == (3, 1) and got[7, 2][1] == 0 and got[8, 1] == (1, 0)


def test_rounds_of_clustering_send_no_table_by_the_driver(spark, monkeypatch):
    joins, save = [], store.Work.save
    sent = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    monkeypatch.setattr(store.Work, "save", lambda self, df, name: (joins.extend((name, x) for x in sent(df) if "/engine-" in self.root), save(self, df, name))[1])
    labels = ["red cat big fat one", "red cat big fat two", "red cat big fat", "blue dog", "blue dog", "a b c d e f g", "a b c d e x y"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(labels)], "id string, label string")
    log = engine.cluster_blocks(rows, F.lit("b"), settings=engine.Settings(max_refine_iterations=1))
    joins += [(f.__name__, x) for f in (engine.selected_members, engine.selected_clusters, engine.run_summary) for x in sent(f(log))]
    # Lists of blocks, and terms of a search, are counted to be few before they are sent.
    assert joins and not [x for x in joins if not ("[block#" in x[1] and "LeftSemi" in x[1] or "[term#" in x[1])]


def test_voters_are_fitted_with_one_dense_table_at_a_time():
    rng = np.random.default_rng(5)
    shares = (rng.random((4096, quality.TERMS), np.float32) * (rng.random((4096, quality.TERMS), np.float32) < 0.02)).astype(np.float32)
    rows, labels = [quality.sparse(x) for x in shares], rng.integers(0, 2, 4096)
    tracemalloc.start()
    voters = quality.Voters(rows, labels, {0: 9000, 1: 5000})
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * shares.nbytes  # the work of the eigenvectors is most of it
    plain = quality.Voters(shares, labels, {0: 9000, 1: 5000})
    assert (voters.idf == plain.idf).all() and (voters.axes == plain.axes).all() and (voters.vectors == plain.vectors).all()
