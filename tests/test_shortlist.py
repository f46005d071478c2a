"""Shortlists by threshold bounds and metrics by counting against whole orders."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, metrics, ranking, shortlist


def vectors(rng, n, near=None):
    base = [rng.gauss(0, 1) for _ in range(6)]
    return [(i, [b * (near or 0) + rng.gauss(0, 1) for b in base]) for i in range(n)]


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, vector array<double>")


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, list_no bigint, vector array<double>")


def first(order, k):
    """k rows of a whole order and those level with the last."""
    rows = sorted(map(tuple, order.select("rank", "doc_id", "points", "best_list").collect()))
    return [r for r in rows if r[2] >= rows[min(k, len(rows)) - 1][2]]


@pytest.fixture
def no_whole_order(monkeypatch):
    monkeypatch.setattr(shortlist, "full_ranks", lambda *a: pytest.fail("a whole list was ranked"))
    monkeypatch.setattr(ranking, "ranked", lambda *a: pytest.fail("a whole list was ranked"))


@pytest.mark.parametrize("small", [1024, 1])
def test_prefix_like_whole_order(spark, monkeypatch, small):
    """Two lists that agree by and large; one list has three parts. One block of queries, and shipped blocks of both sides."""
    monkeypatch.setattr(ranking, "SMALL", small)
    monkeypatch.setattr(ranking, "BLOCK", 32)
    rng = random.Random(3)
    docs = corpus(spark, vectors(rng, 600))
    q = [rng.gauss(0, 1) for _ in range(6)]
    queries = asked(spark, [(0, 0, q), (1, 1, [x + rng.gauss(0, 0.1) for x in q]), (2, 1, [x + rng.gauss(0, 0.1) for x in q]), (3, 1, [rng.gauss(0, 1) for _ in range(6)])])
    want = first(shortlist.whole_order(queries, docs), 7)
    with monkeypatch.context() as m:
        m.setattr(shortlist, "full_ranks", lambda *a: pytest.fail("a whole list was ranked"))
        got, depth = shortlist.fused_prefix(queries, docs, 7, depth=8)
        assert depth < 600
        assert first(got, 7) == want


def test_only_prefixes_are_ranked(spark, no_whole_order):
    rng = random.Random(4)
    docs, q = corpus(spark, vectors(rng, 2000)), [rng.gauss(0, 1) for _ in range(6)]
    queries = asked(spark, [(i, i, [x + rng.gauss(0, 0.05) for x in q]) for i in range(4)])
    got, depth = shortlist.fused_prefix(queries, docs, 5)
    assert depth <= 500 and got.count() >= 5
    assert shortlist.prefixes(queries, docs, depth).count() == 4 * depth


def test_ties_at_the_bound(spark):
    """Documents level in points: two lists in opposite orders, and equal vectors, which go by id."""
    angles = [(i, [1.0, float(i - 4)]) for i in range(9)] + [(100 + i, [1.0, 0.0]) for i in range(40)]
    docs = corpus(spark, angles).coalesce(2).cache()
    queries = asked(spark, [(0, 0, [1.0, 0.5]), (1, 1, [1.0, -0.5])])
    whole = shortlist.whole_order(queries, docs)
    for k in (1, 2, 9):
        for depth in (1, 10):
            got, _ = shortlist.fused_prefix(queries, docs, k, depth=depth)
            assert first(got, k) == first(whole, k)


def test_candidates_over_the_limit(spark, monkeypatch):
    """Too many candidates deepen the prefixes, at last to whole orders."""
    monkeypatch.setattr(shortlist, "MOST_CANDIDATES", 2)
    docs = corpus(spark, vectors(random.Random(5), 50))
    queries = asked(spark, [(0, 0, [1.0] + [0.0] * 5), (1, 1, [-1.0] + [0.0] * 5)])
    got, depth = shortlist.fused_prefix(queries, docs, 4)
    assert depth == 50 and first(got, 4) == first(shortlist.whole_order(queries, docs), 4)


@pytest.mark.parametrize("cap", [0, 2])
def test_capped_shortlist(spark, cap):
    rng = random.Random(6)
    docs = corpus(spark, vectors(rng, 400))
    groups = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.when(F.col("doc_id") % 3 == 0, "rare").otherwise("hot")).alias("g"))
    queries = asked(spark, [(i, i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(3)])
    whole = shortlist.whole_order(queries, docs).join(groups, "doc_id").orderBy("rank").collect()
    want, used = [], {}
    for r in whole:
        used[r.g] = used.get(r.g, 0) + 1
        if cap == 0 or r.g is None or used[r.g] <= cap:
            want.append((r["rank"], r.doc_id, r.g))
    got = shortlist.shortlist(queries, docs, groups, "g", cap, 12)
    assert sorted((r["rank"], r.doc_id, r.g) for r in got.collect()) == want[:12]


def test_no_rows(spark):
    docs, queries = corpus(spark, vectors(random.Random(1), 3)), asked(spark, [(0, 0, [1.0] * 6)])
    assert shortlist.fused_prefix(queries.limit(0), docs, 3)[0].count() == 0
    assert shortlist.fused_prefix(queries, docs.limit(0), 3)[0].count() == 0
    assert shortlist.fused_prefix(queries, docs, 10)[0].count() == 3


@pytest.mark.parametrize("small", [1024, 2])
def test_metrics_like_whole_orders(spark, monkeypatch, small):
    """Labels of one document only, of none, a query without anything relevant, and ties by equal vectors."""
    monkeypatch.setattr(ranking, "SMALL", small)
    monkeypatch.setattr(ranking, "BLOCK", 16)
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]) if i < 90 else i, [float(rng.randrange(-1, 2)) + 0.5 for _ in range(3)]) for i in range(93)]
    docs = spark.createDataFrame(rows, "doc_id bigint, label int, vector array<double>")
    queries = docs.filter("doc_id % 5 = 0 or doc_id > 89").select(F.col("doc_id").alias("query_id"), F.col("label").alias("good"), (F.col("label") + 1).alias("maybe"), "vector")
    ranks = ranking.full_ranks(ranking.scores(queries, docs).filter("query_id <> doc_id"))
    pairs = queries.join(docs.select("doc_id", "label"), (F.col("label") == F.col("good")) | (F.col("label") == F.col("maybe"))).filter("query_id <> doc_id")
    graded = pairs.select("query_id", "doc_id", F.when(F.col("label") == F.col("good"), 2).otherwise(1).alias("grade"))
    monkeypatch.setattr(ranking, "full_ranks", lambda *a: pytest.fail("a whole list was ranked"))
    want = metrics.retrieval(ranks, graded.filter("grade = 2"), 3)
    assert sorted(map(tuple, evaluation.retrieval(queries, docs, 3).collect())) == sorted(map(tuple, want.collect()))
    want = {r.query_id: round(r.ndcg, 9) for r in metrics.ndcg(ranks, graded, 10).collect()}
    assert {r.query_id: round(r.ndcg, 9) for r in evaluation.ndcg(queries, docs, 10).collect()} == want


def test_places():
    import numpy as np

    rng = np.random.default_rng(2)
    ids, got = rng.permutation(40), np.round(rng.random((40, 3)), 1)
    want_ids, want = np.array([ids[3], ids[30], 999, -1]), np.round(rng.random((4, 3)), 1)
    brute = [[sum(got[r, c] > want[w, c] or (got[r, c] == want[w, c] and ids[r] < want_ids[w]) for r in range(40)) for c in range(3)] for w in range(4)]
    assert ranking.places(got, ids, want, want_ids).tolist() == brute
