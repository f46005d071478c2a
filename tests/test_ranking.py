import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking, shortlist
from tessera.plans.catalogue import ORACLES, QUERIES
from tessera.session import ranked


def test_fusion(spark):
    rows = [(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "b"), (1, 2, "c"), (1, 3, "a")]
    got = {r["item"]: r for r in ranking.fuse(spark.createDataFrame(rows, "list_no int, pos bigint, item string")).collect()}
    assert got["b"]["rank"] == 1 and abs(got["b"].points - (1 / 62 + 1 / 61)) < 1e-9
    assert got["a"].best_list == 0 and got["b"].best_list == 1


def test_cosine_errors(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="zero vector"):
        frame.select(ranking.cosine(F.col("a"), F.col("b"))).collect()


def test_pooled_keeps_first_query(spark):
    found = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.5), (1, 2, 0.7), (0, 2, 0.1)], "query_id bigint, doc_id bigint, score double")
    assert {r.doc_id: (r.score, r.query_id) for r in ranking.pooled(found).collect()} == {1: (0.5, 0), 2: (0.7, 1)}


def test_cap(spark):
    rows = [(i + 1, g) for i, g in enumerate(["x", "x", None, "x", None, "y", "x"])]
    order = spark.createDataFrame(rows, "rank bigint, g string")
    got = {r["rank"]: (r.chosen, r.capped) for r in ranking.cap_per_group(order, "g", "rank", 1, 4).collect()}
    assert [got[i] for i in range(1, 8)] == [(True, False), (False, True), (True, False), (False, True), (True, False), (True, False), (False, False)]
    assert not any(r.chosen or r.capped for r in ranking.cap_per_group(order, "g", "rank", 1, 0).collect())


def test_ranked_across_partitions(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("v"))
    got = ranked(frame, ["k"], [F.col("v")]).collect()
    for k in range(3):
        mine = sorted((r.v, r["rank"]) for r in got if r.k == k)
        assert [r for _, r in mine] == list(range(1, len(mine) + 1))


def test_scores_keep_queries_off_the_driver(spark, monkeypatch):
    frame = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "doc_id bigint, vector array<double>")
    asked = frame.withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(ranking, "BLOCK", 16, raising=False)
    monkeypatch.setattr(type(frame), "toLocalIterator", lambda self, *a: pytest.fail("queries were read by the driver"))
    got = {(r.query_id, r.doc_id): r.score for r in ranking.scores(asked, frame).collect()}
    rows = {r.doc_id: r.vector for r in frame.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert len(got) == 1600
    assert all(abs(got[q, d] - dot(rows[q], rows[d]) / math.sqrt(dot(rows[q], rows[q]) * dot(rows[d], rows[d]))) < 2e-6 for q, d in got)


def _vectors(spark, n=90):
    rng = random.Random(11)
    return spark.createDataFrame([(i * 7 % 97, [float(rng.randrange(-1, 2)) + 0.5 for _ in range(3)]) for i in range(n)], "doc_id bigint, vector array<double>")


def test_whole_orders_are_made_where_scores_are(spark, monkeypatch):
    """Ties by equal vectors; small blocks; like the orders by range, without shuffling a pair."""
    monkeypatch.setattr(ranking, "BLOCK", 16)
    docs = _vectors(spark)
    asked = docs.filter("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    want = ranking.full_ranks(ranking.scores(asked, docs)).select("query_id", "doc_id", "score", "rank").collect()
    monkeypatch.setattr(ranking, "ranked", lambda *a: pytest.fail("pairs were ranked by range"))
    assert sorted(map(tuple, ranking.whole_ranks(asked, docs).collect())) == sorted(map(tuple, want))
    assert ranking.whole_ranks(asked.limit(0), docs).isEmpty() and ranking.whole_ranks(asked, docs.limit(0)).isEmpty()


@pytest.mark.parametrize("parts", [1, 2])
def test_many_lists_are_fused_without_rows_of_pairs(spark, monkeypatch, parts):
    monkeypatch.setattr(ranking, "BLOCK", 16)
    docs = _vectors(spark)
    asked = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), F.floor(F.col("doc_id") / (3 * parts)).cast("bigint").alias("list_no"), "vector")
    want = sorted(map(tuple, shortlist.whole_order(asked, docs).select("doc_id", "points", "best_list", "rank").collect()))
    monkeypatch.setattr(shortlist, "FEW_LISTS", 4)
    monkeypatch.setattr(shortlist, "full_ranks", lambda *a: pytest.fail("lists were ranked by range"))
    assert sorted(map(tuple, shortlist.whole_order(asked, docs).select("doc_id", "points", "best_list", "rank").collect())) == want
    got, depth = shortlist.fused_prefix(asked, docs, 5, depth=6)
    assert depth == 90 and sorted(map(tuple, got.select("doc_id", "points", "best_list", "rank").collect())) == want


@pytest.mark.parametrize("hot", [0, 40])
def test_owners_in_one_block_need_no_exchange(spark, monkeypatch, hot):
    docs = _vectors(spark).withColumn("owner", F.when(F.col("doc_id") < hot, 1000).otherwise(F.floor(F.col("doc_id") / 4)).cast("bigint"))
    asked = docs.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    want = sorted(map(tuple, ranking.owner_scores(asked, docs).select("query_id", "owner", "score").collect()))
    monkeypatch.setattr(ranking, "BLOCK", 16)
    monkeypatch.setattr(ranking, "SMALL", 1)
    got = ranking.owner_scores(asked, docs)
    assert sorted(map(tuple, got.select("query_id", "owner", "score").collect())) == want
    assert hot or "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("top", [None, 7])
def test_a_long_list_is_cut_into_blocks(spark, monkeypatch, top):
    docs = _vectors(spark)
    asked = docs.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") > 20, 1).otherwise(0).alias("list_no"), "vector")
    want = sorted(map(tuple, ranking.list_scores(asked, docs).collect()))
    monkeypatch.setattr(ranking, "BLOCK", 16)
    monkeypatch.setattr(ranking, "SMALL", 1)
    blocks = ranking._blocks
    monkeypatch.setattr(ranking, "_blocks", lambda v, key, whole=None, size=None: pytest.fail("a list is one block") if whole == "list_no" else blocks(v, key, whole, size))
    got = sorted(map(tuple, ranking.list_scores(asked, docs, top).collect()))
    assert got == want if top is None else set(got) <= set(want)
    if top:
        for n in (0, 1):
            best = sorted((-s, d) for no, d, s in want if no == n)[:top]
            assert set(best) <= {(-s, d) for no, d, s in got if no == n}


def test_equal_rows_have_one_order(spark, tmp_path):
    """Rows equal in price, order and line number, in two orders of the file: the same result, with fewer conflicts first."""
    rows = [(1, 1, 10.0 + i // 4, [45.0, 1.0][i % 2], 0.0, [0.0, 0.05][i // 2 % 2]) for i in range(40)]
    got = []
    for name, mine in (("there", rows), ("back", rows[::-1])):
        spark.createDataFrame(mine, "l_orderkey bigint, l_linenumber int, l_extendedprice double, l_quantity double, l_discount double, l_tax double").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        got.append(sorted(map(tuple, QUERIES["pref_rerank"](spark, f"{tmp_path}/{name}").select("before", "rank").collect())))
    conflicts = sorted((-price, (quantity > 40) + (tax < 0.01)) for _, _, price, quantity, _, tax in rows)
    ranks = sorted(range(1, 41), key=lambda before: (conflicts[before - 1][1], before))
    assert got[0] == got[1] == [(before, ranks.index(before) + 1) for before in range(1, 41)]


@pytest.mark.parametrize("small", [1, 1024])
def test_pooled_query_of_far_ids_is_that_of_the_statement(spark, tmp_path, monkeypatch, small):
    """Scores a few millionths apart and ids over 100,000 apart: one number orders both in the statement."""
    monkeypatch.setattr(ranking, "SMALL", small)
    monkeypatch.setattr(ranking, "BLOCK", 4)
    at = lambda cosine: [cosine, math.sqrt(1 - cosine**2)]
    asked = {0: 0.5, 20: 0.499999, 100040: 0.500001, 100060: 0.500001, 300020: 0.500002}
    rows = [(k, at(c)) for k, c in asked.items()] + [(k, at(1 - k / 1000)) for k in range(1, 9)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    base = duckdb.connect()
    base.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(base.execute(ORACLES["rank_pooled"]).fetchall())
    names = ["doc_id", "score", "query_id"]
    assert sorted(map(tuple, QUERIES["rank_pooled"](spark, str(tmp_path)).select(*names).collect())) == want
    best = ranking.pooled_scores(*[spark.createDataFrame(rows, f"{k} bigint, vector array<double>").filter("query_id % 20 = 0" if k == "query_id" else "true") for k in ("query_id", "doc_id")])
    assert sorted(map(tuple, best.select(*names).collect())) != want  # the operator by itself keeps the first of the best score


def test_whole_orders_come_document_by_document(spark, monkeypatch):
    """Rows in the order in which they are small on disk: documents ascend, but where a task goes on to its next block of queries."""
    docs = [r.doc_id for r in QUERIES["rank_all"](spark, "/root/testdata/sf0.001").collect()]
    assert len(docs) == 12_500 and sum(a > b for a, b in zip(docs, docs[1:])) < 25
    monkeypatch.setattr(ranking, "BLOCK", 16)
    monkeypatch.setattr(ranking, "ROWS", 50)
    few = _vectors(spark)
    asked = few.filter("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    want = sorted(map(tuple, ranking.whole_ranks(asked, few).select("query_id", "doc_id", "rank").collect()))
    assert sorted(map(tuple, ranking.whole_ranks(asked, few, scored=False).collect())) == want
    monkeypatch.setattr(ranking, "MOST_HELD", 10)
    got = ranking.whole_ranks(asked, few, scored=False)
    assert got.columns == ["query_id", "doc_id", "rank"] and sorted(map(tuple, got.collect())) == want
