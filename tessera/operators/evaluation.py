"""Retrieval metrics by counting (A15-A17, A47 of the survey): no row for a pair, and no order.

What is relevant for a query is said by a label: documents of the query's ``good`` label are relevant (grade 2), those of its ``maybe`` label
perhaps (grade 1). The scoring tasks find each query's best relevant document; that score rides with the query into a second pass, in
which tasks count the documents that come before it. A query is no answer to itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.metrics import gain
from tessera.operators.ranking import Block, meet, products, scores, top_ranks
from tessera.operators.windows import discount


def best_relevant(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """``query_id, score, doc_id`` of each query's first relevant document; ``queries``: query_id, good, vector; ``documents``: doc_id, label, vector."""

    def work(q: Block, d: Block) -> pd.DataFrame:
        order = np.argsort(d.ids, kind="stable")
        fits = (d.more["label"][order][:, None] == q.more["good"][None, :]) & (d.ids[order][:, None] != q.ids[None, :])
        got = np.where(fits, products(q, d)[order], -np.inf)
        best = got.argmax(axis=0)
        found = pd.DataFrame({"query_id": q.ids, "score": got[best, np.arange(len(best))], "doc_id": d.ids[order][best]})
        return found[np.isfinite(found["score"])]

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, score double, doc_id {documents.schema['doc_id'].dataType.simpleString()}"
    found = meet(queries.select("query_id", "good", "vector"), documents.select("doc_id", "label", "vector"), work, schema)
    best = F.max(F.struct("score", (-F.col("doc_id")).alias("d"))).alias("b")
    return found.groupBy("query_id").agg(best).select("query_id", "b.score", (-F.col("b.d")).alias("doc_id"))


def places_of(queries: DataFrame, documents: DataFrame, bars: DataFrame) -> DataFrame:
    """``query_id, place``: where each query's bar (``query_id, score, doc_id``) stands among the documents that are not the query, from 1."""
    asked = queries.select("query_id", "vector").join(bars.select("query_id", F.col("score").alias("bar"), F.col("doc_id").alias("bar_id")), "query_id")

    def work(q: Block, d: Block) -> np.ndarray:
        got = products(q, d)
        bar, ids = q.more["bar"][None, :], d.ids[:, None]
        return (((got > bar) | (got == bar) & (ids < q.more["bar_id"][None, :])) & (ids != q.ids[None, :])).sum(axis=0)

    def finish(q: Block, before: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"query_id": q.ids, "n": before})

    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, n bigint"
    counted = meet(asked, documents.select("doc_id", "vector"), work, schema, finish=finish)
    return counted.groupBy("query_id").agg((F.sum("n") + 1).alias("place"))


def own_tops(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """``query_id, doc_id, score, rank`` of each query's first k other documents."""
    return top_ranks(scores(queries, documents, k + 1).filter("query_id <> doc_id"), k)


def _labels_of(queries: DataFrame, documents: DataFrame, names: list[str]) -> DataFrame:
    """The queries with ``n_<name>``: how many other documents have the label that the query calls so. Labels are counted, not paired."""
    sizes = documents.groupBy("label").agg(F.count("*").alias("n"))
    own = documents.select(F.col("doc_id").alias("query_id"), F.col("label").alias("__own"))
    out = queries.drop("vector").join(own, "query_id", "left")
    for name in names:
        out = out.join(sizes.select(F.col("label").alias(name), F.col("n").alias("__n")), name, "left")
        itself = F.coalesce((F.col("__own") == F.col(name)).cast("bigint"), F.lit(0))
        out = out.withColumn(f"n_{name}", F.coalesce("__n", F.lit(0)) - itself).drop("__n")
    return out.drop("__own")


def retrieval(queries: DataFrame, documents: DataFrame, k: int = 3) -> DataFrame:
    """hit@1, recall@k, reciprocal rank and first relevant position of each query that has something relevant."""
    asked = _labels_of(queries.select("query_id", "good"), documents, ["good"]).filter("n_good > 0")
    first = places_of(queries, documents, best_relevant(queries, documents))
    tops = own_tops(queries, documents, k).join(documents.select("doc_id", "label"), "doc_id").join(queries.select("query_id", "good"), "query_id")
    hits = tops.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("good")).alias("hits"))
    got = asked.join(first, "query_id", "left").join(hits, "query_id", "left")
    place = F.col("place")
    return got.select(
        "query_id", F.coalesce((place == 1).cast("double"), F.lit(0.0)).alias("hit_at_1"), (F.coalesce("hits", F.lit(0)) / F.col("n_good")).alias("recall"),
        F.coalesce(1 / place, F.lit(0.0)).alias("reciprocal_rank"), place.alias("first_relevant"),
    )


def ndcg(queries: DataFrame, documents: DataFrame, k: int = 10) -> DataFrame:
    """Graded gain of the first k against that of the best order, which follows from how many documents have each grade."""
    asked = _labels_of(queries.select("query_id", "good", "maybe"), documents, ["good", "maybe"]).filter("n_good + n_maybe > 0")
    tops = own_tops(queries, documents, k).join(documents.select("doc_id", "label"), "doc_id").join(queries.select("query_id", "good", "maybe"), "query_id")
    grade = F.when(F.col("label") == F.col("good"), 2).when(F.col("label") == F.col("maybe"), 1).otherwise(0)
    got = tops.groupBy("query_id").agg(F.sum(gain(grade) * discount(F.col("rank"))).alias("got"))

    def best(r: Column) -> Column:
        return gain(F.when(r <= F.col("n_good"), 2).when(r <= F.col("n_good") + F.col("n_maybe"), 1).otherwise(0)) * discount(r)

    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(k)), best), F.lit(0.0), lambda a, x: a + x)
    rows = asked.join(got, "query_id", "left")
    return rows.select("query_id", F.coalesce(F.col("got") / F.nullif(ideal, F.lit(0.0)), F.lit(0.0)).alias("ndcg"))
