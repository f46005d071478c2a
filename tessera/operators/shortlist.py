"""Fused shortlists without whole orders: a threshold algorithm over sorted prefixes (V7, V8, V9, V16, W3 of the survey).

Each list is ranked to a depth only. A document not met in a list stands below that depth there, which bounds what the list can add to its
points; a document met nowhere is bounded by all lists together. Exact positions of a few documents can be counted without an order: a task
counts how many of its documents come before each of them, and Spark adds the counts. The k-th of the most promising documents' exact
points is the bar; the depth grows to where the bound of what is met nowhere is below it. Then only documents whose own bound
reaches the bar can be among the first k, and their positions are counted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import FEW_LISTS, RRF_K, Block, few_queries, full_ranks, fuse, fused_whole, list_scores, meet, places, pooled_lists
from tessera.session import written

#: Documents whose positions are counted at once; points are rounded to 12 digits, so bounds keep twice that away.
MOST_CANDIDATES, SLACK = 1024, 2e-12


def prefixes(queries: DataFrame, documents: DataFrame, depth: int, few: Block | None = None) -> DataFrame:
    """``list_no, doc_id, pos`` of the first ``depth`` documents of each list."""
    found = list_scores(queries, documents, depth, few)
    pos = F.row_number().over(Window.partitionBy("list_no").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("pos", pos.cast("bigint")).filter(F.col("pos") <= depth).select("list_no", "doc_id", "pos")


def positions(queries: DataFrame, documents: DataFrame, wanted: pd.DataFrame, few: Block | None = None) -> DataFrame:
    """``list_no, doc_id, pos`` of wanted documents in every list, by counting what comes before each; no list is ranked.

    ``wanted``: doc_id and vector of at most ``MOST_CANDIDATES`` documents.
    """
    asked = queries.sparkSession.sparkContext.broadcast(Block.of(wanted, "doc_id"))

    def work(q: Block, d: Block) -> np.ndarray:
        w = asked.value
        return places(pooled_lists(q, d)[1], d.ids, pooled_lists(q, w)[1], w.ids)

    def finish(q: Block, before: np.ndarray) -> pd.DataFrame:
        numbers = np.unique(q.more["list_no"])
        return pd.DataFrame({"list_no": np.tile(numbers, len(before)), "doc_id": np.repeat(asked.value.ids, len(numbers)), "n": before.ravel()})

    schema = f"list_no {queries.schema['list_no'].dataType.simpleString()}, doc_id {documents.schema['doc_id'].dataType.simpleString()}, n bigint"
    counted = meet(queries.select("query_id", "list_no", "vector") if few is None else few, documents.select("doc_id", "vector"), work, schema, "list_no", finish)
    return counted.groupBy("list_no", "doc_id").agg((F.sum("n") + 1).alias("pos"))


def fused_prefix(queries: DataFrame, documents: DataFrame, k: int, depth: int | None = None) -> tuple[DataFrame, int]:
    """The first documents of the fused order, ``doc_id, points, best_list, rank``: k and those whose points equal the k-th's, or all there are.

    ``queries``: query_id, list_no, vector; a list ranks documents by their best score over its queries. Also returns the depth
    that was ranked. Where no depth decides, whole orders are fused as ``ranking.fuse`` does; so they are at once for over ``FEW_LISTS`` lists, whose
    points come from one pass without an order that is shuffled.
    """
    few, n = few_queries(queries.select("query_id", "list_no", "vector")), documents.count()
    lists = queries.select("list_no").distinct().count() if few is None else len(np.unique(few.more["list_no"]))
    if lists > FEW_LISTS:
        return whole_order(queries, documents), n
    vectors, depth, bar = documents.select("doc_id", "vector"), depth or max(k, RRF_K), None
    while lists and depth < n:
        met = prefixes(queries, documents, depth, few).groupBy("doc_id").agg(F.sum(1 / (RRF_K + F.col("pos"))).alias("least"), F.count("*").alias("met"))
        seen = written(met, "seen")
        if bar is None:  # what the most promising documents really have; it is no more than the k-th of all
            best = vectors.join(F.broadcast(seen.orderBy(F.desc("least")).limit(min(2 * k, MOST_CANDIDATES)).select("doc_id")), "doc_id").toPandas()
            points = positions(queries, documents, best, few).groupBy("doc_id").agg(F.sum(1 / (RRF_K + F.col("pos"))).alias("p"))
            exact = [r.p for r in points.orderBy(F.desc("p")).limit(k).collect()]
            bar = exact[-1] if len(exact) == k else 0.0
        unmet = 1 / (RRF_K + depth + 1)
        if lists * unmet < bar - SLACK:
            possible = seen.filter(F.col("least") + (lists - F.col("met")) * unmet >= bar - SLACK).select("doc_id")
            wanted = vectors.join(F.broadcast(possible.limit(MOST_CANDIDATES + 1)), "doc_id").toPandas()
            if len(wanted) <= MOST_CANDIDATES:
                exact = positions(queries, documents, wanted, few).select("list_no", "pos", F.col("doc_id").alias("item"))
                order = fuse(exact, few=True).withColumnRenamed("item", "doc_id")
                return order.withColumn("__r", F.rank().over(Window.orderBy(F.desc("points")))).filter(F.col("__r") <= k).drop("__r"), depth
        enough = math.ceil(lists / (bar - 2 * SLACK)) - RRF_K if bar > 3 * SLACK else 0
        depth, bar = (enough, bar) if enough > depth else (4 * depth, bar or None)
    return whole_order(queries, documents), n


def whole_order(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """All documents fused: ``doc_id, points, best_list, rank``. Many lists are ordered and added up where their scores are made."""
    many = queries.select("list_no").distinct().limit(FEW_LISTS + 1).count() > FEW_LISTS
    fused = fused_whole(queries, documents) if many else None
    if fused is not None:
        return fused.withColumnRenamed("item", "doc_id")
    ranks = full_ranks(list_scores(queries, documents), "list_no")
    return fuse(ranks.select("list_no", F.col("rank").alias("pos"), F.col("doc_id").alias("item"))).withColumnRenamed("item", "doc_id")


def shortlist(queries: DataFrame, documents: DataFrame, groups: DataFrame, group: str, cap: int, top: int) -> DataFrame:
    """W3 over V7: the first ``top`` of the fused order with at most ``cap`` of a group: ``doc_id, points, best_list, rank`` and the group.

    ``groups``: doc_id and the group; rows of a null group are never capped, cap 0 is none. The fused prefix grows until it holds ``top`` rows
    that the cap lets through.
    """
    k, n, depth = 2 * top, documents.count(), None
    while True:
        order, depth = fused_prefix(queries, documents, k, depth)
        named = order.join(groups.select("doc_id", group), "doc_id")
        place = F.row_number().over(Window.partitionBy(group).orderBy("rank"))
        free = named.withColumn("__n", place).filter((F.col("__n") <= cap) | F.col(group).isNull() | F.lit(cap == 0)).drop("__n")
        chosen = written(free.orderBy("rank").limit(top), "chosen")
        if k >= n or depth >= n or chosen.count() >= top:
            return chosen
        k *= 4
