"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are cut into blocks of neighbouring ``vec_id``; a block keeps the ids and components of its vectors (the forward
index) and each dimension's largest and smallest value. A query's bound on a block is the sum over dimensions of the
larger of its products with the two, which no vector of the block exceeds. Each task orders its blocks by that bound for
every query, scores block after block, and drops a query once its next bound is below its k-th score (an equal bound
may still hold a tie with a smaller id, so it is scored). The best so far go on from batch to batch of a task, so a task sends
on at most k rows for each query. A first pass over the block that a query is in gives a floor for the k-th score.

The query set is a stated part of the rows; it passes through in slabs of at most ``slab`` vectors. A slab is read, broadcast,
answered, written and dropped before the next is read, so neither the driver nor a broadcast holds more as the table grows.

Defined cases: vectors that are null, empty, or hold a null or a non-finite component take no part, nor do rows with a
null ``vec_id``; shorter vectors count as filled up with zeros; a query's own row is no candidate of its own, but other rows with its
id are; repeated rows are candidates each, and ask each (``query_row`` tells them apart); other columns are ignored; an empty table
gives an empty result. Components beyond 2**31 in size lead to scores that a long may not hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import new_path, small_batches, written

K, BLOCK, SLAB = 20, 256, 8192
_BLOCKS = "n int, ids binary, rows binary, asks binary, body binary, high binary, low binary"


def whole_numbers(vector: Column, scale: float = 64.0) -> Column:
    """``floor(scale * x)`` for each component x as a double; null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True)), F.transform(x, lambda v: F.floor(F.lit(scale) * v)))


def blocks_of(vectors: DataFrame, dims: int, size: int = BLOCK) -> DataFrame:
    """Blocks of at most ``size`` vectors with neighbouring ids, as binary columns of longs; ``rows`` numbers every vector. To be written."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                body = np.zeros((len(part), dims), np.int64)
                for values, v in zip(body, part["vector"]):
                    values[: len(v)] = v
                held = [part["vec_id"].to_numpy(np.int64), np.arange(row, row + len(part)), part["asks"].to_numpy(np.int64), body, body.max(0), body.min(0)]
                row += len(part)
                yield pd.DataFrame([[len(part), *(h.tobytes() for h in held)]], columns=["n", "ids", "rows", "asks", "body", "high", "low"])

    small_batches(vectors.sparkSession)
    told = vectors.withColumn("tie", F.xxhash64("vector"))  # rows of one id may be many
    return told.repartitionByRange("vec_id", "tie").sortWithinPartitions("vec_id", "tie").select(*vectors.columns).mapInPandas(build, _BLOCKS)


def queries_of(blocks: DataFrame, dims: int) -> DataFrame:
    """``n, ids, rows, body`` of the vectors that ask, block by block."""

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf.itertuples():
                asks = _longs(b.asks) > 0
                if asks.any():
                    yield pd.DataFrame([[int(asks.sum()), *(x[asks].tobytes() for x in (_longs(b.ids), _longs(b.rows), _longs(b.body, dims)))]], columns=["n", "ids", "rows", "body"])

    return blocks.mapInPandas(asking, "n int, ids binary, rows binary, body binary")


def _longs(raw: bytes, dims: int | None = None) -> np.ndarray:
    out = np.frombuffer(raw, np.int64)
    return out.reshape(-1, dims) if dims else out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer product: in doubles where they are exact, else in longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b


class _Best:
    """Each query's k best (score, id) so far, as flat arrays; ``floor`` and ``tie`` are its k-th."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.queries, self.floor = k, queries, floor.copy()
        self.tie = np.full(queries, np.iinfo(np.int64).max)
        self.q, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, other: np.ndarray) -> None:
        """``scores``: a row for each query number in ``q``, a column for each vector; ``other``: those that are not the query's own row."""
        new = ((scores > self.floor[q, None]) | ((scores == self.floor[q, None]) & (ids < self.tie[q, None]))) & other
        row, col = np.nonzero(new)
        if not len(row):
            return
        touched = np.zeros(self.queries, bool)
        touched[q[row]] = True
        old = touched[self.q]
        qs, ss, ii = np.concatenate([self.q[old], q[row]]), np.concatenate([self.score[old], scores[row, col]]), np.concatenate([self.id[old], ids[col]])
        order = np.lexsort((ii, -ss, qs))
        qs, ss, ii = qs[order], ss[order], ii[order]
        first = np.searchsorted(qs, qs)
        rank = np.arange(len(qs)) - first
        last = rank == self.k - 1
        self.floor[qs[last]], self.tie[qs[last]] = ss[last], ii[last]
        kept = rank < self.k
        self.q, self.score, self.id = (np.concatenate([a[~old], b[kept]]) for a, b in ((self.q, qs), (self.score, ss), (self.id, ii)))


def _search(best: _Best, blocks: list, rows: np.ndarray, body: np.ndarray, dims: int) -> None:
    """Block at a time, for all queries of a slab against some blocks; what the queries have found so far is in ``best``."""
    up, down = np.maximum(body, 0), np.minimum(body, 0)
    high = np.concatenate([_longs(b.high, dims) for b in blocks])
    low = np.concatenate([_longs(b.low, dims) for b in blocks])
    bounds = _product(up, high.T) + _product(down, low.T)
    order = np.argsort(-bounds, axis=1, kind="stable")
    alive = np.arange(len(rows))
    for turn in range(len(blocks)):
        at = order[alive, turn]
        open_ = bounds[alive, at] >= best.floor[alive]
        alive, at = alive[open_], at[open_]
        if not len(alive):
            break
        for n in np.unique(at):
            q, block = alive[at == n], blocks[n]
            best.add(q, _product(body[q], _longs(block.body, dims).T), _longs(block.ids), _longs(block.rows) != rows[q, None])


def top_k(vectors: DataFrame, is_query: Column, *, k: int = K, block: int = BLOCK, slab: int = SLAB) -> DataFrame:
    """``query_id, rank, vec_id, score, query_row`` of each query's ``k`` best among all other rows.

    ``vectors`` has ``vec_id`` and ``vector`` (an array of longs, null for rows that take no part).
    """
    spark = vectors.sparkSession
    rows = vectors.filter("vec_id is not null and vector is not null").select("vec_id", "vector", F.coalesce(is_query, F.lit(False)).cast("bigint").alias("asks"))
    dims = rows.agg(F.max(F.size("vector"))).first()[0]
    schema = "query_id bigint, query_row bigint, vec_id bigint, score bigint"
    columns = ("query_id", "rank", "vec_id", "score", "query_row")
    if dims is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint, query_row bigint")
    index = written(blocks_of(rows, dims, block), "blocks")
    slabs = written(queries_of(index, dims), "queries")
    lowest = np.iinfo(np.int64).min
    path = new_path(spark, "scores")

    def run(held: list) -> None:
        numbers, body = np.concatenate([_longs(q["rows"]) for q in held]), np.concatenate([_longs(q["body"], dims) for q in held])
        ids = np.concatenate([_longs(q["ids"]) for q in held])
        sent = spark.sparkContext.broadcast((ids, numbers, body))

        def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The k best of the queries that are in a block themselves: their k-th is a floor."""
            ids, numbers, body = sent.value
            for pdf in batches:
                for b in pdf.itertuples():
                    mine = np.nonzero(np.isin(numbers, _longs(b.rows)))[0]
                    if len(mine):
                        best = _Best(len(mine), k, np.full(len(mine), lowest))
                        _search(best, [b], numbers[mine], body[mine], dims)
                        full = best.floor > lowest
                        yield pd.DataFrame({"query_row": numbers[mine][full], "floor": best.floor[full]})

        at = dict(map(tuple, index.mapInPandas(seeds, "query_row bigint, floor bigint").collect()))  # a number for each query of the slab at most
        floor = spark.sparkContext.broadcast(np.array([at.get(int(i), lowest) for i in numbers], np.int64))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, numbers, body = sent.value
            # a score equal to the floor may win by its id, so the floor goes in one lower
            best = _Best(len(numbers), k, floor.value - (floor.value > lowest))
            for pdf in batches:
                blocks = list(pdf.itertuples())
                for first in range(0, len(blocks), 64):
                    _search(best, blocks[first : first + 64], numbers, body, dims)
            for first in range(0, len(best.q), 10_000):
                some = slice(first, first + 10_000)
                yield pd.DataFrame({"query_id": ids[best.q[some]], "query_row": numbers[best.q[some]], "vec_id": best.id[some], "score": best.score[some]})

        index.mapInPandas(search, schema).write.mode("append").parquet(path)
        sent.destroy()
        floor.destroy()

    held, n, asked_any = [], 0, False
    for q in slabs.toLocalIterator():
        if n and n + q["n"] > slab:
            run(held)
            held, n = [], 0
        held.append(q)
        n += q["n"]
        asked_any = True
    if not asked_any:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint, query_row bigint")
    run(held)
    found = spark.read.schema(schema).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(*columns)


def op9_exact_top_k(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole_numbers(F.col("embedding")).alias("vector"))
    return top_k(vectors, F.col("vec_id") % 20 == 0).drop("query_row")


OP9_SQL = """
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64.0 * x::double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and c.r <> q.r)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
where rank <= 20
"""
