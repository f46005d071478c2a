"""Ranking of whole corpora by vectors, fusion of rankings, caps and re-ranking.

Scores are rounded to ``DIGITS`` before anything is ordered by them, so that orders do not hang on the last bits; ties
go to the smaller id, which stands for the input position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ranked, written

DIGITS, RRF_K, BLOCK = 6, 60, 512
#: Scores (4 bytes each) that a task holds of the lists it orders, and the documents up to which one list is held whole; more are ranked by range.
CELLS, MOST_HELD = 1 << 26, 1 << 24
#: Rows of an order that a task gives at a time.
ROWS = 1 << 20
#: Lists up to which blocks of documents gather their scores; of more, lists gather their documents.
FEW_LISTS = 64
#: Query vectors that the driver reads and broadcasts; of more, it reads none of those beyond.
SMALL = 1024


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """V1: in doubles; vectors of different sizes and zero vectors are errors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    lengths = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors have different sizes"))).when(lengths == 0, F.raise_error(F.lit("zero vector"))).otherwise(dot / lengths)


@dataclass
class Block:
    """Some vectors in a task: ``ids``, ``unit`` vectors (rows), and further columns by name."""

    ids: np.ndarray
    unit: np.ndarray
    more: dict[str, np.ndarray]

    @classmethod
    def of(cls, pdf: pd.DataFrame, key: str) -> Block:
        return cls(pdf[key].to_numpy(), _unit(np.array(pdf["vector"].tolist(), np.float64)), {c: pdf[c].to_numpy() for c in pdf.columns if c not in (key, "vector")})


def few_queries(queries: DataFrame) -> Block | None:
    """The queries by id, if they are ``SMALL`` at most."""
    few = queries.limit(SMALL + 1).toPandas()
    return None if len(few) > SMALL else Block.of(few.sort_values("query_id", kind="stable"), "query_id")


def meet(queries: DataFrame | Block, documents: DataFrame, work: Callable[[Block, Block], pd.DataFrame], schema: str, whole: str = "query_id", finish=None, whole_documents: str | None = None) -> DataFrame:
    """What ``work(some queries, some documents)`` gives, for every query and document together once.

    ``queries``: ``query_id, vector`` and more, or what ``few_queries`` read of them; ``documents``: ``doc_id, vector`` and more. Up to ``SMALL`` query vectors are read by the driver
    and broadcast as one block. More than those are written as blocks, as documents are then, and Spark ships blocks of queries to blocks
    of documents; rows with one value of ``whole`` share a block of queries. With ``finish``, ``work`` returns arrays of one
    shape, which a task adds up if there is one block of queries, and ``finish(queries, sum)`` makes rows of the sum. Of more queries, documents with one value
    of ``whole_documents`` share a block too.
    """
    few = few_queries(queries) if isinstance(queries, DataFrame) else queries
    one = few is not None
    if one:
        asked = documents.sparkSession.sparkContext.broadcast(few)

        def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Block, Block]]:
            if len(asked.value.ids):
                for pdf in batches:
                    for at in range(0, len(pdf), BLOCK):
                        yield asked.value, Block.of(pdf.iloc[at : at + BLOCK], "doc_id")

        rows = documents
    else:
        left, right = _blocks(queries, "query_id", whole), _blocks(documents, "doc_id", whole_documents)

        def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Block, Block]]:
            for pdf in batches:
                for r in pdf.to_dict("records"):
                    yield tuple(_read(r, k) for k in ("query", "doc"))

        rows = right.crossJoin(left)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for q, d in pairs(batches):
            got = work(q, d)
            if finish is None or not one:
                yield got if finish is None else finish(q, got)
            else:
                total = got if total is None else total + got
        if total is not None:
            yield finish(q, total)

    return rows.mapInPandas(run, schema)


def _read(row: dict, name: str) -> Block:
    ids = row[f"{name}_id"]
    return Block(ids, np.frombuffer(row[f"{name}_body"]).reshape(len(ids), -1), {c.removeprefix(f"{name}_more_"): v for c, v in row.items() if c.startswith(f"{name}_more_")})


class Gather:
    """What a task of ``gathered`` does with a block and all that it meets."""

    def add(self, state, mine: Block, other: Block):
        """The block's state with one more block met; the first state is None."""

    def finish(self, mine: Block, state) -> Iterator[pd.DataFrame]:
        """Rows of a block that has met all others."""
        yield from ()

    def end(self) -> Iterator[pd.DataFrame]:
        """Rows of the whole task."""
        yield from ()


def gathered(blocks: DataFrame, others: DataFrame, names: tuple[str, str], total: int, parts: int, make: Callable[[], Gather], schema: str) -> DataFrame:
    """Each of some written ``blocks`` with all ``others``, whose rows are ``total``, in one task: what they make is added up where it is made.

    A task streams the other side's blocks for each of its own, so neither a row for a pair nor a whole side is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, open_ = make(), {}
        for pdf in batches:
            for r in pdf.to_dict("records"):
                mine, other = (_read(r, n) for n in names)
                state, met = open_.pop(r["block"], (None, 0))
                state, met = task.add(state, mine, other), met + len(other.ids)
                if met == total:
                    yield from task.finish(mine, state)
                else:
                    open_[r["block"]] = state, met
        if open_:
            raise RuntimeError("a block has not met all others in its task")
        yield from task.end()

    dealt = blocks.repartition(parts).withColumn("block", F.monotonically_increasing_id())
    return dealt.hint("shuffle_replicate_nl").crossJoin(others.coalesce(1)).mapInPandas(run, schema)


def _blocks(vectors: DataFrame, key: str, whole: str | None = None, size: int | None = None) -> DataFrame:
    """Written blocks of unit vectors: ``<name>_id``, ``<name>_body`` (doubles row by row) and ``<name>_more_*``; ``whole`` is not cut."""
    size = size or BLOCK
    name, more = key.removesuffix("_id"), [c for c in vectors.columns if c not in (key, "vector")]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for pdf in batches:
            pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
            cut = 0
            for at in (np.flatnonzero(pdf[whole].to_numpy()[1:] != pdf[whole].to_numpy()[:-1]) + 1 if whole else range(1, len(pdf))):
                if at - cut >= size:
                    yield made(pdf.iloc[cut:at])
                    cut = at
            left = pdf.iloc[cut:]
        if left is not None and len(left):
            yield made(left)

    def made(part: pd.DataFrame) -> pd.DataFrame:
        b = Block.of(part, key)
        return pd.DataFrame({f"{name}_id": [b.ids], f"{name}_body": [b.unit.tobytes()]} | {f"{name}_more_{c}": [b.more[c]] for c in more})

    kind = lambda c: vectors.schema[c].dataType.simpleString()
    schema = ", ".join([f"{name}_id array<{kind(key)}>", f"{name}_body binary", *[f"{name}_more_{c} array<{kind(c)}>" for c in more]])
    rows = vectors.repartitionByRange(whole).sortWithinPartitions(*dict.fromkeys([whole, key])) if whole else vectors
    return written(rows.mapInPandas(build, schema), f"{name}_blocks")


def _unit(matrix: np.ndarray) -> np.ndarray:
    if not len(matrix):
        return np.empty((0, 0))
    lengths = np.sqrt((matrix**2).sum(1, keepdims=True))
    if (lengths == 0).any():
        raise ValueError("zero vector")
    return matrix / lengths


def products(q: Block, d: Block) -> np.ndarray:
    """Cosines of documents (rows) and queries (columns), rounded."""
    return np.round(d.unit @ q.unit.T, DIGITS) + 0.0


def _type(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def scores(queries: DataFrame, documents: DataFrame, top: int | None = None) -> DataFrame:
    """``query_id, doc_id, score`` for every query and document (V2, V4, J2), or of each query each block's ``top``."""

    def work(q: Block, d: Block) -> pd.DataFrame:
        got = products(q, d)
        if top and top < len(d.ids):
            order = np.argsort(d.ids, kind="stable")
            at = order[np.argsort(-got[order], axis=0, kind="stable")[:top]]
            return pd.DataFrame({"query_id": np.tile(q.ids, len(at)), "doc_id": d.ids[at].ravel(), "score": np.take_along_axis(got, at, 0).ravel()})
        return pd.DataFrame({"query_id": np.tile(q.ids, len(d.ids)), "doc_id": np.repeat(d.ids, len(q.ids)), "score": got.ravel()})

    schema = f"query_id {_type(queries, 'query_id')}, doc_id {_type(documents, 'doc_id')}, score double"
    return meet(queries.select("query_id", "vector"), documents.select("doc_id", "vector"), work, schema)


def pooled_scores(queries: DataFrame, documents: DataFrame, others_only: bool = False, order: Callable | None = None) -> DataFrame:
    """V3, V6: ``doc_id, score, query_id``: each document's best score over the queries and the first query that has it.

    A task pools its block of queries, so that a row leaves it for a document and block, not for a pair. ``others_only``: a document is
    no query's answer to itself. ``order(scores, query ids)``, if given, names the query instead: that of the smallest number, the first of equals.
    """

    def work(q: Block, d: Block) -> pd.DataFrame:
        at = np.argsort(q.ids, kind="stable")
        ids, got = q.ids[at], products(q, d)[:, at]
        if others_only:
            got = np.where(d.ids[:, None] == ids[None, :], -np.inf, got)
        by = -got if order is None else order(got, ids)
        best, rows = by.argmin(axis=1), np.arange(len(d.ids))
        found = pd.DataFrame({"doc_id": d.ids, "score": got.max(axis=1), "query_id": ids[best], "by": by[rows, best]})
        return found[np.isfinite(found["score"])]

    schema = f"doc_id {_type(documents, 'doc_id')}, score double, query_id {_type(queries, 'query_id')}, by double"
    found = meet(queries.select("query_id", "vector"), documents.select("doc_id", "vector"), work, schema)
    if order is None:
        return pooled(found)
    return found.groupBy("doc_id").agg(F.max("score").alias("score"), F.min(F.struct("by", "query_id"))["query_id"].alias("query_id"))


def owner_scores(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """V5: ``query_id, owner, score``: each owner's best chunk for each query, pooled in the scoring task. ``documents``: doc_id, owner, vector.

    An owner without chunks has no row, which stands for a score of minus infinity: it comes after every other.
    """

    def work(q: Block, d: Block) -> pd.DataFrame:
        owners, at = np.unique(d.more["owner"], return_inverse=True)
        best = np.full((len(owners), len(q.ids)), -np.inf)
        np.maximum.at(best, at, products(q, d))
        return pd.DataFrame({"query_id": np.tile(q.ids, len(owners)), "owner": np.repeat(owners, len(q.ids)), "score": best.ravel()})

    schema = f"query_id {_type(queries, 'query_id')}, owner {_type(documents, 'owner')}, score double"
    asked, chunks = queries.select("query_id", "vector"), documents.select("doc_id", "owner", "vector")
    few = few_queries(asked)
    if few is not None:
        return meet(few, chunks, work, schema).groupBy("query_id", "owner").agg(F.max("score").alias("score"))
    large = written(chunks.groupBy("owner").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select(F.col("owner").alias("__o")), "large_owners")
    is_large = chunks["owner"].eqNullSafe(F.col("__o"))
    found = meet(asked, chunks.join(large, is_large, "left_anti"), work, schema, whole_documents="owner")  # an owner is in one block, so its rows are final
    if large.isEmpty():
        return found
    cut = meet(asked, chunks.join(large, is_large, "left_semi"), work, schema)
    return found.unionByName(cut.groupBy("query_id", "owner").agg(F.max("score").alias("score")))


def list_scores(queries: DataFrame, documents: DataFrame, top: int | None = None, few: Block | None = None) -> DataFrame:
    """``list_no, doc_id, score``: each document's best score over the queries of a list (V15), or of each list each block's ``top``.

    ``queries``: query_id, list_no, vector; ``few``: these rows, if they were read before.
    """

    def work(q: Block, d: Block) -> pd.DataFrame:
        numbers, got = pooled_lists(q, d)
        if top and top < len(d.ids):
            order = np.argsort(d.ids, kind="stable")
            at = order[np.argsort(-got[order], axis=0, kind="stable")[:top]]
            return pd.DataFrame({"list_no": np.tile(numbers, len(at)), "doc_id": d.ids[at].ravel(), "score": np.take_along_axis(got, at, 0).ravel()})
        return pd.DataFrame({"list_no": np.tile(numbers, len(d.ids)), "doc_id": np.repeat(d.ids, len(numbers)), "score": got.ravel()})

    schema = f"list_no {_type(queries, 'list_no')}, doc_id {_type(documents, 'doc_id')}, score double"
    asked, docs = queries.select("query_id", "list_no", "vector"), documents.select("doc_id", "vector")
    few = few_queries(asked) if few is None else few
    lists = FEW_LISTS + 1 if few is not None else asked.select("list_no").distinct().limit(FEW_LISTS + 1).count()
    if lists > FEW_LISTS:
        return meet(asked if few is None else few, docs, work, schema, "list_no")

    class Pool(Gather):
        """The best scores of a block of documents in each list, whatever a list's size; rounding keeps an order, so the best is rounded."""

        def add(self, state, d: Block, q: Block):
            state, got = state or {}, d.unit @ q.unit.T
            for number in np.unique(q.more["list_no"]):
                best = got[:, q.more["list_no"] == number].max(axis=1)
                state[number] = np.maximum(state[number], best) if number in state else best
            return state

        def finish(self, d: Block, state):
            order = np.argsort(d.ids, kind="stable")
            for number, got in state.items():
                got = np.round(got, DIGITS) + 0.0
                at = order[np.argsort(-got[order], kind="stable")[:top]] if top else order
                yield pd.DataFrame({"list_no": number, "doc_id": d.ids[at], "score": got[at]})

    left, right = _blocks(docs, "doc_id"), _blocks(asked, "query_id")
    return gathered(left, right, ("doc", "query"), asked.count(), _tasks(docs, left.count()), Pool, schema)


def _tasks(frame: DataFrame, blocks: int) -> int:
    return max(1, min(blocks, 4 * frame.sparkSession.sparkContext.defaultParallelism))


@dataclass
class Held:
    """Some lists' scores of all documents in a task, as whole numbers of ``10 ** -DIGITS``: lists by documents in the order they came."""

    numbers: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    n: int = 0

    def orders(self) -> Iterator[tuple[object, np.ndarray]]:
        """For each list its number and the places of all documents among the sorted ids, best first, ties to the smaller id."""
        by_id = np.argsort(self.ids, kind="stable")
        self.ids, bits = self.ids[by_id], int(self.n).bit_length()
        for number, scores_ in zip(self.numbers, self.scores):
            keys = (-scores_[by_id].astype(np.int64) << bits) + np.arange(self.n)
            keys.sort()
            yield number, keys & ((1 << bits) - 1)


class HoldLists(Gather):
    """Blocks of whole lists that meet all documents; ``total`` of them."""

    def __init__(self, total: int):
        self.total = total

    def add(self, state, q: Block, d: Block):
        numbers, got = pooled_lists(q, d)
        state = state or Held(numbers, np.empty(self.total, d.ids.dtype), np.empty((len(numbers), self.total), np.int32))
        state.ids[state.n : state.n + len(d.ids)] = d.ids
        state.scores[:, state.n : state.n + len(d.ids)] = np.rint(got * 10**DIGITS).T
        state.n += len(d.ids)
        return state


def held_lists(queries: DataFrame, documents: DataFrame, make: Callable[[int], Gather], schema: str) -> DataFrame | None:
    """Whole orders where they are made: blocks of whole lists meet all documents in a task, which sorts each list by itself.

    ``queries``: query_id, list_no, vector. None if a list has over ``BLOCK`` queries or there are over ``MOST_HELD`` documents.
    """
    docs, asked = documents.select("doc_id", "vector"), queries.select("query_id", "list_no", "vector")
    n = docs.count()
    sizes = asked.groupBy("list_no").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    if n > MOST_HELD or (sizes[1] or 0) > BLOCK:
        return None
    size = max(1, min(BLOCK, CELLS // max(n, 1), (sizes[0] or 0) // (2 * docs.sparkSession.sparkContext.defaultParallelism)))
    left = _blocks(asked, "query_id", "list_no", size)
    return gathered(left, _blocks(docs, "doc_id"), ("query", "doc"), n, _tasks(docs, left.count()), lambda: make(n), schema)


def whole_ranks(queries: DataFrame, documents: DataFrame, scored: bool = True) -> DataFrame:
    """``query_id, doc_id, score, rank`` for every query and document; no pair is shuffled or written.

    Without ``scored`` there is no score, and a task gives the rows of its queries document by document, which files hold in little more than
    half the bytes: only the rank is then without an order.
    """

    class Ranks(HoldLists):
        def finish(self, q: Block, state: Held):
            for at, (number, places_) in enumerate(state.orders()):
                if scored:
                    by_id = np.sort(-state.scores[at], kind="stable")  # scores in order are the sorted scores
                    yield pd.DataFrame({"query_id": number, "doc_id": state.ids[places_], "score": -by_id / 10**DIGITS + 0.0, "rank": np.arange(1, state.n + 1)})
                else:
                    state.scores[at, places_] = np.arange(1, state.n + 1)  # ranks by id, where the scores were
            if not scored:
                n, some = len(state.numbers), max(1, ROWS // len(state.numbers))
                for at in range(0, state.n, some):
                    ids, ranks = state.ids[at : at + some], state.scores[:, at : at + some]
                    yield pd.DataFrame({"query_id": np.tile(state.numbers, len(ids)), "doc_id": np.repeat(ids, n), "rank": ranks.T.ravel().astype(np.int64)})

    schema = f"query_id {_type(queries, 'query_id')}, doc_id {_type(documents, 'doc_id')}, {'score double, ' if scored else ''}rank bigint"
    got = held_lists(queries.withColumn("list_no", F.col("query_id")), documents, Ranks, schema)
    if got is None:
        got = full_ranks(scores(queries, documents))
        got = got if scored else got.drop("score")
    return got


def fused_whole(queries: DataFrame, documents: DataFrame, k: int = RRF_K) -> DataFrame | None:
    """V7, V9: every document's place in the fused order of whole lists, ``item, points, best_list, rank``, as ``fuse`` gives it; None where ``held_lists`` is.

    A task adds up the points of its lists, so one row leaves it for a document.
    """

    class Points(HoldLists):
        ids = None

        def finish(self, q: Block, state: Held):
            for number, places_ in state.orders():
                if self.ids is None:
                    self.ids = state.ids
                    self.points, self.pos, self.list_no = np.zeros(state.n), np.full(state.n, np.iinfo(np.int64).max), np.full(state.n, number)
                    self.first, self.in_first, self.zero = None, None, None
                pos = np.empty(state.n, np.int64)
                pos[places_] = np.arange(1, state.n + 1)
                self.points += 1 / (k + pos)
                better = (pos < self.pos) | (pos == self.pos) & (number < self.list_no)
                self.pos[better], self.list_no[better] = pos[better], number
                if self.first is None or number < self.first:
                    self.first, self.in_first = number, pos
                if number == 0:
                    self.zero = pos
            yield from ()

        def end(self):
            if self.ids is not None:
                zero = pd.Series(pd.NA, index=range(len(self.ids)), dtype="Int64") if self.zero is None else self.zero
                yield pd.DataFrame({"item": self.ids, "points": self.points, "pos": self.pos, "list_no": self.list_no, "first": self.first, "in_first": self.in_first, "zero": zero})

    number = _type(queries, "list_no")
    schema = f"item {_type(documents, 'doc_id')}, points double, pos bigint, list_no {number}, first {number}, in_first bigint, zero bigint"
    found = held_lists(queries, documents, Points, schema)
    if found is None:
        return None
    got = found.groupBy("item").agg(F.round(F.sum("points"), 12).alias("points"), F.min(F.struct("pos", "list_no"))["list_no"].alias("best_list"), F.min("zero").alias("__in_first"), F.min(F.struct("first", "in_first")).alias("__seen"))
    return ranked(got, [], [F.desc("points"), F.asc_nulls_last("__in_first"), F.col("__seen")]).drop("__in_first", "__seen")


def pooled_lists(q: Block, d: Block) -> tuple[np.ndarray, np.ndarray]:
    """The lists among the queries, and the best score in each (columns) of each document."""
    order = np.argsort(q.more["list_no"], kind="stable")
    numbers, starts = np.unique(q.more["list_no"][order], return_index=True)
    got = products(q, d)
    return numbers, got if len(numbers) == len(order) and (order[:-1] < order[1:]).all() else np.maximum.reduceat(got[:, order], starts, axis=1)


def places(scores_: np.ndarray, ids: np.ndarray, wanted: np.ndarray, wanted_ids: np.ndarray) -> np.ndarray:
    """How many rows come before each wanted (score, id) by score, then smaller id: in each column by itself.

    ``scores_``: rows by lists; ``wanted``: wanted by lists; ids of the rows and of the wanted. One ``searchsorted`` a list.
    """
    order = np.argsort(ids, kind="stable")
    place = np.searchsorted(ids[order], wanted_ids, "left")
    n, scale = len(ids) + 1, 10**DIGITS
    keys = np.sort(-np.rint(scores_[order] * scale).astype(np.int64) * n + np.arange(len(ids))[:, None], axis=0)
    asked = -np.rint(wanted * scale).astype(np.int64) * n + place[:, None]
    return np.stack([np.searchsorted(keys[:, i], asked[:, i], "left") for i in range(keys.shape[1])], axis=1)


def top_ranks(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each query by score, then doc_id. Spark keeps ``top`` rows a query and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= top)


def full_ranks(found: DataFrame, key: str = "query_id") -> DataFrame:
    """The whole order of each query (``top`` 0 means all), ranked without a single task for a query."""
    return ranked(found, [key], [F.desc("score"), F.col("doc_id")])


def pooled(found: DataFrame) -> DataFrame:
    """V3, V6: each document's best score over the queries and the first query that has it."""
    best = F.max(F.struct(F.col("score"), (-F.col("query_id")).alias("q"))).alias("b")
    return found.groupBy("doc_id").agg(best).select("doc_id", F.col("b.score").alias("score"), (-F.col("b.q")).alias("query_id"))


def fuse(lists: DataFrame, k: int = RRF_K, few: bool = False) -> DataFrame:
    """Reciprocal rank fusion of ``list_no, pos, item``.

    ``points`` sum 1 / (k + pos); ``best_list`` is that with the smallest position, the first of equals. ``rank`` orders by
    points, then position in list 0, then first appearance; ``few`` items, of a stated bound, are ordered in one task.
    """
    place = F.struct(F.col("pos"), F.col("list_no"))
    seen = F.struct(F.col("list_no"), F.col("pos"))
    got = lists.groupBy("item").agg(
        F.round(F.sum(1 / (k + F.col("pos"))), 12).alias("points"),
        F.min(place)["list_no"].alias("best_list"),
        F.min(F.when(F.col("list_no") == 0, F.col("pos"))).alias("__in_first"),
        F.min(seen).alias("__seen"),
    )
    order = [F.desc("points"), F.asc_nulls_last("__in_first"), F.col("__seen")]
    out = got.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")) if few else ranked(got, [], order)
    return out.drop("__in_first", "__seen")


def cap_per_group(order: DataFrame, group: str, rank: str, cap: int, top: int) -> DataFrame:
    """The first ``top`` rows by rank with at most ``cap`` of a group; rows of a null group are never capped, cap 0 is none.

    Adds ``chosen`` and ``capped``: held back before the last chosen row. Rows after that one are neither.
    """
    if top <= 0:
        return order.withColumns({"chosen": F.lit(False), "capped": F.lit(False)})
    in_group = F.row_number().over(Window.partitionBy(group).orderBy(rank))
    if cap:
        named = order.filter(F.col(group).isNotNull()).withColumn("__n", in_group).filter(F.col("__n") <= cap).drop("__n")
        free = named.unionByName(order.filter(F.col(group).isNull()))
    else:
        free = order
    chosen = written(free.orderBy(rank).limit(top).select(F.col(rank).alias("__rank")), "chosen")  # at most ``top`` rows
    n, last = chosen.agg(F.count("*"), F.max("__rank")).first()
    open_end = n < top
    marked = order.join(F.broadcast(chosen), order[rank] == chosen["__rank"], "left")
    is_chosen = F.col("__rank").isNotNull()
    before = F.lit(True) if open_end else F.col(rank) < last
    return marked.withColumns({"chosen": is_chosen, "capped": ~is_chosen & before}).drop("__rank")


def rerank(order: DataFrame, rank: str, conflicts: str) -> DataFrame:
    """Fewer conflicts first, then the old order; ``before`` keeps the old rank and no row goes."""
    moved = order.withColumn("before", F.col(rank)).drop(rank)
    return ranked(moved, [], [F.size(conflicts), F.col("before")], rank)


def pushed_out(reranked: DataFrame, conflicts: str, top: int) -> DataFrame:
    """rows that were in the top before, have conflicts, and were neither judged nor capped."""
    kept = (F.size(conflicts) > 0) & (F.col("before") <= top) & ~F.col("judged") & ~F.col("capped")
    return reranked.filter(kept)


def boundary(rows: DataFrame) -> DataFrame:
    """The last judged row, the first that is neither judged nor capped, and the gap between their scores."""
    last = F.max(F.when(F.col("judged"), F.struct("rank", "key", "score"))).alias("l")
    first = F.min(F.when(~F.col("judged") & ~F.col("capped"), F.struct("rank", "key", "score"))).alias("f")
    return rows.agg(last, first).select(F.col("l.key").alias("last_key"), F.col("f.key").alias("first_key"), (F.col("l.score") - F.col("f.score")).alias("gap"))


def best_with_ties(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every row that has its key's largest value."""
    return rows.withColumn("__r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(value)))).filter("__r = 1").drop("__r")


def pool_candidates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's smallest rank over the variants and how many variants have it."""
    return rows.groupBy(*keys).agg(F.min("rank").alias("best_rank"), F.count_distinct("variant").alias("variants"))
