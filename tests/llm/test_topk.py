import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import topk


def brute(vectors, k):
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors}
    out = {}
    for q in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def found(frame, **settings):
    v = frame.select("vec_id", topk.whole_numbers(F.col("embedding")).alias("vector"))
    out = {}
    for r in topk.top_k(v, F.col("vec_id") % 20 == 0, **settings).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("slab", [4, 8192])
def test_like_brute_force(spark, slab):
    rng = random.Random(8)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    vectors += [(300 + i, vectors[7][1]) for i in range(60)]  # ties
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    assert found(frame, k=5, block=16, slab=slab) == brute(vectors, 5)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [1e9, -1e9])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found(frame) == brute([(0, [1.0, 0.5]), (6, [0.5, 0.5]), (7, [1e9, -1e9])], 20)
    assert found(frame.limit(0)) == {}


def test_the_driver_holds_one_slab(spark, monkeypatch):
    frame = spark.createDataFrame([(20 * i, [float(i), 1.0]) for i in range(64)], "vec_id bigint, vector array<double>")
    frame = frame.select("vec_id", topk.whole_numbers(F.col("vector")).alias("vector"))
    read, seen = [], []
    rows, send = type(frame).toLocalIterator, type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(frame), "toLocalIterator", lambda self, *a: (read.append(r) or r for r in rows(self, *a)))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: seen.append(len(read)) or send(self, value))
    assert topk.top_k(frame, F.col("vec_id") % 20 == 0, k=2, block=4, slab=8).count() == 128
    assert seen[0] <= 3 < len(read)  # two blocks fill a slab; a third shows that it is full


def test_repeated_ids_and_many_slabs(spark, monkeypatch):
    """Rows of one id ask each and are candidates of each other; tasks send on at most k rows for each query of each slab."""
    rng = random.Random(4)
    vectors = [(i % 240, [float(rng.randrange(-9, 10)) for _ in range(4)]) for i in range(480)]
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").select("vec_id", topk.whole_numbers(F.col("embedding")).alias("vector"))
    paths, old = [], topk.new_path
    monkeypatch.setattr(topk, "new_path", lambda s, name: paths.append(old(s, name)) or paths[-1])
    rows = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=7, block=16, slab=3).collect()
    want = []
    for n, (q, v) in enumerate(vectors):
        if q % 20 == 0:
            scores = sorted((-sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w)), i) for m, (i, w) in enumerate(vectors) if m != n)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:7])]
    assert sorted(tuple(r)[:4] for r in rows) == sorted(want) and len({r.query_row for r in rows}) == 24
    sent = spark.read.parquet(paths[-1])
    assert sent.count() <= 4 * 24 * 7 * 2
