"""All rows on one key: the work spreads over tasks, and results stay those of the plain definition."""

import random
import time

from pyspark.sql import functions as F

from tessera.operators import dedupe, gaps, metrics
from tessera.session import running_sum


def test_running_sum_spreads_one_key(spark):
    frame = spark.range(4000).select(F.lit("hot").alias("k"), F.xxhash64("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = running_sum(frame, ["k"], [F.col("o")], "v", "s")
    total = 0
    for r in sorted(got.collect(), key=lambda r: r.o):
        assert r.s == total
        total += r.v
    sizes = [len(p) for p in frame.repartitionByRange("k", "o").rdd.glom().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_concordance_of_one_key(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(4), float(rng.randrange(40))) for _ in range(300)]
    pairs = [(x, y) for x in rows for y in rows if x[1] > y[1]]
    want = sum(0.5 if x[2] == y[2] else x[2] > y[2] for x, y in pairs) / len(pairs)
    (got,) = metrics.concordance(spark.createDataFrame(rows, "k string, grade int, score double"), "k").collect()
    assert abs(got.concordance - want) < 1e-12 and got.pairs == len(pairs)


def test_place_keys_are_same_place(spark):
    cities = [None, "", "--", "U", "ut", "UT", "Utr", "Utre", "Utrecht", "Utrecht Oost", "A", "As", "Assen", "'s-Gravenhage", "s"]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cities)], "i int, c string")
    found, asked = dedupe.place_keys(F.col("c"))
    other = frame.select(F.col("i").alias("j"), F.col("c").alias("d"), found.alias("f"))
    both = frame.select("i", "c", asked.alias("a")).crossJoin(other).select("i", "j", F.arrays_overlap("a", "f").alias("x"), F.coalesce(dedupe.same_place(F.col("c"), F.col("d")), F.lit(False)).alias("y"))
    assert both.filter("x <> y").collect() == []


def test_one_content_with_many_cities(spark):
    """A hundred thousand cities of one text: no list of them is made, and each is kept but for one prefix."""
    rows = spark.range(100_000).select(F.col("id").alias("position"), F.concat(F.lit("l"), "id").alias("label"), F.lit("same").alias("content"), F.concat(F.lit("city "), "id").alias("city"))
    last = spark.createDataFrame([(200_000, "x", "same", "cit"), (200_001, "y", "same", "Delft"), (200_002, "z", "same", None)], "position bigint, label string, content string, city string")
    got = dedupe.keep_first(rows.unionByName(last))
    assert got.filter("not kept").select("position", "twin").collect() == [(200_000, 0), (200_002, 0)] and got.count() == 100_003


def test_terms_that_share_a_token(spark):
    began = time.perf_counter()
    terms = spark.range(100_000).select(F.concat(F.lit("azure t"), "id").alias("term")).unionByName(spark.createDataFrame([("azure",), ("azure t5 x",)], "term string"))
    got = gaps.merged_terms(terms)
    assert got.filter("host <> 'azure'").count() == 0 and got.count() == 100_002
    assert time.perf_counter() - began < 100
