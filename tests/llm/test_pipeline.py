import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns, name
        after = docs.count()
        assert after <= before
        before = after
    assert docs.filter(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == before


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    nulls = docs.limit(20).withColumn("doc_id", F.lit(None).cast("bigint"))
    shared = docs.filter("doc_id between 30 and 40").withColumn("doc_id", F.lit(5).cast("bigint"))
    long = docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("bigint"), "text": F.repeat("text", 400)})
    odd = docs.unionByName(docs.limit(50)).unionByName(nulls).unionByName(shared).unionByName(long)
    groups = simhash.near_duplicates(odd.withColumn("doc_id", F.monotonically_increasing_id())).select("component_id").distinct().count()
    kept = corpus_pipeline.drop_near_duplicates(spark, odd, FOLDER)
    assert kept.count() == groups and kept.filter("doc_id is null").count() == 0


def test_packed_rows_hold_their_ids(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(30)
    rows = corpus_pipeline.pack(spark, docs, FOLDER).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_awkward_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    odd = docs.withColumns({"stats": F.lit(1), "secrets": F.lit("s"), "kept": F.lit(True), "rest": F.lit(2), "__id": F.lit(3)})
    odd = odd.unionByName(odd.limit(1).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("bigint"), "n_chars": F.lit(None).cast("bigint")}))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.limit(0), FOLDER).count() == 0
        odd = stage(spark, odd, FOLDER)
        assert odd.columns[-5:] == ["stats", "secrets", "kept", "rest", "__id"] and odd.filter("rest = 2").count() == odd.count()
    corpus_pipeline.STAGES[-1][1](spark, odd, FOLDER).collect()
