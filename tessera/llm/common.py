"""Helpers shared by the corpus operators: the shared folder, written tables, names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir, written

__all__ = ["SPACES", "SPACE_CLASS", "let", "new_path", "running", "spans_of", "shared_dir", "small_batches", "words_of", "written"]

#: Characters that separate words: \x20 and \x09-\x0D, as Spark and Java regex ranges.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Few rows and bytes to an Arrow batch: texts may be megabytes long, and a batch is held whole. The same for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine, zero: Column) -> Column:
    """For each of n values what ``combine`` makes of those before it. Square-root steps: some n * sqrt(n) copies, not n * n."""
    def add(acc, v):
        return F.struct(combine(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def scan(given: Column) -> Column:
        values, step = given["values"], given["step"]
        starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1, step)).otherwise(F.array().cast("array<int>"))

        def chunk(acc, start):
            inner = F.aggregate(F.slice(values, start + 1, step), F.struct(acc["at"].alias("at"), F.array().cast("array<bigint>").alias("out")), add)
            return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        begin = F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
        return F.flatten(F.aggregate(starts, begin, chunk)["out"])

    return let(let(values, lambda v: F.struct(v.alias("values"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int")).alias("step"))), scan)


def spans_of(text: Column, spans: Column, block: int = 1024) -> Column:
    """The texts of spans ``start, stop`` (code points, end exclusive). A text is cut into blocks once, so that a span far behind costs no more than one in front."""

    def cut(blocks: Column) -> Column:
        def one(s: Column) -> Column:
            first = F.floor(s["start"] / block).cast("int")
            several = F.floor((s["stop"] - 1) / block).cast("int") - first + 1
            near = F.array_join(F.slice(blocks, first + 1, several), "")
            return F.when(s["stop"] > s["start"], F.substring(near, (s["start"] - first * block + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))).otherwise(F.lit(""))

        return F.transform(spans, one)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)), cut)
