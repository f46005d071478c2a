"""Readers (S1-S11, S22, S24-S26 of the survey). Network sources arrive as tables of payloads; ``postings`` transforms them."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import latest

ADVERT = (
    "source string, source_id string, url string, title string, company string, city string, country string, "
    "posted_at timestamp, fetched_at timestamp, text string, raw string"
)
DETAILS = (
    "struct<title:string,company:string,city:string,work_mode:string,hours_min:int,hours_max:int,salary_min:double,salary_max:double,"
    "salary_period:string,salary_note:string,education_level:string,experience_years_min:int,skills:array<string>,"
    "languages_required:array<string>,contract_type:string>"
)
EXTRACTED = f"key string, model string, details {DETAILS}, extracted_at timestamp"


def adverts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line, a file a source; blank lines are skipped. Adds ``key`` and the file's stem."""
    rows = spark.read.schema(ADVERT).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), "([^/]+?)\\.[^.]*$", 1)
    return rows.select("*", stem.alias("stem")).withColumn("key", F.concat_ws(":", "source", "source_id"))


def details(spark: SparkSession, path: str) -> DataFrame:
    """S3, K2, SO5: the extraction logs of all sources; of a key the last entry of the last source counts."""
    rows = spark.read.schema(EXTRACTED).json(path).select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    return latest(rows, ["key"], [F.desc("file"), F.desc("line")]).drop("file", "line")


def samples(spark: SparkSession, texts: str, sidecars: str | None = None) -> DataFrame:
    """Text files with JSON beside them, joined by stem; without a title the first line is the title."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), "([^/]+?)\\.[^.]*$", 1)
    rows = spark.read.text(texts, wholetext=True).select(stem.alias("stem"), F.col("value").alias("text"))
    if sidecars:
        extra = spark.read.schema(f"details {DETAILS}").option("multiLine", True).json(sidecars).select(stem.alias("stem"), "details")
        rows = rows.join(extra, "stem", "left")
    else:
        rows = rows.withColumn("details", F.lit(None).cast(DETAILS))
    return rows.withColumn("title", F.coalesce("details.title", F.split("text", "\n")[0]))


def published(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """A published set; a model is a partition, so only its files are read."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("model") == model) if model else rows


def commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and ``#`` comment lines."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


def settings(text: str) -> dict:
    """A small TOML document, read on the driver."""
    return tomllib.loads(text)


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of labelled queries, one row a relevant document."""
    rows = spark.read.schema("split string, query string, relevant array<string>, judged array<string>, note string").option("multiLine", True).json(path)
    return rows.select("split", "query", F.explode_outer("relevant").alias("doc_id"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Run reports ordered by start and attempt; the attempt is the number at the end of the file's stem, 1 without one."""
    rows = spark.read.schema("run_started timestamp, searches array<struct<source:string,search:string,status:string,listed:int,kept:int,detail:string>>").option("multiLine", True).json(path)
    attempt = F.coalesce(F.nullif(F.regexp_extract(F.col("_metadata.file_name"), "-(\\d+)_fetch\\.json$", 1), F.lit("")).cast("int"), F.lit(1))
    return rows.select("run_started", attempt.alias("attempt"), "searches").orderBy("run_started", "attempt")


def vectors(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored vectors of the given keys."""
    return table.join(keys.select("key").distinct(), "key", "left_semi")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files with size and MD5 as object stores give it."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.base64(F.unhex(F.md5("content"))).alias("md5"))


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """One JSON object of entries by key, as rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "entry")).select("key", "entry.*")


def corpus(adverts: DataFrame, state: DataFrame | None = None, now=None, open_only: bool = False) -> DataFrame:
    """The adverts of a corpus, only those still open if asked."""
    if not open_only:
        return adverts
    from tessera.streaming.sightings import is_open

    return is_open(adverts, state, now).filter("open").drop("open")
