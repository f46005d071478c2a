"""Session helpers: table loading, written intermediate tables, and ranks that need no single task."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where nothing is named, a local session makes and sets one of this machine; on a cluster that is an error, since every executor would
    write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = Path(tempfile.mkdtemp(prefix="spark-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which ends its lineage."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based rank of each row among those of its keys, whatever a key's size.

    Rows are dealt by range of (keys, order), so that a large key spreads over many partitions; a rank is the row's place
    in its partition plus the rows of its key in the partitions before. The order has to tell all rows of a key apart.
    """
    dealt = df.repartitionByRange(*keys, *order) if keys or order else df
    parts = written(dealt.withColumn("__part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    for k in keys:
        firsts = firsts.withColumnRenamed(k, f"__{k}")
    inside = Window.partitionBy(*keys, "__part").orderBy(*order)
    rows = parts.withColumn("__rn", F.row_number().over(inside))
    on = rows["__part"] == firsts["__part"]
    for k in keys:
        on = on & rows[k].eqNullSafe(firsts[f"__{k}"])
    return rows.join(firsts, on).select(*[rows[c] for c in df.columns], (F.col("__first") + F.col("__rn")).cast("bigint").alias(name))


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the earlier rows of a row's keys, whatever a key's size: ``ranked`` with sums in place of counts.

    A row's sum is that of its partition so far plus the totals of its key in the partitions before. The order has to tell all rows of a key apart.
    """
    parts = written(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "summed")
    totals = parts.groupBy(*keys, "__part").agg(F.sum(value).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = rows["__part"] == firsts["__p"]
    for k in keys:
        on = on & rows[k].eqNullSafe(firsts[f"__{k}"])
    return rows.join(firsts, on).select(*[rows[c] for c in df.columns], (F.col("__first") + F.col("__inside")).alias(name))


def narrowed(df: DataFrame, value: Column, keys: DataFrame, key: str, most_bits: int = 20) -> DataFrame:
    """The rows whose value may be among the keys, before they are shuffled: all that are, and by chance a few others.

    Keys are told apart by up to ``most_bits`` bits of a hash, 32 times as many as there are keys, so no more than ``2**most_bits`` numbers are broadcast
    however many keys there are; of some millions of keys on most rows pass, and the join that follows decides as it does anyway.
    """
    space = F.lit(1 << min(most_bits, keys.count().bit_length() + 5)).cast("bigint")
    may = keys.select(F.pmod(F.xxhash64(key), space).alias("__may")).distinct()
    return df.withColumn("__may", F.pmod(F.xxhash64(value), space)).join(F.broadcast(may), "__may", "left_semi").drop("__may")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first by ``order`` (W1). Spark keeps one row a key and task before the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")
