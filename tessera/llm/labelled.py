"""Labelled rows for the learners: which ids may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a labels table larger than this, a learner that has to read texts anew takes about so many rows.
MOST_LABELS = 50_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; such rows are never learned from. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def usable(labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, label`` (0 or 1) of the rows to learn from, one for each document, with the least of its labels; rows with a null in either are none."""
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
    return rows.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))


def sample(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """About ``most`` of the rows by a hash of the id, or all if they are fewer."""
    n = labels.count()
    million = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    return labels if n <= most else labels.filter(million < int(1_000_000 * most / n))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """``text, label`` of a bounded sample of labelled documents; its ids, some 16 bytes each, are broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample(usable(labels), most)), "doc_id")
