"""Sinks (K1-K12 of the survey) over files: appends, replacements, upserts, suffixes, retention, migrations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import latest, new_folder, ranked


def append_new(rows: DataFrame, stored: DataFrame, key: str, path: str) -> None:
    """K1, Q3: appends the rows whose key is not stored, as JSON lines."""
    rows.join(stored.select(key).distinct(), key, "left_anti").write.mode("append").json(path)


def publish(rows: DataFrame, details: DataFrame, path: str, model: str) -> None:
    """K3: replaces what is published for a model; a row without details stops it before anything is written."""
    missing = rows.join(details, "key", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"not extracted, e.g. {missing[0]['key']}")
    out = rows.join(details, "key").withColumn("model", F.lit(model))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def upserted(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """K4, Q2: new rows win by key; others stay."""
    return stored.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def patched(stored: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Q2: only the stated fields of a patch change."""
    p = patch.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in patch.columns if c != key])
    changed = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in patch.columns if c != key}
    return stored.join(p, stored[key] == F.col("__k"), "left").select(*[changed.get(c, F.col(c)).alias(c) for c in stored.columns])


def suffixed(rows: DataFrame, stem: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """K5, Q13: ``stem``, ``stem-2``, ... in order, going on after the names that are taken; a stem may hold any share of the rows."""
    placed, n = ranked(rows, [stem], [F.col(order)], "__n"), F.col("__n")
    if taken is not None:
        used = taken.groupBy(F.regexp_replace("name", "-\\d+$", "").alias("__s")).agg(F.count("*").alias("__used"))
        placed = placed.join(used, placed[stem] == F.col("__s"), "left")
        n = n + F.coalesce("__used", F.lit(0))
    return placed.withColumn("__n", n).withColumn("name", F.when(F.col("__n") == 1, F.col(stem)).otherwise(F.concat_ws("-", stem, F.col("__n")))).drop("__n", "__s", "__used")


def changed_files(local: DataFrame, remote: DataFrame, allowed: Column) -> DataFrame:
    """K7: allowed files that are new or have another MD5."""
    return local.filter(allowed).join(remote, ["path", "md5"], "left_anti")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A delete, or one step of a cascade."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def retained(rows: DataFrame, at: str, now: Column, days: int = 90) -> DataFrame:
    """Rows of the last days."""
    return rows.filter(F.col(at) >= now - F.expr(f"interval {days} days"))


def migration_state(files: DataFrame, applied: DataFrame) -> DataFrame:
    """K9, Q12: each migration as applied, pending, changed (another checksum) or unknown (applied, but no file)."""
    a = applied.select("number", F.col("checksum").alias("__c"))
    state = F.when(F.col("__c").isNull(), "pending").when(F.col("checksum").isNull(), "unknown").when(F.col("checksum") != F.col("__c"), "changed").otherwise("applied")
    return files.join(a, "number", "full_outer").select("number", state.alias("state"))


def cached(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """A vector cache after a batch; of a key the newest counts. Both: key, vector, at."""
    return latest(stored.unionByName(batch), ["key"], [F.desc("at")])


def bucketed(rows: DataFrame, name: str, buckets: int = 32) -> DataFrame:
    """A store of ``key`` and more as a table in buckets by key, sorted in each, in the shared folder. What is dealt in that many
    parts by key is written as it is."""
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "key").sortBy("key").option("path", new_folder(spark, name)).saveAsTable(table)
    return spark.table(table)


def merged(store: DataFrame, batch: DataFrame, buckets: int = 32) -> DataFrame:
    """The store's rows, replaced or joined by those of a batch with the same columns. Only the batch is shuffled, to the store's buckets."""
    fresh = batch.dropDuplicates(["key"]).repartition(buckets, "key")
    theirs = fresh.select(F.col("key").alias("__key"), *[F.col(c).alias(f"__{c}") for c in batch.columns if c != "key"])
    joined = store.hint("merge").join(theirs, store["key"] == F.col("__key"), "full_outer")
    new = F.col("__key").isNotNull()
    return joined.select(F.coalesce("key", "__key").alias("key"), *[F.when(new, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in store.columns if c != "key"])


def looked_up(store: DataFrame, asked: DataFrame) -> DataFrame:
    """The store's rows for some keys; the keys go to the buckets."""
    return store.hint("merge").join(asked.select("key").distinct(), "key")


def distinct_vectors(documents: DataFrame) -> DataFrame:
    """One row for each different document."""
    return documents.dropDuplicates(["key"])


def one_active(versions: DataFrame, owner: str, at: str) -> DataFrame:
    """Q5: the newest version of an owner is active, no other."""
    n = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc(at)))
    return versions.withColumn("active", n == 1)
