"""Accounts, links and switches (F13, Q4, F21, A41, O3, V12, SO6 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unexpired(rows: DataFrame, now: Column, until: str = "expires_at") -> DataFrame:
    """rows that are valid for some time yet; a null end is none."""
    return rows.filter(F.col(until) > now)


def redeemable(links: DataFrame, now: Column) -> DataFrame:
    """links that were not used and have not expired."""
    return unexpired(links.filter("used_at is null"), now)


def active(versions: DataFrame) -> DataFrame:
    """the active version of each owner."""
    return versions.filter("active")


def invited(users: DataFrame, links: DataFrame, asked: DataFrame, now: Column, until: Column) -> tuple[DataFrame, DataFrame]:
    """Q4: the users and the login links after invitations; both tables are new, to be written in place of the old.

    ``users``: user_id, email, name; ``links``: user_id, token, used_at, expires_at; ``asked``: email, name, token. Accounts are found by email in
    any case and keep their name; a missing one is made, with a hash of the email as its id. A person's unused links go when a new one is made.
    """
    mail = F.lower("email").alias("mail")
    first = asked.groupBy(mail).agg(F.min(F.struct("token", "name")).alias("a")).select("mail", "a.token", "a.name")
    known = users.select("user_id", mail)
    made = first.join(known, "mail", "left_anti").select(F.xxhash64("mail").alias("user_id"), F.col("mail").alias("email"), "name")
    everyone = users.select("user_id", "email", "name").unionByName(made)
    new = first.join(everyone.select("user_id", mail), "mail").select("user_id", "token", F.lit(None).cast("timestamp").alias("used_at"), until.alias("expires_at"))
    waiting = links.filter("used_at is null").join(new.select("user_id"), "user_id", "left_anti")
    return everyone, links.filter("used_at is not null").unionByName(waiting).unionByName(new)


def enabled_sources(config: DataFrame, boards: tuple[str, ...]) -> DataFrame:
    """a source of company boards if it lists one, any other if it is switched on. ``config``: source, companies, enabled."""
    listed = F.col("source").isin(*boards) & (F.coalesce("companies", F.lit(0)) > 0)
    return config.filter(listed | (~F.col("source").isin(*boards) & F.coalesce("enabled", F.lit(False)))).select("source").distinct()


def about(problem: Column, source: Column) -> Column:
    """whether a report's problem line belongs to a source: ``source (`` or ``source:`` begins it."""
    return F.startswith(problem, F.concat(source, F.lit(" ("))) | F.startswith(problem, F.concat(source, F.lit(":")))


def ceiling(fallback: Column, configured: Column) -> Column:
    """The smaller of the two; without one of its own (or with 0) a source has the fallback."""
    return F.least(fallback, F.nullif(configured, F.lit(0)))


def newest_first(rows: DataFrame, at: str, key: str) -> DataFrame:
    """O3: by time, then by id in the order of its bytes, both descending; Spark compares strings by bytes."""
    return rows.orderBy(F.desc(at), F.desc(F.col(key).cast("string")))


def pack_floats(vector: Column) -> Column:
    """A vector as 32-bit floats."""
    return vector.cast("array<float>")


def compound(documents: DataFrame, more: DataFrame) -> DataFrame:
    """SO6: two sources of documents together, equal ones kept."""
    return documents.unionByName(more, allowMissingColumns=True)
