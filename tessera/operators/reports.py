"""Funnels, overviews, comparisons, spending and views (A1-A3, A10-A14, A26-A31, A34-A43, J6, K-, Q-rows of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import board_of, host_of, site_of
from tessera.session import latest

COUNTERS = ("listed", "kept", "dutch", "capped", "out_of_scope", "stored", "known", "duplicate", "dropped_no_text", "dropped_invalid")


def staged_counts(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows loaded and, in order, what each stage loses of what is left; one pass. A stage's column is true for a loss."""
    lost, left = [], F.lit(True)
    for name, drop in stages:
        drop = F.coalesce(drop, F.lit(False))
        lost.append(F.count_if(left & drop).alias(name))
        left = left & ~drop
    return rows.agg(F.count("*").alias("loaded"), *lost, F.count_if(left).alias("left"))


def not_a_vacancy(title: Column) -> Column:
    """open applications."""
    return title.rlike("(?i)^\\s*open\\s+(sollicitatie|application|applications)\\b")


def capped(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """the first ``limit`` rows of a key are kept; rows that a filter dropped do not use up places."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).filter(F.col("__n") <= limit).drop("__n")


def spent(usage: DataFrame, payers: list[str]) -> DataFrame:
    """A2: the sum of each payer, zero for one without rows. ``usage``: paid_by, cost."""
    every = usage.sparkSession.createDataFrame([(p,) for p in payers], "paid_by string")
    return every.join(usage.groupBy("paid_by").agg(F.sum("cost").alias("cost")), "paid_by", "left").select("paid_by", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def spent_by_person(users: DataFrame, usage: DataFrame, since: Column) -> DataFrame:
    """Every user with the month's sums; the date belongs to the join, so users without usage stay."""
    rows = usage.filter(F.col("at") >= since)
    got = rows.groupBy(F.col("user_id").alias("__u")).agg(F.sum(F.when(F.col("paid_by") == "us", F.col("cost"))).alias("ours"), F.sum(F.when(F.col("paid_by") == "them", F.col("cost"))).alias("theirs"), F.count("*").alias("calls"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return users.join(got, users.user_id == got["__u"], "left").select(*users.columns, zero(F.col("ours")).alias("ours"), zero(F.col("theirs")).alias("theirs"), F.coalesce("calls", F.lit(0)).alias("calls"))


def allowance_left(allowance: Column, used: Column) -> Column:
    """What is left, never below 0, to four places."""
    return F.round(F.greatest(allowance - used, F.lit(0.0)), 4)


def share_used(used: Column, limit: Column) -> Column:
    """JS6: percent of the allowance, 100 at most, 0 without one."""
    return F.when(F.coalesce(limit, F.lit(0.0)) > 0, F.least(F.lit(100.0), 100 * used / limit)).otherwise(0.0)


def run_minutes(seconds: Column) -> Column:
    """JS5: at least 1, halves up."""
    return F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5)).cast("int")


def broken_searches(searches: DataFrame) -> DataFrame:
    """A10: broken searches of a run by source, status and detail, with count and first position."""
    return searches.filter("status <> 'ok'").groupBy("source", "status", "detail").agg(F.count("*").alias("n"), F.min("position").alias("first"))


def weak_sources(searches: DataFrame, share: float = 0.3, least: int = 10) -> DataFrame:
    """Sources that listed nothing, or lost over ``share`` of at least ``least`` listed for want of text."""
    s = searches.filter("status = 'ok'").groupBy("source").agg(F.sum("listed").alias("listed"), F.sum("dropped_no_text").alias("no_text"))
    problem = F.when(F.col("listed") == 0, "empty").when((F.col("listed") >= least) & (F.col("no_text") > share * F.col("listed")), "no_text")
    return s.withColumn("problem", problem).filter("problem is not null")


def totals(searches: DataFrame, columns: tuple[str, ...] = COUNTERS) -> DataFrame:
    """A11, JS3: each counter summed, nulls as 0."""
    return searches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def overview(stored: DataFrame, last: DataFrame, configured: DataFrame) -> DataFrame:
    """A12, A13, A40, SO1: a row for every source stored, configured or run, with zeros where it has none.

    ``stored``: source, open, extracted, a flag ``published``, posted_at, fetched_at; ``last``: source, listed,
    dutch, out_of_scope; ``configured``: source, enabled.
    """
    counts = stored.groupBy("source").agg(F.count("*").alias("stored"), F.count_if("open").alias("open"), F.count_if("extracted").alias("extracted"), F.count_if("published").alias("published"), F.max("posted_at").alias("newest"), F.max("fetched_at").alias("last_fetched"))
    runs = last.groupBy("source").agg(F.sum("listed").alias("listed"), F.sum(F.col("dutch") - F.col("out_of_scope")).alias("in_scope"))
    names = reduce(DataFrame.unionByName, [d.select("source") for d in (counts, runs, configured)]).distinct()
    joined = names.join(counts, "source", "left").join(runs, "source", "left").join(configured, "source", "left")
    return joined.fillna(0, ["stored", "open", "extracted", "published", "listed", "in_scope"]).fillna(False, ["enabled"])


def stale(last_fetched: Column, now: Column, hours: int = 36) -> Column:
    """Fetched longer ago than that."""
    return (now.cast("double") - last_fetched.cast("double")) > hours * 3600


def link_counts(links: DataFrame) -> DataFrame:
    """Outbound links by board, with the first example. ``links``: position, link."""
    web = links.filter(F.col("link").rlike("(?i)^https?://"))
    named = web.withColumn("board", F.coalesce(board_of(F.col("link")), F.concat(F.lit("site:"), site_of(host_of(F.col("link"))))))
    return named.groupBy("board").agg(F.count("*").alias("n"), F.min(F.struct("position", "link"))["link"].alias("example"))


def new_boards(found: DataFrame, known: DataFrame) -> DataFrame:
    """Boards that are not known in any case of letters."""
    return found.join(known.select(F.lower("board").alias("__b")).distinct(), F.lower("board") == F.col("__b"), "left_anti")


def board_check(jobs: DataFrame, minimum: int) -> DataFrame:
    """Jobs, Dutch and in-scope counts of a board, and whether it is worth adding. ``jobs``: board, dutch, in_scope."""
    got = jobs.groupBy("board").agg(F.count("*").alias("jobs"), F.count_if("dutch").alias("dutch"), F.count_if(F.col("dutch") & F.col("in_scope")).alias("in_scope"))
    return got.withColumn("accept", F.col("in_scope") >= minimum)


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entered, left, changed or unchanged by key, with the change of fit. Both: key, verdict, fit."""
    o, n = old.select("key", F.col("verdict").alias("old_verdict"), F.col("fit").alias("old_fit")), new.select("key", F.col("verdict").alias("new_verdict"), F.col("fit").alias("new_fit"))
    joined = o.join(n, "key", "full_outer")
    same = F.col("old_verdict").eqNullSafe(F.col("new_verdict")) & F.col("old_fit").eqNullSafe(F.col("new_fit"))
    change = F.when(F.col("old_fit").isNull(), "entered").when(F.col("new_fit").isNull(), "left").when(same, "unchanged").otherwise("changed")
    return joined.withColumns({"change": change, "fit_change": F.col("new_fit") - F.col("old_fit")})


def blockers(old: Column, new: Column, fields: tuple[str, ...]) -> Column:
    """The fields of two stamps that differ; any of them makes the runs' scales different."""
    return F.array_compact(F.array(*[F.when(~old[f].eqNullSafe(new[f]), F.lit(f)) for f in fields]))


def corpus_digest(rows: DataFrame, key: str) -> DataFrame:
    """The first 8 hex digits of SHA-256 over the sorted keys, one a line. The keys of a published corpus pass through one row: the
    reference's digest is of one string, which no smaller parts can make."""
    keys = F.array_join(F.array_sort(F.collect_list(key)), "\n")
    return rows.agg(F.substring(F.sha2(keys, 256), 1, 8).alias("digest"), F.count("*").alias("n"))


def faithfulness(judged: DataFrame, key: str) -> DataFrame:
    """The share of quotes that were found; 1 without quotes. ``judged``: quotes, dropped."""
    got = judged.groupBy(key).agg(F.sum("quotes").alias("quotes"), F.sum("dropped").alias("dropped"))
    return got.withColumn("faithfulness", F.coalesce((F.col("quotes") - F.col("dropped")) / F.nullif(F.col("quotes"), F.lit(0)), F.lit(1.0)))


def marks(decisions: DataFrame) -> DataFrame:
    """A34, J23, ST9: each CV's latest decisions counted by call. ``decisions``: cv, key, at, call."""
    last = latest(decisions, ["cv", "key"], [F.desc("at")])
    return last.groupBy("cv").agg(*[F.count_if(F.col("call") == c).alias(c) for c in ("yes", "maybe", "no")])


def dashboard(run: DataFrame, marked: DataFrame, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """Verdict counts of a run and its best rows, each with its latest mark. ``run``: key, verdict, fit, score."""
    counts = run.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("strong", "possible", "weak")])
    best = run.filter("verdict <> 'weak'").orderBy(F.desc(F.col("verdict") == "strong"), F.desc("fit"), F.desc("score"), "key").limit(top)
    return counts, best.join(latest(marked, ["key"], [F.desc("at")]).select("key", "call"), "key", "left")


def searched(rows: DataFrame, columns: list[str], text: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """F10, JS1: how many rows hold a text in any of the columns, in any case, and the first ``limit``."""
    hits = rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))
    return hits.agg(F.count("*").alias("n")), hits.orderBy("position").limit(limit)


def unpivoted(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JS8, J24: a row for each stated field of a record."""
    return rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")).select(key, "f.field", "f.value").filter("value is not null and value <> ''")
