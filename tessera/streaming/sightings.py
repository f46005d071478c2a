"""Keyed state over nightly loads (ST1-ST15, J7, J8, F6, F20 of the survey): what is still listed, and what has closed.

State is a table ``key, source, first_seen, last_seen, board, closed_at, passed_over``. A night is a batch of rows, and one
merge makes the next state. ``follow`` runs the same merge as a stream with foreachBatch; the state's versions are
written tables, and the pointer to the newest is the last thing a batch writes, so a batch that is run again after a
failure starts from the same version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir

BOARD_SOURCES = ("recruitee", "greenhouse", "smartrecruiters", "overheid", "workday", "careersite")
SEEN_DAYS, AGE_DAYS = 7, 30
STATE = "key string, source string, first_seen timestamp, last_seen timestamp, board string, closed_at timestamp, passed_over string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def seen(state: DataFrame, listed: DataFrame, now: Column) -> DataFrame:
    """ST1, ST2, ST13: what a night listed. ``listed``: key, source, board, elsewhere.

    A listed key moves last_seen, keeps its old board if none is named, and opens again; one only seen elsewhere (a copy of
    it was listed) moves last_seen and stays closed if it was. ``reopened`` marks keys that opened again.
    """
    night = listed.groupBy("key").agg(F.max("source").alias("n_source"), F.max("board").alias("n_board"), F.bool_and("elsewhere").alias("n_elsewhere"))
    joined = state.join(night, "key", "full_outer")
    here = F.col("n_elsewhere").isNotNull()
    opens = here & ~F.col("n_elsewhere")
    return joined.select(
        "key",
        F.coalesce("source", "n_source").alias("source"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(here, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(opens, F.coalesce("n_board", "board")).otherwise(F.col("board")).alias("board"),
        F.when(~F.coalesce(opens, F.lit(False)), F.col("closed_at")).alias("closed_at"),
        "passed_over",
        F.coalesce(opens & F.col("closed_at").isNotNull(), F.lit(False)).alias("reopened"),
    )


def close_missing(state: DataFrame, listed: DataFrame, boards: DataFrame, now: Column) -> DataFrame:
    """ST3, J8: a board that answered in full and listed something closes its open keys that it did not list.

    ``boards``: source, board, ok, complete; ``listed``: key, source, board.
    """
    spoke = boards.filter("ok and complete").join(listed.select("source", "board").distinct(), ["source", "board"], "left_semi").select(F.col("source").alias("__s"), F.col("board").alias("__b"), F.lit(True).alias("__spoke")).distinct()
    keys = listed.select(F.col("key").alias("__k"), F.lit(True).alias("__listed")).distinct()
    joined = state.join(spoke, (state.source == F.col("__s")) & (state.board == F.col("__b")), "left").join(keys, state.key == F.col("__k"), "left")
    gone = F.col("__spoke").isNotNull() & F.col("__listed").isNull() & F.col("closed_at").isNull()
    return joined.withColumn("closed_at", F.when(gone, now).otherwise(F.col("closed_at"))).select(*state.columns)


def close_unseen(state: DataFrame, listed: DataFrame, boards: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """ST4, J7: where every board of a source answered and something was listed, stored keys that no board listed close,
    also those without an entry. ``stored``: key, source.
    """
    answered = boards.groupBy("source").agg(F.bool_and(F.col("ok") & F.col("complete")).alias("all")).filter("all")
    sources = answered.join(listed.select("source").distinct(), "source", "left_semi").select("source")
    gone = stored.join(sources, "source", "left_semi").join(listed.select("key").distinct(), "key", "left_anti").select(F.col("key").alias("__k"), F.col("source").alias("__s")).distinct()
    joined = state.join(gone, state.key == F.col("__k"), "full_outer")
    closed = F.when(F.col("__k").isNotNull(), F.coalesce("closed_at", now)).otherwise(F.col("closed_at"))
    fresh = {"key": F.coalesce("key", "__k"), "source": F.coalesce("source", "__s"), "first_seen": F.coalesce("first_seen", now), "last_seen": F.coalesce("last_seen", now), "closed_at": closed}
    return joined.select(*[fresh.get(c, F.col(c)).alias(c) for c in state.columns])


def pass_over(state: DataFrame, keys: DataFrame, scope: Column, now: Column) -> DataFrame:
    """ST5: marks keys as read and not stored under a scope. ``keys``: key, source."""
    k = keys.select(F.col("key").alias("__k"), F.col("source").alias("__s")).distinct()
    joined = state.join(k, state.key == F.col("__k"), "full_outer")
    fresh = {"key": F.coalesce("key", "__k"), "source": F.coalesce("source", "__s"), "first_seen": F.coalesce("first_seen", now), "last_seen": F.coalesce("last_seen", now), "passed_over": F.when(F.col("__k").isNotNull(), scope).otherwise(F.col("passed_over"))}
    return joined.select(*[fresh.get(c, F.col(c)).alias(c) for c in state.columns])


def known_keys(stored: DataFrame, state: DataFrame, scope: str) -> DataFrame:
    """F20, ST5: keys that need no reading: stored, or passed over under this scope."""
    return stored.select("key").unionByName(state.filter(F.col("passed_over") == scope).select("key")).distinct()


def is_open(adverts: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """F6, ST6, J4: adds ``open``. Boards: not closed. Searches: seen within 7 days or aged 30 days at most."""
    s = state.select(F.col("key").alias("__k"), F.col("last_seen").alias("__seen"), F.col("closed_at").alias("__closed"))
    joined = adverts.join(s, adverts.key == F.col("__k"), "left")
    recent = F.col("__seen") >= now - F.expr(f"interval {SEEN_DAYS} days")
    young = F.coalesce("posted_at", "fetched_at") >= now - F.expr(f"interval {AGE_DAYS} days")
    open_ = F.when(F.col("source").isin(*BOARD_SOURCES), F.col("__closed").isNull()).otherwise(F.coalesce(recent, F.lit(False)) | F.coalesce(young, F.lit(False)))
    return joined.select(*[adverts[c] for c in adverts.columns], open_.alias("open"))


def night(state: DataFrame, listed: DataFrame, boards: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """One night in order: listings, boards, sources."""
    after = seen(state, listed.withColumn("elsewhere", F.col("elsewhere")), now)
    own = listed.filter("not elsewhere")
    return close_unseen(close_missing(after, own, boards, now), own, boards, stored, now)


# ---- refusals, schedules ----------------------------------------------------
def cooldown_hours(strikes: Column, first: int = 12, most_days: int = 7) -> Column:
    """ST7: 12 hours, doubled with each strike, a week at most."""
    return F.least(first * F.pow(F.lit(2.0), strikes - 1), F.lit(24.0 * most_days))


def refused(sites: DataFrame, refusals: DataFrame, now: Column) -> DataFrame:
    """ST7: adds a strike to each refusing site; it waits for the longer of the schedule and what it asked for.

    ``sites``: site, strikes, blocked_until, reason; ``refusals``: site, reason, retry_after (seconds).
    """
    r = refusals.groupBy("site").agg(F.max(F.struct("retry_after", "reason")).alias("r")).select("site", F.col("r.reason").alias("n_reason"), F.coalesce("r.retry_after", F.lit(0.0)).alias("asked"))
    joined = sites.join(r, "site", "full_outer")
    strikes = F.coalesce("strikes", F.lit(0)) + F.when(F.col("asked").isNotNull(), 1).otherwise(0)
    wait = F.greatest(cooldown_hours(strikes) * 3600, F.col("asked"))
    until = F.when(F.col("asked").isNotNull(), F.timestamp_seconds(now.cast("double") + wait)).otherwise(F.col("blocked_until"))
    return joined.select("site", strikes.alias("strikes"), until.alias("blocked_until"), F.coalesce("n_reason", "reason").alias("reason"))


def forgiven(sites: DataFrame, answered: DataFrame, refusals: DataFrame) -> DataFrame:
    """ST7, SO2: sites that answered and did not refuse lose their strikes."""
    clean = answered.select("site").join(refusals.select("site"), "site", "left_anti")
    return sites.join(clean, "site", "left_anti")


def next_run(now: Column, hour: int, zone: str = "Europe/Amsterdam", weekdays: tuple[int, ...] = tuple(range(7))) -> Column:
    """ST11: the first whole UTC hour after this one whose local hour and weekday (Monday 0) are in the schedule.

    That hour follows from the offset of the next hour, unless the offset has changed by then; then the hours beside it are tried, and at last all hours of eight days.
    """
    this = F.date_trunc("hour", now)
    soon = this + F.expr("interval 1 hour")
    after = lambda at, hours_: at + F.make_dt_interval(hours=hours_.cast("int"))
    guess = after(soon, F.pmod(F.lit(hour) - F.hour(F.from_utc_timestamp(soon, zone)), F.lit(24)))
    some = bool(set(range(7)) - set(weekdays))
    if some:
        days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: after(guess, d * 24))
        guess = F.array_min(F.filter(days, lambda at: F.weekday(F.from_utc_timestamp(at, zone)).isin(*weekdays)))
    hours = F.sequence(this + F.expr("interval 1 hour"), this + F.expr("interval 8 days"), F.expr("interval 1 hour"))

    def fits(at: Column) -> Column:
        local = F.from_utc_timestamp(at, zone)
        return (F.hour(local) == hour) & (F.weekday(local).isin(*weekdays) if some else F.lit(True))

    near = [guess] if some else [guess, guess - F.expr("interval 1 hour"), guess + F.expr("interval 1 hour")]
    return F.coalesce(*[F.when(fits(at), at) for at in near], F.array_min(F.filter(hours, fits)))


def may_start(on: Column, due: Column, started: Column, now: Column) -> Column:
    """ST12: switched on, due, and not already started in this hour."""
    return on & due & ~F.coalesce(F.date_trunc("hour", started) == F.date_trunc("hour", now), F.lit(False))


def several_open(jobs: DataFrame) -> DataFrame:
    """ST10: users with more than one open job, which the state machine forbids."""
    return jobs.filter(F.col("status").isin("queued", "running")).groupBy("user_id").agg(F.count("*").alias("open")).filter("open > 1")


def to_reload(published: DataFrame, loaded_at: Column, model: str) -> DataFrame:
    """ST15: the newest published set if it is newer than what is loaded and has the right model."""
    return published.orderBy(F.desc("published_at")).limit(1).filter((F.col("published_at") > loaded_at) & (F.col("model") == model))


# ---- as a stream ------------------------------------------------------------
def follow(nights: DataFrame, name: str, checkpoint: str):
    """Runs ST1 over a stream of listings ``key, source, board, elsewhere, at``; returns the query.

    The newest state is ``newest(spark, name)``. A micro-batch is a night; its time is its largest ``at``.
    """
    spark = nights.sparkSession
    folder = f"{shared_dir(spark)}/tessera/state-{name}"

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        before = newest(spark, name, below=number)
        now = F.lit(batch.agg(F.max("at")).first()[0])
        seen(before, batch, now).drop("reopened").write.mode("overwrite").parquet(f"{folder}/version={number}")

    return nights.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, name: str, below: int | None = None) -> DataFrame:
    """The last state that a stream has written, or one before a batch's number."""
    folder = f"{shared_dir(spark)}/tessera/state-{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath() for f in system.listStatus(path)] if system.exists(path) else []
    done = [int(p.getName().split("=")[1]) for p in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    done = [n for n in done if below is None or n < below]
    return spark.read.schema(STATE).parquet(f"{folder}/version={max(done)}") if done else empty(spark)
