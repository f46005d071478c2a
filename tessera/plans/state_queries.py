"""Queries of nightly state, refusals, reports and streams over ``events``.

An event is a listing of its user's advert on its day: views, clicks and purchases list it, errors are failed searches.
"""

from __future__ import annotations


import uuid


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import reports, windows
from tessera.plans.registry import query
from tessera.session import latest, shared_dir, table, written
from tessera.streaming import events as streams
from tessera.streaming import nightly, sightings


def _timed(spark, folder) -> DataFrame:
    return table(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))


def _listings(spark, folder) -> DataFrame:
    """What three nights list: days 1-10, 11-20 and from 21 of the month; ``night`` from 0."""
    e = _timed(spark, folder).filter("event_type <> 'error'")
    key = F.concat_ws(":", F.when(F.col("user_id") % 2 == 0, "greenhouse").otherwise("indeed"), "user_id")
    day = F.dayofmonth("at")
    rows = e.select(key.alias("key"), F.substring_index(key, ":", 1).alias("source"), F.concat(F.lit("b"), F.col("user_id") % 5).alias("board"), F.lit(False).alias("elsewhere"), "event_type", F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2).alias("night"))
    return rows.filter("night = 0 or night = 1 and event_type = 'purchase' or night = 2 and event_type = 'view'").drop("event_type")


def _nights(spark, folder) -> list[DataFrame]:
    """The three nights, each a listing with its time."""
    rows = _listings(spark, folder)
    return [rows.filter(F.col("night") == n).drop("night") for n in range(3)]


_NIGHTS = """
with e as (select case when user_id % 2 = 0 then 'greenhouse:' else 'indeed:' end || user_id as key, user_id, event_type, case when day(ts) <= 10 then 0 when day(ts) <= 20 then 1 else 2 end as night from events where event_type <> 'error'),
l as (select distinct key, user_id, night from e where night = 0 or (night = 1 and event_type = 'purchase') or (night = 2 and event_type = 'view')),
k as (select distinct key, user_id from l),
s as (select key, bool_or(night = 0) as n0, bool_or(night = 1) as n1, bool_or(night = 2) as n2, min(night) as first_night, max(night) as last_night from l group by key)"""


_CLOSED = f"""{_NIGHTS},
b as (select distinct night, user_id % 2 as source, user_id % 5 as board from l)
select s.key, first_night, last_night,
  case when n2 then null
    when n0 and n1 then case when exists (select 1 from b join k on k.key = s.key where b.night = 2 and b.source = k.user_id % 2 and b.board = k.user_id % 5) then 2 end
    when n0 then case when exists (select 1 from b join k on k.key = s.key where b.night = 1 and b.source = k.user_id % 2 and b.board = k.user_id % 5) then 1
      when exists (select 1 from b join k on k.key = s.key where b.night = 2 and b.source = k.user_id % 2 and b.board = k.user_id % 5) then 2 end
    else case when exists (select 1 from b join k on k.key = s.key where b.night = 2 and b.source = k.user_id % 2 and b.board = k.user_id % 5) then 2 end end::double as closed_night
from s"""


@query(_CLOSED)
def sightings_state(spark, folder):
    """ST1, ST3, ST13, J8: three nights merged; boards that answered close what they no longer list, later listings reopen it."""
    state = sightings.empty(spark)
    for number, listed in enumerate(_nights(spark, folder)):
        now = F.timestamp_seconds(F.lit(number))
        after = sightings.seen(state, listed, now).drop("reopened")
        boards = listed.select("source", "board").distinct().withColumns({"ok": F.lit(True), "complete": F.lit(True)})
        state = written(sightings.close_missing(after, listed, boards, now), "state")
    nights = lambda c: F.col(c).cast("long")
    return state.select("key", nights("first_seen").cast("int").alias("first_night"), nights("last_seen").cast("int").alias("last_night"), nights("closed_at").cast("double").alias("closed_night"))


_OPEN = """
with a as (select user_id, min(ts) as posted_at, max(ts) filter (where event_type <> 'error') as last_seen, max(ts) filter (where event_type = 'purchase') as closed from events group by 1),
o as (select *, user_id % 2 = 0 as board from a)
select user_id, case when board then not (closed is not null and closed >= timestamp '2024-01-25') else coalesce(last_seen >= timestamp '2024-02-05' - interval 7 day, false) or posted_at >= timestamp '2024-02-05' - interval 30 day end as open from o"""


@query(_OPEN)
def open_adverts(spark, folder):
    """F6, ST6, J4: which adverts still count as open on a day."""
    e = _timed(spark, folder)
    source = F.when(F.col("user_id") % 2 == 0, "greenhouse").otherwise("indeed")
    adverts = e.groupBy("user_id").agg(F.min("at").alias("posted_at")).select("user_id", F.col("user_id").cast("string").alias("key"), source.alias("source"), "posted_at", F.col("posted_at").alias("fetched_at"))
    closed = F.max(F.when(F.col("event_type") == "purchase", F.col("at")))
    state = e.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max(F.when(F.col("event_type") != "error", F.col("at"))).alias("last_seen"), F.when(closed >= F.lit("2024-01-25").cast("timestamp"), closed).alias("closed_at"))
    return sightings.is_open(adverts, state, F.lit("2024-02-05").cast("timestamp")).select("user_id", "open")


def _as_events(rows: DataFrame) -> DataFrame:
    """The columns of ``nightly.EVENTS``, null where ``rows`` lack them."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (f.split() for f in nightly.EVENTS.split(", "))])


def _replayed(spark, name: str, nights: list[DataFrame], late: str) -> DataFrame:
    """Each night is appended to what a stream reads, which then stops; the next one starts from its checkpoint. Returns the newest entries."""
    name = f"{name}-{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/tessera/nights-{name}"
    for rows in nights:
        rows.write.mode("append").parquet(folder)
        nightly.run(nightly.sightings(spark.readStream.schema(nightly.EVENTS).parquet(folder), late), name)
    return nightly.current(spark, name)


@query(_CLOSED)
def sightings_stream(spark, folder):
    """ST1, ST3, ST13 as a stateful processor: the three nights of ``sightings_state`` replayed as a stream that is stopped and started again."""
    nights, start = [], 86_400  # a stream's time begins at 0, and what is not after it counts as late
    listings = written(_listings(spark, folder).select("night", "key", "source", "board").distinct(), "listings")
    for number in range(3):
        at = F.timestamp_seconds(F.lit(start + number))
        listed = listings.filter(F.col("night") == number).drop("night").withColumns({"kind": F.lit("listed"), "at": at})
        boards = listed.groupBy("source", "board").agg(F.count("*").alias("listed")).withColumns({"kind": F.lit("board"), "at": at, "ok": F.lit(True), "complete": F.lit(True)})
        nights.append(_as_events(listed).unionByName(_as_events(boards)))
    state = _replayed(spark, "sightings", nights, "2 days")
    night = lambda c: F.col(c).cast("long") - start
    return state.select("key", night("first_seen").cast("int").alias("first_night"), night("last_seen").cast("int").alias("last_night"), night("closed_at").cast("double").alias("closed_night"))


@query(_OPEN)
def open_stream(spark, folder):
    """F6, ST6 as a stateful processor: adverts of searches close by timers as time goes on, those of boards when their board reports.

    Events before and after the 15th are two runs of the stream; a last row moves its time to the day asked about.
    """
    e = _timed(spark, folder)
    source = F.when(F.col("user_id") % 2 == 0, "greenhouse").otherwise("indeed")
    key = F.concat_ws(":", source, "user_id")
    own = [key.alias("key"), source.alias("source"), F.concat(F.lit("own "), "user_id").alias("board")]
    first = e.groupBy("user_id").agg(F.min("at").alias("at")).select(*own, "at", F.col("at").alias("posted_at"), F.lit("posted").alias("kind"))
    listed = e.filter("event_type <> 'error'").select(*own, "at", F.lit("elsewhere").alias("kind"))
    taken = e.filter("event_type = 'purchase' and at >= '2024-01-25'").select(source.alias("source"), F.concat(F.lit("own "), "user_id").alias("board"), "at", F.lit("board").alias("kind"), F.lit(True).alias("ok"), F.lit(True).alias("complete"), F.lit(1).alias("listed"))
    rows = _as_events(first).unionByName(_as_events(listed)).unionByName(_as_events(taken))
    later = F.col("at") >= "2024-01-15"
    tick = spark.range(1).select(F.lit("indeed").alias("source"), F.lit("board").alias("kind"), F.lit("none").alias("board"), F.lit("2024-02-05").cast("timestamp").alias("at"))
    state = _replayed(spark, "open", [rows.filter(~later), rows.filter(later), _as_events(tick)], "0 seconds")
    return state.select(F.substring_index("key", ":", -1).cast("bigint").alias("user_id"), "open")


@query("""
with r as (select user_id, count(*) as strikes, max(ts) as last from events where event_type = 'error' group by 1)
select user_id, strikes, least(12 * pow(2, strikes - 1), 168) as hours, last + to_seconds((3600 * least(12 * pow(2, strikes - 1), 168))::bigint) as blocked_until from r""")
def backoff_schedule(spark, folder):
    """ST7: the wait after each site's refusals, doubled up to a week."""
    e = _timed(spark, folder).filter("event_type = 'error'")
    got = e.groupBy("user_id").agg(F.count("*").alias("strikes"), F.max("at").alias("at"))
    hours = sightings.cooldown_hours(F.col("strikes"))
    return got.select("user_id", "strikes", hours.alias("hours"), F.timestamp_seconds(F.col("at").cast("double") + hours * 3600).cast("timestamp_ntz").alias("blocked_until"))


@query("""
with s as (select event_id, 'src' || user_id % 12 as source, case event_type when 'error' then 'failed' when 'signup' then 'blocked' else 'ok' end as status, (event_id % 3)::varchar as detail from events)
select source, status, detail, count(*) as n, min(event_id) as first from s where status <> 'ok' group by all""")
def report_problems(spark, folder):
    """A10: broken searches by source, status and detail, first-seen position kept."""
    return reports.broken_searches(_searches(spark, folder))


def _searches(spark, folder) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "blocked").otherwise("ok")
    listed = F.floor(F.col("value") / 10).cast("bigint")
    return table(spark, folder, "events").select(F.col("event_id").alias("position"), F.concat(F.lit("src"), F.col("user_id") % 12).alias("source"), status.alias("status"), (F.col("event_id") % 3).cast("string").alias("detail"), listed.alias("listed"), F.floor(listed * (F.col("user_id") % 12) / 20).cast("bigint").alias("dropped_no_text"), "ts", "event_id")


@query("""
with s as (select 'src' || user_id % 12 as source, floor(value / 10)::bigint as listed, floor(floor(value / 10) * (user_id % 12) / 20)::bigint as no_text from events where event_type not in ('error', 'signup')),
g as (select source, sum(listed)::bigint as listed, sum(no_text)::bigint as no_text from s group by 1)
select source, listed, no_text, case when listed = 0 then 'empty' else 'no_text' end as problem from g where listed = 0 or (listed >= 10 and no_text > 0.3 * listed)""")
def weak_sources(spark, folder):
    """Sources that list nothing, or lose too much for want of text."""
    return reports.weak_sources(_searches(spark, folder))


@query("""
with s as (select 'src' || user_id % 12 as source, ts, event_id, event_type in ('error', 'signup') as broken from events),
l as (select * from s qualify row_number() over (partition by source order by ts desc, event_id desc) = 1),
g as (select source, max(ts) as good_at from s where not broken group by 1)
select l.source, l.ts as last_at, broken as last_broken, good_at from l left join g on l.source = g.source""")
def last_fetched(spark, folder):
    """Each source's newest report and newest one that is not broken."""
    rows = _searches(spark, folder).select("source", F.col("ts").alias("at"), F.col("event_id").alias("attempt"), (F.col("status") != "ok").alias("broken"))
    return windows.newest_reports(rows)


@query("""
with s as (select 'src' || user_id % 12 as source, count(*) as stored, count(*) filter (where event_type = 'view') as open, count(*) filter (where value > 50) as extracted, count(*) filter (where value > 90) as published, max(ts) as newest from events group by 1),
c(source, enabled) as (values ('src1', true), ('src99', true), ('src2', false))
select coalesce(s.source, c.source) as source, coalesce(stored, 0) as stored, coalesce(open, 0) as open, coalesce(extracted, 0) as extracted, coalesce(published, 0) as published, newest, coalesce(enabled, false) as enabled from s full join c on s.source = c.source""")
def source_overview(spark, folder):
    """A12, A13, SO1: a row for every source stored or configured."""
    e = table(spark, folder, "events")
    stored = e.select(F.concat(F.lit("src"), F.col("user_id") % 12).alias("source"), (F.col("event_type") == "view").alias("open"), (F.col("value") > 50).alias("extracted"), (F.col("value") > 90).alias("published"), F.col("ts").alias("posted_at"), F.col("ts").alias("fetched_at"))
    last = spark.createDataFrame([], "source string, listed bigint, dutch bigint, out_of_scope bigint")
    configured = spark.createDataFrame([("src1", True), ("src99", True), ("src2", False)], "source string, enabled boolean")
    return reports.overview(stored, last, configured).select("source", "stored", "open", "extracted", "published", "newest", "enabled")


@query("""
with r as (select user_id as cv, ts, event_id as id from events where event_type = 'purchase'),
c as (select cv from r group by cv having count(*) >= 2 order by max(row(ts, id)) desc limit 1)
select cv, ts, id from r where cv = (select cv from c) order by ts desc, id desc limit 2""")
def newest_pair(spark, folder):
    """The last two runs of the CV that ran last."""
    runs = table(spark, folder, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("cv"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return windows.newest_pair(runs).select("cv", F.col("at").alias("ts"), "id")


@query("""
with e as (select event_id, ts + interval 70 day as t from events),
r as (select *, date_trunc('day', t) + to_hours(case when t >= timestamp '2024-03-31' then 5 else 6 end) as first,
  date_trunc('day', t) + interval 1 day + to_hours(case when t >= timestamp '2024-03-30' then 5 else 6 end) as second from e)
select event_id, case when first > date_trunc('hour', t) then first else second end as next from r""")
def schedule_next(spark, folder):
    """ST11: after every event, seventy days on, the next run at seven in Amsterdam, across the change to summer time."""
    at = F.col("at") + F.expr("interval 70 days")
    return _timed(spark, folder).select("event_id", sightings.next_run(at, 7).cast("timestamp_ntz").alias("next"))


@query("select user_id, count(*) as open from events where event_type in ('view', 'click') group by 1 having count(*) > 1")
def several_open(spark, folder):
    """ST10: users with more than one open job."""
    jobs = table(spark, folder, "events").select("user_id", F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise("done").alias("status"))
    return sightings.several_open(jobs)


def _streamed(spark, folder, name: str, make, mode: str) -> DataFrame:
    """Runs a stream over the events file to its end and returns what it wrote."""
    source = table(spark, folder, "events")
    rows = spark.readStream.schema(source.schema).parquet(f"{folder}/events.parque[t]")
    base = f"{shared_dir(spark)}/tessera/stream-{name}-{uuid.uuid4().hex}"
    out = make(rows)
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/batch={n}")
    out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/batch=*")


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 6) as value from events group by 1, 2")
def stream_tumbling(spark, folder):
    """Daily counts by a stream with a watermark, complete at the end."""
    out = _streamed(spark, folder, "tumbling", streams.windowed_counts, "complete")
    last = latest(out, ["start", "event_type"], [F.desc("n")])
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


@query("select count(distinct (user_id, event_type)) as n from events")
def stream_dedupe(spark, folder):
    """Each user and type once, by a stream that drops duplicates within a watermark of 60 days."""
    out = _streamed(spark, folder, "dedupe", lambda e: streams.first_of_each(e, ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "append")
    return out.agg(F.count("*").alias("n"))


@query("select user_id, count(*) as n, floor(epoch(max(ts)))::bigint as last from events group by 1")
def stream_last_seen(spark, folder):
    """ST1 as keyed state of a stream: events and last time of each user."""
    out = _streamed(spark, folder, "last-seen", streams.last_seen, "update")
    return latest(out, ["user_id"], [F.desc("n")])
