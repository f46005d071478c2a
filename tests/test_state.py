import datetime as dt
import time
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tessera.streaming import sightings


def at(n):
    return F.lit(dt.datetime(2026, 1, n)).cast("timestamp")


def listed(spark, keys, source="greenhouse", board="b", elsewhere=False):
    return spark.createDataFrame([(f"{source}:{k}", source, board, elsewhere) for k in keys], "key string, source string, board string, elsewhere boolean")


def boards(spark, ok=True, complete=True):
    return spark.createDataFrame([("greenhouse", "b", ok, complete)], "source string, board string, ok boolean, complete boolean")


def test_close_and_reopen(spark):
    state = sightings.empty(spark)
    closed, reopened = [], []
    for n, keys in enumerate(([1, 2], [1], [1, 2]), 1):
        night = listed(spark, keys)
        seen = sightings.seen(state, night, at(n))
        reopened.append(seen.filter("reopened").count())
        before = seen.filter("closed_at is not null").count()
        state = sightings.close_missing(seen.drop("reopened"), night, boards(spark), at(n))
        closed.append(state.filter("closed_at is not null").count() - before)
    assert closed == [0, 1, 0] and reopened == [0, 0, 1]


def test_failed_or_empty_board_closes_nothing(spark):
    state = sightings.seen(sightings.empty(spark), listed(spark, [1, 2]), at(1)).drop("reopened")
    for b, night in ((boards(spark, ok=False), listed(spark, [1])), (boards(spark, complete=False), listed(spark, [1])), (boards(spark), listed(spark, []))):
        assert sightings.close_missing(state, night, b, at(2)).filter("closed_at is not null").count() == 0


def test_copy_elsewhere_never_reopens(spark):
    state = sightings.seen(sightings.empty(spark), listed(spark, [1, 2]), at(1)).drop("reopened")
    state = sightings.close_missing(state, listed(spark, [1]), boards(spark), at(2))
    state = sightings.seen(state, listed(spark, [2], elsewhere=True), at(3))
    row = state.filter("key = 'greenhouse:2'").first()
    assert row.closed_at is not None and row.last_seen.day == 3 and not row.reopened


def test_unseen_stored_keys_close(spark):
    stored = spark.createDataFrame([("greenhouse:1", "greenhouse"), ("greenhouse:9", "greenhouse"), ("other:1", "other")], "key string, source string")
    night = listed(spark, [1])
    state = sightings.seen(sightings.empty(spark), night, at(1)).drop("reopened")
    got = {r.key: r.closed_at for r in sightings.close_unseen(state, night, boards(spark), stored, at(1)).collect()}
    assert got["greenhouse:1"] is None and got["greenhouse:9"] is not None and "other:1" not in got


def test_backoff(spark):
    sites = spark.createDataFrame([("a", 1, None, "x"), ("b", 9, None, "y")], "site string, strikes int, blocked_until timestamp, reason string")
    refusals = spark.createDataFrame([("a", "403", None), ("b", "429", None), ("c", "429", 999999.0)], "site string, reason string, retry_after double")
    got = {r.site: (r.strikes, (r.blocked_until - dt.datetime(2026, 1, 1)).total_seconds() / 3600) for r in sightings.refused(sites, refusals, at(1)).collect()}
    assert got["a"] == (2, 24) and got["b"] == (10, 168) and abs(got["c"][1] - 999999 / 3600) < 1e-6


def test_stream_equals_batches(spark, tmp_path):
    for n, keys in enumerate(([1, 2], [3])):
        night = listed(spark, keys).withColumn("at", at(n + 1))
        night.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        rows = spark.readStream.schema(night.schema).json(str(tmp_path / "in"))
        sightings.follow(rows, tmp_path.name, str(tmp_path / "state")).awaitTermination()
    got = {r.key: r.last_seen.day for r in sightings.newest(spark, tmp_path.name).collect()}
    assert got == {"greenhouse:1": 1, "greenhouse:2": 1, "greenhouse:3": 2}


@pytest.mark.parametrize("zone, hour, weekdays", [("Europe/Amsterdam", 7, tuple(range(7))), ("Europe/Amsterdam", 2, tuple(range(7))), ("Europe/Amsterdam", 0, (0, 3)), ("Asia/Kolkata", 7, (5,))])
def test_next_run_of_a_year(spark, zone, hour, weekdays):
    """Every hour of a year with both changes against the hours one after another; few rows need eight days of hours tried."""
    local = [dt.datetime.fromtimestamp(1704067200 + 3600 * i, ZoneInfo(zone)) for i in range(24 * 375)]
    want, last = {}, None
    for i in reversed(range(len(local))):
        want[i] = last
        if local[i].hour == hour and local[i].weekday() in weekdays:
            last = i
    at = F.timestamp_seconds(F.lit(1704067200 + 59) + F.col("id") * 3600)
    began = time.monotonic()
    got = spark.range(24 * 366).select("id", ((F.unix_timestamp(sightings.next_run(at, hour, zone, weekdays)) - 1704067200) / 3600).cast("int").alias("n")).collect()
    assert {r.id: r.n for r in got} == {i: want[i] for i in range(24 * 366)} and time.monotonic() - began < 60
