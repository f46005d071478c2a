"""The stateful processor against the merged tables, over several runs of one stream."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from tessera.streaming import nightly, sightings

DAY = dt.timedelta(days=1)
START = dt.datetime(2026, 1, 1)


def replay(spark, folder, nights, name, **settings):
    """Each night is a file; after each the stream stops, and a new one goes on from its state. Returns the state after each."""
    states = []
    for rows in nights:
        spark.createDataFrame(rows, nightly.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(nightly.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        out = nightly.sightings(stream, **settings)
        nightly.run(out, name)
        states.append({r.key: (r.board, r.first_seen, r.last_seen, r.closed_at, r.open) for r in nightly.current(spark, name).collect()})
    return states


def row(source, kind, key, board, at, posted=None, ok=None, complete=None, listed=None):
    return (source, kind, key, board, at, posted, ok, complete, listed)


def test_like_merged_tables(spark, tmp_path):
    """Random nights with moves, copies elsewhere, failed and empty boards, and a start from a table."""
    rng = random.Random(9)
    state = spark.createDataFrame([("greenhouse:0", "greenhouse", START - DAY, START - DAY, "a", None, None), ("greenhouse:99", "greenhouse", START - DAY, START - DAY, "b", None, None)], sightings.STATE)
    initial, nights, wanted = state, [], []
    for n in range(3):
        now = START + n * DAY
        own = {k: rng.choice("ab") for k in range(12) if rng.random() < 0.5}
        elsewhere = [k for k in range(12) if rng.random() < 0.2]
        reports = [("a", rng.random() < 0.8, True), ("b", True, rng.random() < 0.8), ("empty", True, True)]
        sizes = {b: sum(x == b for x in own.values()) for b in "ab"}
        rows = [row("greenhouse", "listed", f"greenhouse:{k}", b, now) for k, b in own.items()] + [row("greenhouse", "elsewhere", f"greenhouse:{k}", None, now) for k in elsewhere]
        rows += [row("greenhouse", "board", None, b, now, ok=ok, complete=c, listed=sizes.get(b, 0)) for b, ok, c in reports]
        rng.shuffle(rows)
        nights.append(rows)
        table = spark.createDataFrame([(r[2], r[0], r[3], r[1] == "elsewhere") for r in rows if r[2]], "key string, source string, board string, elsewhere boolean")
        boards = spark.createDataFrame([("greenhouse", *r) for r in reports], "source string, board string, ok boolean, complete boolean")
        at = F.lit(now).cast("timestamp")
        state = spark.createDataFrame(sightings.close_missing(sightings.seen(state, table, at).drop("reopened"), table.filter("not elsewhere"), boards, at).collect(), sightings.STATE)
        wanted.append({r.key: (r.board, r.first_seen, r.last_seen, r.closed_at, r.closed_at is None) for r in state.collect()})
    got = replay(spark, str(tmp_path / "in"), nights, tmp_path.name, shards=3, initial=initial)
    for found, want in zip(got, wanted):
        touched = {k: v for k, v in want.items() if k in found}
        assert found == touched and set(want) - set(found) <= {"greenhouse:0", "greenhouse:99"}  # what no night touched stays as it was
    assert got[-1]["greenhouse:99"] == wanted[-1]["greenhouse:99"] or "greenhouse:99" not in got[-1]


def test_sources_close_what_is_stored(spark, tmp_path):
    nights = [
        [row("greenhouse", "stored", f"greenhouse:{k}", None, START) for k in (1, 2, 9)] + [row("greenhouse", "listed", "greenhouse:1", "a", START), row("greenhouse", "source", None, None, START, ok=True, complete=True, listed=1)],
        [row("greenhouse", "source", None, None, START + DAY, ok=True, complete=True, listed=0), row("greenhouse", "listed", "greenhouse:2", "a", START + DAY)],
    ]
    got = replay(spark, str(tmp_path / "in"), nights, tmp_path.name, shards=2)
    assert {k: v[3] for k, v in got[0].items()} == {"greenhouse:1": None, "greenhouse:2": START, "greenhouse:9": START}
    assert {k: v[3] for k, v in got[1].items()} == {"greenhouse:1": None, "greenhouse:2": None, "greenhouse:9": START}


def test_timers_close_searches(spark, tmp_path):
    """A week after the last listing or a month after posting; nothing about the advert arrives by then."""
    nights = [
        [row("indeed", "listed", "indeed:old", None, START, posted=START - 222 * DAY), row("indeed", "listed", "indeed:young", None, START, posted=START), row("greenhouse", "listed", "greenhouse:1", "a", START, posted=START - 400 * DAY)],
        [row("indeed", "listed", "indeed:other", None, START + 7 * DAY, posted=START)],
        [row("indeed", "listed", "indeed:other", None, START + 8 * DAY, posted=START)],
        [row("indeed", "listed", "indeed:other", None, START + 29 * DAY, posted=START), row("indeed", "listed", "indeed:late", None, START + 33 * DAY, posted=START)],
    ]
    got = [{k: v[4] for k, v in s.items()} for s in replay(spark, str(tmp_path / "in"), nights, tmp_path.name, late="0 seconds", shards=2)]
    assert got[0] == {"indeed:old": True, "indeed:young": True, "greenhouse:1": True}
    assert got[1]["indeed:old"] is True
    assert got[2] == {"indeed:old": False, "indeed:young": True, "indeed:other": True, "greenhouse:1": True}
    assert got[3] == {"indeed:old": False, "indeed:young": False, "indeed:other": True, "greenhouse:1": True, "indeed:late": True}


def test_passed_over_is_forgotten(spark, tmp_path):
    """Within the time to live a key is known under its own scope only; with none to speak of it is read again."""
    schema = "key string, scope string, passed boolean"

    def asked(name, days):
        folder = str(tmp_path / name)
        for rows in ([("a", "p1", True), ("b", "p1", True)], [("a", "p1", False), ("b", "p2", False), ("c", "p1", False)]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
            nightly.run(nightly.passed_over(spark.readStream.schema(schema).parquet(folder), days), f"{tmp_path.name}-{name}", once=True)
        return {(r.key, r.scope): r.known for r in nightly.changes(spark, f"{tmp_path.name}-{name}", "key string, scope string, known boolean, batch int").collect()}

    assert asked("long", 30) == {("a", "p1"): True, ("b", "p2"): False, ("c", "p1"): False}
    assert asked("short", 0.001 / 86_400) == {("a", "p1"): False, ("b", "p2"): False, ("c", "p1"): False}


def test_a_report_looks_at_its_own_board_only(monkeypatch):
    """Two hundred boards of one advert each that all report: as many looks as reports, not their square."""
    looks, missing = [], nightly.Sightings._missing
    monkeypatch.setattr(nightly.Sightings, "_missing", staticmethod(lambda *a: looks.append(1) or missing(*a)))
    monkeypatch.setattr(nightly.Sightings, "_keep", lambda self, source, key, entry: entry.update(open=entry["closed_at"] is None))
    state = nightly.Sightings()
    state.entries = type("Entries", (), {"iterator": lambda self: iter(()), "containsKey": lambda self, k: False})()
    blank = dict.fromkeys(["key", "board", "posted_us", "ok", "complete", "listed"])
    rows = [blank | {"kind": "listed", "key": f"k{i}", "board": f"b{i}", "at_us": 1} for i in range(200)]
    rows += [blank | {"kind": "board", "board": f"b{i}", "at_us": 2, "ok": True, "complete": True, "listed": 1} for i in range(200)]
    out = next(state.handleInputRows(("greenhouse",), iter([pd.DataFrame(rows, dtype=object)]), None))
    assert len(looks) == 200 and len(out) == 200 and (out["closed_at"] == 2).all()


class _Map(dict):
    """A map state in memory that counts what is written to it."""

    written = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self.written += sum(len(v) if isinstance(v, list) else 1 for v in value)
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


def test_what_is_due_at_one_time_is_not_written_for_every_key(monkeypatch):
    """Two thousand adverts listed at one time in two batches: each is written once or twice, and all close when it is time, also those listed again."""
    monkeypatch.setattr(nightly, "PART", 100, raising=False)
    state, timers = nightly.Sightings(), set()
    handle = type("Handle", (), {"getMapState": lambda self, *a: _Map(), "registerTimer": lambda self, at: timers.add(at)})()
    state.init(handle)
    blank = dict.fromkeys(["key", "board", "posted_us", "ok", "complete", "listed"])
    for names in (range(1000), range(500, 2000)):
        rows = [blank | {"kind": "listed", "key": f"k{i}", "at_us": 1} for i in names]
        list(state.handleInputRows(("indeed",), iter([pd.DataFrame(rows, dtype=object)]), None))
    assert len(timers) == 1 and state.due.written < 4000 and max(len(keys) for keys, *_ in state.due.values()) <= 100
    (at,) = timers
    expired = type("Expired", (), {"getExpiryTimeInMs": lambda self: at})()
    (out,) = state.handleExpiredTimer(("indeed",), None, expired)
    assert sorted(out["key"]) == sorted(f"k{i}" for i in range(2000)) and not out["open"].any() and not state.due
