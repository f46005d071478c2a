"""The nightly state as a stateful processor (ST1-ST6, ST13 of the survey): keyed state, timers and time to live in place of merges.

``Sightings`` keeps a map of adverts for each shard of a source; a source's keys are dealt to ``SHARDS`` shards by hash, so
that a source with a third of all rows is no single task. What a board or a whole source reports concerns keys that are not named,
so such a row goes to every shard. Rows of a micro-batch are taken in order of time; a night may come in one batch or in several.

An advert of a search is open until a week after it was last listed or a month after it was posted, whichever is later. Nothing arrives
then, so an event-time timer closes it. ``PassedOver`` remembers keys for a time to live, which Spark grants in processing time only; it is a
processor of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.session import latest, shared_dir
from tessera.streaming.sightings import AGE_DAYS, BOARD_SOURCES, SEEN_DAYS

SHARDS = 16
#: Keys in one value of what is due at a time.
PART = 1000
#: ``kind``: posted, stored, listed, elsewhere (one key); board, source (a report of how a listing went). A posted row only names board and time.
EVENTS = "source string, kind string, key string, board string, at timestamp, posted_at timestamp, ok boolean, complete boolean, listed bigint"
_ENTRY = "board string, first_seen bigint, last_seen bigint, listed_at bigint, closed_at bigint, posted_at bigint, stored boolean, open boolean"
_NAMES = [field.split()[0] for field in _ENTRY.split(", ")]
_OUT = "key string, source string, board string, first_seen bigint, last_seen bigint, closed_at bigint, open boolean, step int"
_DAY = 86_400_000_000
_ORDER = {"posted": 0, "stored": 1, "listed": 2, "elsewhere": 3, "board": 4, "source": 5}
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sightings(StatefulProcessor):
    """Entries of one shard of a source. All times are microseconds."""

    def __init__(self) -> None:
        self.waiting: dict[int, list[str]] = defaultdict(list)  # what a batch adds to ``due``

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", _ENTRY)
        self.due = handle.getMapState("due", "at bigint, part int", "keys array<string>, parts int")  # part 0 says how many there are

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.to_dict("records"):
            entry = dict.fromkeys(_NAMES) | {n: _number(r[n]) for n in ("first_seen", "last_seen", "closed_at")} | {"board": r["board"], "stored": False}
            self._keep(key[0], r["key"], entry)
        self._wait()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        source = key[0]
        batch = sorted((r for pdf in rows for r in pdf.to_dict("records")), key=lambda r: (r["at_us"], _ORDER[r["kind"]]))
        known: dict[str, dict] = {}
        concerned: dict[tuple, set[str]] = defaultdict(set)  # the keys that a report is about, so that it does not try all
        all_known = any(r["key"] is None for r in batch)
        if all_known:
            known = {k[0]: self._stored(v) for k, v in self.entries.iterator()}
            for k, entry in known.items():
                concerned["board", entry["board"]].add(k)
                if entry["stored"]:
                    concerned["source", None].add(k)
        changed: dict[str, dict] = {}
        for r in batch:
            now = r["at_us"]
            if r["key"] is not None:
                entry = known.get(r["key"]) or (self._new() if all_known else self._entry(r["key"]))
                concerned["board", entry["board"]].discard(r["key"])
                self._listed(entry, r, now)
                concerned["board", entry["board"]].add(r["key"])
                if entry["stored"]:
                    concerned["source", None].add(r["key"])
                known[r["key"]] = changed[r["key"]] = entry
            elif r["ok"] and r["complete"] and r["listed"]:
                for k in concerned.get(("board", r["board"]) if r["kind"] == "board" else ("source", None), ()):
                    entry = known[k]
                    if self._missing(entry, r, now):
                        entry["closed_at"] = now
                        entry["first_seen"], entry["last_seen"] = (now if entry[c] is None else entry[c] for c in ("first_seen", "last_seen"))
                        changed[k] = entry
        for k, entry in changed.items():
            self._keep(source, k, entry)
        self._wait()
        yield _rows(source, changed, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes what is due and has not been listed since."""
        at, changed = expiredTimerInfo.getExpiryTimeInMs(), {}
        parts = self.due.getValue((at, 0))[1] if self.due.containsKey((at, 0)) else 0
        for part in range(parts):
            for k in self.due.getValue((at, part))[0]:
                entry = self._entry(k)
                if entry["open"] and self._ends(entry) == at:
                    entry["open"] = False
                    self.entries.updateValue((k,), tuple(entry[n] for n in _NAMES))
                    changed[k] = entry
            self.due.removeKey((at, part))
        yield _rows(key[0], changed, 1)

    def _entry(self, key: str) -> dict:
        found = self.entries.getValue((key,)) if self.entries.containsKey((key,)) else None
        return self._stored(found) if found else self._new()

    @staticmethod
    def _new() -> dict:
        return dict.fromkeys(_NAMES) | {"stored": False, "due": None}

    @classmethod
    def _stored(cls, value: tuple) -> dict:
        """An entry of the state; ``due`` is when it is waited for already."""
        entry = dict(zip(_NAMES, value))
        return entry | {"due": cls._ends(entry) if entry["open"] else None}

    @staticmethod
    def _listed(entry: dict, row: dict, now: int) -> None:
        if row["kind"] == "stored":
            entry["stored"] = True
        elif row["kind"] == "posted":
            entry["board"] = row["board"] or entry["board"]
        else:
            entry["first_seen"] = now if entry["first_seen"] is None else entry["first_seen"]
            entry["last_seen"] = now if entry["last_seen"] is None else max(now, entry["last_seen"])
        if row["kind"] == "listed":
            entry["board"], entry["listed_at"], entry["closed_at"] = row["board"] or entry["board"], now, None
        entry["posted_at"] = entry["posted_at"] if _number(row["posted_us"]) is None else _number(row["posted_us"])

    @staticmethod
    def _missing(entry: dict, report: dict, now: int) -> bool:
        concerned = entry["board"] == report["board"] if report["kind"] == "board" else entry["stored"]
        return bool(concerned) and entry["closed_at"] is None and (entry["listed_at"] is None or entry["listed_at"] < now)

    @staticmethod
    def _ends(entry: dict) -> int | None:
        """The millisecond from which an advert of a search is no longer open."""
        ends = [t + days * _DAY for t, days in ((entry["last_seen"], SEEN_DAYS), (entry["posted_at"], AGE_DAYS)) if t is not None]
        return max(ends) // 1000 + 1 if ends else None

    def _keep(self, source: str, key: str, entry: dict) -> None:
        entry["open"] = entry["closed_at"] is None
        if source not in BOARD_SOURCES:
            ends = self._ends(entry)
            entry["open"] = ends is not None
            if ends is not None and ends != entry.get("due"):
                self.waiting[ends].append(key)
        self.entries.updateValue((key,), tuple(entry[n] for n in _NAMES))

    def _wait(self) -> None:
        """Adds what ``_keep`` found to be waited for: once a time, in parts beside those that are there, so that no list is written again and again."""
        for at, keys in self.waiting.items():
            lists = [keys[i : i + PART] for i in range(0, len(keys), PART)]
            first, parts = self.due.getValue((at, 0)) if self.due.containsKey((at, 0)) else (lists.pop(0), 1)
            for part, more in enumerate(lists, parts):
                self.due.updateValue((at, part), (more, 0))
            self.due.updateValue((at, 0), (first, parts + len(lists)))
            self.handle.registerTimer(at)
        self.waiting.clear()


def _number(value) -> int | None:
    return None if value is None or value != value else int(value)


def _rows(source: str, entries: dict[str, dict], step: int) -> pd.DataFrame:
    rows = [(k, source, e["board"], e["first_seen"], e["last_seen"], e["closed_at"], e["open"], step) for k, e in entries.items()]
    numbers = {c: "Int64" for c in ("first_seen", "last_seen", "closed_at")}
    return pd.DataFrame(rows, columns=[field.split()[0] for field in _OUT.split(", ")]).astype(numbers | {"step": "int32", "open": "bool"})


def sightings(events: DataFrame, late: str = "2 days", shards: int = SHARDS, initial: DataFrame | None = None) -> DataFrame:
    """Changed entries of a stream of ``EVENTS``, with every micro-batch: ``key, source, board, first_seen, last_seen, closed_at, open, step``.

    ``initial``: a table of state to start from (``sightings.STATE``). Rows later than ``late`` behind the newest are ignored by Spark.
    """
    everywhere = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    dealt = events.withWatermark("at", late).withColumn("shard", F.explode(F.when(F.col("key").isNull(), everywhere).otherwise(F.array(own))))
    dealt = dealt.withColumns({"at_us": F.unix_micros("at"), "posted_us": F.unix_micros("posted_at")}).drop("posted_at")
    start = None
    if initial is not None:
        times = [F.unix_micros(c).alias(c) for c in ("first_seen", "last_seen", "closed_at")]
        start = initial.select("source", own.alias("shard"), "key", "board", *times).groupBy("source", "shard")
    out = dealt.groupBy("source", "shard").transformWithStateInPandas(Sightings(), _OUT, "Update", "EventTime", initialState=start)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen", "closed_at")})


class PassedOver(StatefulProcessor):
    """ST5: a key that was read and not stored, under a scope, for a time to live; rows that ask get whether it is known."""

    def __init__(self, days: float):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scope = handle.getValueState("scope", "scope string", int(self.days * 86_400_000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = []
        for pdf in rows:
            for scope, passed in zip(pdf["scope"], pdf["passed"]):
                if passed:
                    self.scope.update((scope,))
                else:
                    asked.append((key[0], scope, self.scope.exists() and self.scope.get()[0] == scope))
        yield pd.DataFrame(asked, columns=["key", "scope", "known"]).astype({"known": "bool"})


def passed_over(rows: DataFrame, days: float = 30) -> DataFrame:
    """``key, scope, known`` for the rows with ``passed`` false of a stream ``key, scope, passed``; others are remembered for so many days."""
    return rows.groupBy("key").transformWithStateInPandas(PassedOver(days), "key string, scope string, known boolean", "Update", "ProcessingTime")


def run(out: DataFrame, name: str, once: bool = False) -> None:
    """Runs a stream of changes to the end of its input and appends them; run again, it goes on where it stopped.

    ``once``: as one batch. A stream in processing time always has a next batch, in which something may expire, and so no end of its own.
    """
    spark = out.sparkSession
    base, conf = f"{shared_dir(spark)}/tessera/changes-{name}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, _STORE)
    try:
        sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/batch={n}")  # noqa: E731  a batch run again replaces itself
        query = out.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{base}-state").trigger(**({"once": True} if once else {"availableNow": True})).start()
    finally:
        spark.conf.set(conf, before)
    query.awaitTermination()


def changes(spark: SparkSession, name: str, schema) -> DataFrame:
    """All that a stream has appended, with its ``batch``."""
    return spark.read.schema(schema).option("basePath", f"{shared_dir(spark)}/tessera/changes-{name}").parquet(f"{shared_dir(spark)}/tessera/changes-{name}/batch=*")


#: What ``sightings`` gives, with the number of the batch.
CHANGES = "key string, source string, board string, first_seen timestamp, last_seen timestamp, closed_at timestamp, open boolean, step int, batch int"


def current(spark: SparkSession, name: str, schema: str = CHANGES) -> DataFrame:
    """Each key's newest entry."""
    return latest(changes(spark, name, schema), ["key"], [F.desc("batch"), F.desc("step")]).drop("batch", "step")
