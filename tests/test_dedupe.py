import random

from tessera.operators import dedupe


def one(label, content, city=None):
    return label, content, city


def loop(rows):
    """The plain definition: in order, a row is dropped if a kept row has its label, or its content at a place that fits."""

    def simple(x):
        return x.lower()

    def place(a, b):
        if not a or not b:
            return True
        s, t = sorted((simple(a), simple(b)), key=len)
        return s == t or (len(s) <= 3 and t.startswith(s))

    kept = []
    for i, (label, content, city) in enumerate(rows):
        if not any(k[1] == label or (k[2] == content and place(k[3], city)) for k in kept):
            kept.append((i, label, content, city))
    return {k[0] for k in kept}


def run(spark, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position bigint, label string, content string, city string")
    return {r.position: r for r in dedupe.keep_first(frame).collect()}


def test_dropped_row_drops_nothing(spark):
    got = run(spark, [one("1", "x"), one("1", "y"), one("2", "y")])
    assert [got[i].kept for i in range(3)] == [True, False, True]
    assert got[1].twin == 0


def test_places(spark):
    got = run(spark, [one("1", "x", "Utrecht"), one("2", "x", "UT"), one("3", "x", "Amsterdam"), one("4", "x"), one("5", "x", "Amersfoort")])
    assert [got[i].kept for i in range(5)] == [True, False, True, False, True]


def test_like_the_loop(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = [one(f"l{rng.randrange(14)}", f"c{rng.randrange(12)}", rng.choice([None, "", "Utrecht", "ut", "u", "Assen"])) for _ in range(40)]
        got = run(spark, rows)
        assert {i for i, r in got.items() if r.kept} == loop(rows)


def test_added(spark):
    schema = "key string, position bigint, label string, content string, city string"
    stored = spark.createDataFrame([("a", 0, "1", "x", None)], schema)
    batch = spark.createDataFrame([("a", 0, "1", "x", None), ("b", 1, "1", "z", None), ("c", 2, "2", "q", None), ("d", 3, "2", "w", None)], schema)
    assert {r.key: r.outcome for r in dedupe.added(stored, batch).collect()} == {"a": "known", "b": "duplicate", "c": "stored", "d": "duplicate"}


def test_empty(spark):
    assert run(spark, []) == {}


def test_prints_travel_as_digests(spark, monkeypatch):
    """Prints as long as texts: no table between holds one, only rows that share a print take part in rounds, and the outcome is that of short prints."""
    tables, rounds = [], []
    write, settle = dedupe.written, dedupe._settled
    monkeypatch.setattr(dedupe, "written", lambda df, name: tables.append(write(df, name)) or tables[-1])
    monkeypatch.setattr(dedupe, "_settled", lambda state: rounds.append(state.count()) or settle(state))
    rng = random.Random(8)
    rows = [one(rng.choice([None, *"abcd"]), rng.choice([None, *"uvwxyz"]), rng.choice([None, "Utrecht", "ut"])) for _ in range(30)]
    alone = [one(f"alone {i}", f"alone {i}") for i in range(20)]
    long = lambda x: x and x * 3000
    short = run(spark, rows + alone)
    tables.clear()
    rounds.clear()
    got = run(spark, [one(long(label), long(content), city) for label, content, city in rows + alone])
    assert {i: (r.kept, r.twin) for i, r in got.items()} == {i: (r.kept, r.twin) for i, r in short.items()}
    assert all(len(r[c] or "") < 40 for t in tables for r in t.collect() for c in ("label", "content"))
    assert rounds and max(rounds) <= 30
