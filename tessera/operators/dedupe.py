"""Order-aware removal of duplicates (D1-D7): the first copy stays, and a dropped copy removes nothing itself.

Rows conflict if they share a label print, or a content print at places that may be one. In load order a row is kept when
no kept row before it conflicts with it. Rows whose prints nobody shares are kept at once; rounds settle the rest, each
every row whose earlier conflicts are settled, with the round's table written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import simplify, squeeze
from tessera.session import written


def label_print(key: Column, title: Column, company: Column, city: Column) -> Column:
    """Without a company the row is only like itself."""
    label = F.concat_ws("|", simplify(F.coalesce(title, F.lit(""))), simplify(company), simplify(F.coalesce(city, F.lit(""))))
    return F.when(F.coalesce(company, F.lit("")) == "", key).otherwise(label)


def content_print(title: Column, text: Column) -> Column:
    """D3: the simplified title and the digest of the squeezed text."""
    return F.concat_ws("|", simplify(F.coalesce(title, F.lit(""))), F.sha2(squeeze(F.coalesce(text, F.lit(""))), 256))


def same_place(a: Column, b: Column) -> Column:
    """Missing is compatible with anything; equal; or one is a start of the other of up to three characters."""
    x, y = simplify(a), simplify(b)
    start = lambda s, t: (F.length(s) <= 3) & F.startswith(t, s)
    missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return missing | (x == y) | F.when(F.length(x) <= F.length(y), start(x, y)).otherwise(start(y, x))


def place_keys(city: Column) -> tuple[Column, Column]:
    """D4 as equality: the keys that a city is found under and the keys that it asks for. Two places may be one if one's asked keys meet the other's.

    All are found under ``*``, missing ones under ``?``, others under the whole (``=``) and under each start of up to three characters (``<``).
    """
    x = simplify(city)
    missing = F.coalesce(city, F.lit("")) == ""
    start = lambda mark, n, fits: F.when(fits, F.concat(F.lit(mark), F.substring(x, 1, n)))
    whole = F.concat(F.lit("="), x)
    found = F.array(F.lit("*"), whole, *[start("<", n, F.length(x) >= n) for n in range(4)])
    asked = F.array(F.lit("?"), whole, *[start("=", n, F.length(x) > n) for n in range(4)], F.when(F.length(x) <= 3, F.concat(F.lit("<"), x)))
    return F.when(missing, F.array(F.lit("*"), F.lit("?"))).otherwise(F.array_compact(found)), F.when(missing, F.array(F.lit("*"))).otherwise(F.array_compact(asked))


def _digest(value: Column) -> Column:
    """132 bits of a print's SHA-256 in 22 characters: titles may be as long as texts, and no print is asked for anything but equality. Nulls are like nulls."""
    return F.coalesce(F.substring(F.base64(F.unhex(F.sha2(value, 256))), 1, 22), F.lit(""))


def keep_first(rows: DataFrame) -> DataFrame:
    """``rows`` has ``position, label, content, city``; adds ``kept`` and ``twin``, the position of the kept copy.

    Rows equal in all three prints fold into their first. A round needs two numbers of each label, and of each content and
    place key: the first kept and the first not dropped position. No pairs are made, and no list of a content's cities. Prints travel as digests,
    and rows whose prints nobody shares take no part in the rounds.
    """
    prints = [_digest(F.col("label")).alias("label"), _digest(F.col("content")).alias("content"), "city"]
    first = written(rows.select("position", *prints).groupBy("label", "content", "city").agg(F.min("position").alias("position")), "dedupe")
    many = lambda key: first.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit(True).alias(f"many_{key}"))
    doubt = first.join(many("label"), "label", "left").join(many("content"), "content", "left")
    kept = F.when(F.coalesce("many_label", "many_content").isNull(), True)
    told = written(doubt.select("label", "content", "city", "position", kept.cast("boolean").alias("kept")), "state")
    sure, state = told.filter("kept"), told.filter("kept is null")
    while not state.filter("kept is null").isEmpty():
        state = written(_settled(state), "state")
    dropped = _asked(state.filter("not kept"), state).select("position", F.coalesce("lk", "ck").alias("__twin"))
    settled = sure.withColumn("__twin", F.lit(None).cast(state.schema["position"].dataType)).unionByName(state.join(dropped, "position", "left"))
    fate = settled.select(F.col("label").alias("__l"), F.col("content").alias("__c"), F.col("city").alias("__y"), F.col("position").alias("__first"), F.col("kept").alias("__kept"), "__twin")
    asked = rows.withColumns({"__label": _digest(F.col("label")), "__content": _digest(F.col("content"))})
    on = (F.col("__label") == F.col("__l")) & (F.col("__content") == F.col("__c")) & asked["city"].eqNullSafe(F.col("__y"))
    is_first = F.col("position") == F.col("__first")
    twin = F.when(F.col("__kept"), F.when(~is_first, F.col("__first"))).otherwise(F.col("__twin"))
    return asked.join(fate, on).select(*rows.columns, (F.col("__kept") & is_first).alias("kept"), twin.alias("twin"))


def _keys(places: Column) -> Column:
    """A row's label and its content at places, digests both, as one list of keys."""
    label, content = F.concat(F.lit("L:"), "label"), F.concat(F.lit("C:"), "content")
    return F.concat(F.array(label), F.transform(places, lambda p: F.concat(content, F.lit("|"), p)))


def _asked(asking: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with the first kept and first undropped position before them of their label (``lk, lu``) and of their content where places fit (``ck, cu``)."""
    found, asked = map(_keys, place_keys(F.col("city")))
    firsts = [F.min(F.when(F.col("kept"), F.col("position"))).alias("k"), F.min(F.when(F.coalesce("kept", F.lit(True)), F.col("position"))).alias("u")]
    groups = state.select(F.explode(found).alias("key"), "kept", "position").groupBy("key").agg(*firsts)
    met = asking.select("*", F.explode(asked).alias("key")).join(groups, "key", "left")
    of_label = F.startswith("key", F.lit("L"))
    before = lambda kind, which, c: F.min(F.when(which & (F.col(c) < F.col("position")), F.col(c))).alias(kind + c)
    return met.groupBy("label", "content", "city", "position", "kept").agg(*[before(kind, which, c) for kind, which in (("l", of_label), ("c", ~of_label)) for c in "ku"])


def _settled(state: DataFrame) -> DataFrame:
    """A round: only undecided rows ask."""
    dropped = F.coalesce("lk", "ck").isNotNull()
    free = F.coalesce("lu", "cu").isNull()
    now = _asked(state.filter("kept is null"), state).withColumn("kept", F.when(dropped, False).when(free, True)).select(state.columns)
    return state.filter("kept is not null").unionByName(now)


def added(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """What a batch adds to a store: ``outcome`` is known (same key), duplicate (a twin is kept) or stored.

    Both have ``key, position, label, content, city``; rows of the store come first whatever their position.
    """
    fresh = batch.join(stored.select("key").distinct(), "key", "left_anti")
    known = batch.join(stored.select("key").distinct(), "key", "left_semi").select("key", F.lit("known").alias("outcome"))
    least = stored.agg(F.max("position")).first()[0] or 0
    low = batch.agg(F.min("position")).first()[0] or 0
    shifted = fresh.withColumn("position", F.col("position") - low + least + 1)
    both = keep_first(stored.unionByName(shifted.select(stored.columns)))
    new = both.join(fresh.select("key"), "key", "left_semi").select("key", F.when(F.col("kept"), "stored").otherwise("duplicate").alias("outcome"))
    return known.unionByName(new)


def unique_in_order(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Each value once, at its first position."""
    return rows.groupBy(value).agg(F.min(position).alias(position))


def first_spelling(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Values that differ only in case once, in the first spelling."""
    found = rows.groupBy(F.lower(F.trim(value)).alias("folded")).agg(F.min(F.struct(F.col(position), F.trim(value).alias("v"))).alias("f"))
    return found.select("folded", F.col("f.v").alias(value), F.col(f"f.{position}").alias(position))
