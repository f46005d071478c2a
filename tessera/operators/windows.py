"""Windows, gaps and islands, and gazetteers (W4, W6, W10-W12, A35, A36, T6, J13 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arith import SAME_PLACE_KM, haversine_km
from tessera.operators import terms
from tessera.session import latest


def merged_months(periods: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Months covered by at least one of a key's periods, and as years to one decimal (half to even)."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce(F.max(end).over(w), F.col(start))), F.lit(0))
    months = periods.filter(F.col(end) > F.col(start)).withColumn("__m", fresh).groupBy(key).agg(F.sum("__m").cast("bigint").alias("months"))
    return months.withColumn("years", F.bround(F.col("months") / 12, 1))


def newest_pair(runs: DataFrame) -> DataFrame:
    """Of the CVs with two runs or more, the last two runs of the one that ran last. ``runs``: cv, at, id."""
    several = runs.groupBy("cv").agg(F.count("*").alias("n"), F.max(F.struct("at", "id")).alias("last")).filter("n >= 2")
    cv = several.orderBy(F.desc("last")).limit(1).select(F.col("cv").alias("__cv"))
    return runs.join(F.broadcast(cv), runs.cv == F.col("__cv")).drop("__cv").orderBy(F.desc("at"), F.desc("id")).limit(2)


def newest_reports(reports: DataFrame) -> DataFrame:
    """Each source's newest report, and its newest one that is not broken. ``reports``: source, at, attempt, broken."""
    order = [F.desc("at"), F.desc("attempt")]
    last = latest(reports, ["source"], order).select("source", F.col("at").alias("last_at"), F.col("broken").alias("last_broken"))
    good = latest(reports.filter("not broken"), ["source"], order).select(F.col("source").alias("__s"), F.col("at").alias("good_at"))
    return last.join(good, last.source == good["__s"], "left").drop("__s")


def discount(position: Column) -> Column:
    """1 / log2(position + 1)."""
    return 1 / F.log2(position + 1)


def bare(name: Column) -> Column:
    return F.substring_index(name, " (", 1)


def province_gazetteer(places: DataFrame, clean, aliases: dict[str, str] | None = None, not_places: tuple[str, ...] = ()) -> DataFrame:
    """``name, provinces``. ``places``: place, municipality, province; ``clean`` makes names comparable.

    A name with a suffix in brackets counts under its bare name only if nothing bears that name exactly.
    """
    spark = places.sparkSession
    named = places.select(F.explode(F.array("place", "municipality", "province")).alias("raw"), "province")
    exact = named.filter(bare(F.col("raw")) == F.col("raw")).select(clean(F.col("raw")).alias("name"), "province")
    suffixed = named.filter(bare(F.col("raw")) != F.col("raw")).select(clean(bare(F.col("raw"))).alias("name"), "province")
    every = exact.unionByName(suffixed.join(exact.select("name").distinct(), "name", "left_anti"))
    if aliases:
        every = every.unionByName(spark.createDataFrame(list(aliases.items()), "name string, province string"))
    return every.filter(~F.col("name").isin(*not_places)).groupBy("name").agg(F.array_sort(F.collect_set("province")).alias("provinces"))


def point_gazetteer(places: DataFrame, clean) -> DataFrame:
    """``name, lat, lon``, null where copies of a name lie over 15 km from their mean. ``places``: place, municipality, lat, lon.

    Layers in order: the place as written, its bare name, its municipality.
    """
    layers = [(0, F.col("place")), (1, bare(F.col("place"))), (2, F.col("municipality"))]
    named = None
    for layer, name in layers:
        part = places.select(F.lit(layer).alias("layer"), clean(name).alias("name"), "lat", "lon")
        named = part if named is None else named.unionByName(part)
    means = named.groupBy("layer", "name").agg(F.avg("lat").alias("m_lat"), F.avg("lon").alias("m_lon"))
    far = named.join(means, ["layer", "name"]).groupBy("layer", "name").agg(F.first("m_lat").alias("m_lat"), F.first("m_lon").alias("m_lon"), F.max(haversine_km(F.col("lat"), F.col("lon"), F.col("m_lat"), F.col("m_lon"))).alias("km"))
    near = F.col("layer").isin(0, 1) & (F.col("km") > SAME_PLACE_KM)
    point = far.select("layer", "name", F.when(~near, F.col("m_lat")).alias("lat"), F.when(~near, F.col("m_lon")).alias("lon"))
    return latest(point, ["name"], [F.col("layer")]).select("name", "lat", "lon")


def name_grams(location: Column, most: int = 5) -> Column:
    """The candidate names in a location, ``(part, start, size, name)``; parts are split at commas and already cleaned."""
    def of(part, number):
        words = F.filter(F.split(part, " "), lambda w: w != "")
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(words) - s + 1)), lambda n: F.struct(number.alias("part"), s.alias("start"), n.alias("size"), F.array_join(F.slice(words, s, n), " ").alias("name")))))

    return F.flatten(F.transform(location, of))


def longest_matches(hits: Column) -> Column:
    """Of ``(part, start, size, name, ...)`` the greedy choice: from the left, the longest, none overlapping."""
    kind = "array<struct<part:int,start:int,size:int,name:string>>"
    order = F.array_sort(F.transform(hits, lambda h: F.struct(h["part"].alias("part"), h["start"].alias("start"), (-h["size"]).alias("less"), h["name"].alias("name"))))
    begin = F.struct(F.lit(-1).alias("part"), F.lit(0).alias("end"), F.array().cast(kind).alias("out"))

    def step(acc, h):
        free = (h["part"] != acc["part"]) | (h["start"] >= acc["end"])
        one = F.array(F.struct(h["part"].alias("part"), h["start"].alias("start"), (-h["less"]).alias("size"), h["name"].alias("name")))
        return F.struct(F.when(free, h["part"]).otherwise(acc["part"]).alias("part"), F.when(free, h["start"] - h["less"]).otherwise(acc["end"]).alias("end"), F.when(free, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(order, begin, step)["out"]


_PLACES = "array<struct<name:string,provinces:array<string>>>"


def places_in(rows: DataFrame, key: str, location: str, gazetteer: DataFrame, most: int = 5) -> DataFrame:
    """Each row's places with their provinces; ``location`` is an array of cleaned parts. Rows without a hit have none.

    Names have up to ``most`` words. A null location or part names nothing; of repeated keys each row has the places of its own location.
    A gazetteer (one row a name) of checked size is one automaton that passes each location once.
    """
    small = terms.small(gazetteer.select("name", "provinces"), F.length("name") + F.length(F.array_join("provinces", "")))
    if small is None:
        return _places_by_join(rows, key, location, gazetteer, most)
    return rows.select(*rows.columns, terms.whole_names(F.col(location), small, most, rows.sparkSession).alias("places"))


def _places_by_join(rows: DataFrame, key: str, location: str, gazetteer: DataFrame, most: int) -> DataFrame:
    """The candidate names of a location meet the gazetteer, whose size does not matter to the plan."""
    asked = rows.select(F.col(key).alias("__k"), F.col(location).alias("__l")).distinct()
    grams = asked.select("*", F.explode(name_grams(F.filter("__l", lambda p: p.isNotNull()), most)).alias("g"))
    hits = grams.join(gazetteer, grams["g.name"] == gazetteer.name)
    chosen = hits.groupBy("__k", "__l").agg(F.collect_list("g").alias("hits"), F.map_from_entries(F.array_distinct(F.collect_list(F.struct("name", "provinces")))).alias("provinces"))
    found = chosen.select("__k", "__l", longest_matches(F.col("hits")).alias("found"), "provinces")
    out = rows.join(found, rows[key].eqNullSafe(F.col("__k")) & rows[location].eqNullSafe(F.col("__l")), "left")
    named = F.coalesce(F.transform("found", lambda h: F.struct(h["name"].alias("name"), F.element_at("provinces", h["name"]).alias("provinces"))), F.array().cast(_PLACES))
    return out.select(*[rows[c] for c in rows.columns], named.alias("places"))


def in_scope(places: Column, chosen: tuple[str, ...]) -> Column:
    """kept if no place is named, or one lies in a chosen province."""
    return (F.size(places) == 0) | F.exists(places, lambda p: F.arrays_overlap(p["provinces"], F.array(*map(F.lit, chosen))))
