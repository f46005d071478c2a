"""Date, number, array and JSON functions (M1-M19 of the survey) as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
EARTH_KM, SAME_PLACE_KM, FULL_TIME = 6371.0, 15.0, 40
LEVEL_RANK = {"mbo": 1, "hbo": 2, "wo": 3}
MONTHS_NL = "januari februari maart april mei juni juli augustus september oktober november december".split()
MONTHS_EN = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
NUTS_PROVINCES = {
    "NL11": "Groningen", "NL12": "Fryslân", "NL13": "Drenthe", "NL21": "Overijssel", "NL22": "Gelderland", "NL23": "Flevoland",
    "NL31": "Utrecht", "NL32": "Noord-Holland", "NL33": "Zuid-Holland", "NL34": "Zeeland", "NL41": "Noord-Brabant", "NL42": "Limburg",
}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def moment(x: Column) -> Column:
    """M1: ISO times with ``Z``, `` UTC``, an offset or only a date; null if unreadable. Times without a zone are UTC."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(x), "(?i)\\s*(utc|z)$", "+00:00"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """M2: great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def allowed_km(limit: Column) -> Column:
    """M3: the limit and a margin of a quarter, 5 km at least."""
    return limit + F.greatest(limit * 0.25, F.lit(5.0))


def half_even(x: Column, digits: int = 0) -> Column:
    """M4: rounding of the binary double to even."""
    return F.rint(x) if digits == 0 else F.bround(x, digits)


def monthly(low: Column, high: Column, period: Column, hours_low: Column, hours_high: Column) -> Column:
    """M5: the most that is stated, a month; null if no amount or period. Zero hours count as not stated."""
    amount = F.coalesce(high, low).cast("double")
    hours = F.coalesce(F.nullif(hours_high, F.lit(0)), F.nullif(hours_low, F.lit(0)), F.lit(FULL_TIME))
    return F.when(period == "month", amount).when(period == "year", amount / 12).when(period == "hour", amount * hours * 52 / 12)


def hours_disjoint(low: Column, high: Column, want_low: Column, want_high: Column) -> Column:
    """M6: whether two ranges of hours share nothing; false unless each side states something."""
    lo, hi = F.coalesce(low, high), F.coalesce(high, low)
    asked = want_low.isNotNull() | want_high.isNotNull()
    return F.coalesce(asked & ((hi < F.coalesce(want_low, F.lit(0))) | (lo > F.coalesce(want_high, F.lit(99)))), F.lit(False))


def level_rank(level: Column) -> Column:
    return F.try_element_at(_map(LEVEL_RANK), level)


def highest_level(education: Column) -> Column:
    """M8: the highest level among ``(level, finished)``; one counts unless it is stated as not finished."""
    counted = F.filter(education, lambda e: F.coalesce(e["finished"], F.lit(True)) & level_rank(e["level"]).isNotNull())
    return F.array_max(F.transform(counted, lambda e: level_rank(e["level"])))


def meets_level(asked: Column, highest: Column) -> Column:
    """M8: nothing asked is met; a CV without a level meets no level."""
    return F.when(level_rank(asked).isNull(), True).otherwise(F.coalesce(highest >= level_rank(asked), F.lit(False)))


def start_month(x: Column) -> Column:
    """M9: ``YYYY`` or ``YYYY-MM`` as months since year 0; a year alone starts in January."""
    parts = F.split(x, "-")
    return F.try_to_number(parts[0], F.lit("9999")).cast("int") * 12 + F.coalesce(F.try_to_number(F.get(parts, 1), F.lit("99")).cast("int"), F.lit(1)) - 1


def end_month(x: Column) -> Column:
    """M9: the month after the last; a year alone lasts through December."""
    parts = F.split(x, "-")
    return F.try_to_number(parts[0], F.lit("9999")).cast("int") * 12 + F.coalesce(F.try_to_number(F.get(parts, 1), F.lit("99")).cast("int"), F.lit(12))


def names_year(source: Column, date: Column) -> Column:
    """Whether a text holds the year of a date, in full or as ``'24``."""
    year = F.substring(date, 1, 4)
    return F.coalesce(F.contains(source, year) | F.contains(source, F.concat(F.lit("'"), F.substring(year, 3, 2))), F.lit(False))


def verified_dates(source: Column, experience: Column) -> Column:
    """The experience with starts and ends that the text does not support made null."""
    return F.transform(experience, lambda e: e.withField("start", F.when(names_year(source, e["start"]), e["start"])).withField("end", F.when(names_year(source, e["end"]), e["end"])))


def miles(km: Column) -> Column:
    """At least one mile."""
    return F.greatest(F.lit(1.0), F.rint(km / 1.609344)).cast("int")


def retry_after(header: Column, now: Column) -> Column:
    """Seconds from a number or an HTTP date; null if unreadable, never below 0."""
    d = "^\\w{3}, (\\d{2}) (\\w{3}) (\\d{4}) (\\d{2}:\\d{2}:\\d{2}) GMT$"
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS_EN)), F.regexp_extract(header, d, 2)).cast("string"), 2, "0")
    at = F.try_to_timestamp(F.concat(F.regexp_extract(header, d, 3), F.lit("-"), month, F.lit("-"), F.regexp_extract(header, d, 1), F.lit(" "), F.regexp_extract(header, d, 4)))
    seconds = F.expr("try_cast(NULL as double)")
    number = F.when(header.rlike("^\\d+$"), header.cast("double"))
    return F.greatest(F.lit(0.0), F.coalesce(number, at.cast("double") - now.cast("double"), seconds))


def dutch_date(x: Column) -> Column:
    """``3 maart 2024`` as a date; null if unreadable."""
    p = "(?i)(\\d{1,2})\\s+(" + "|".join(MONTHS_NL) + ")\\s+(\\d{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS_NL)), F.lower(F.regexp_extract(x, p, 2)))
    return F.when(x.rlike(p), F.to_date(F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(x, p, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(x, p, 1), 2, "0")))))


def age_text(seconds: Column) -> Column:
    """``<1h``, ``47h``, ``3d``."""
    hours = F.floor(seconds / 3600)
    return F.when(hours < 1, "<1h").when(hours < 48, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d")))


def nuts_province(code: Column) -> Column:
    """The province of a region code by its first four characters."""
    return F.try_element_at(_map(NUTS_PROVINCES), F.substring(code, 1, 4))


def json_part(x: Column) -> Column:
    """From the first ``{`` to the last ``}``; null without them."""
    return F.nullif(F.regexp_extract(x, "(?s)\\{.*\\}", 0), F.lit(""))


def preference_stamp(values: dict[str, Column]) -> Column:
    """``p2:`` and 8 hex digits of the sorted JSON of what is stated; empty if nothing is."""
    body = F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]))
    return F.when(reduce(lambda a, b: a & b, [v.isNull() for v in values.values()]), "").otherwise(F.concat(F.lit("p2:"), F.substring(F.sha2(body, 256), 1, 8)))


def cache_key(kind: Column, *parts: Column) -> Column:
    """The kind and the digest of everything that a stored answer depends on."""
    return F.concat(kind, F.lit(":"), F.sha2(F.concat_ws("\u0001", *parts), 256))


def over_budget(spent: Column, estimate: Column, cap: Column) -> Column:
    """Whether the next call would pass the cap; no cap, no limit."""
    return F.coalesce(F.coalesce(spent, F.lit(0.0)) + estimate > cap, F.lit(False))


def range_text(low: Column, high: Column) -> Column:
    """``a-b``, ``a``, ``tot b``, up to six significant digits; null if neither is stated."""
    g = lambda v: F.regexp_replace(F.format_string("%.6f", v.cast("double")), "\\.?0+$", "")
    return F.when(low.isNotNull() & high.isNotNull(), F.when(low == high, g(low)).otherwise(F.concat_ws("-", g(low), g(high)))).when(low.isNotNull(), g(low)).when(high.isNotNull(), F.concat(F.lit("tot "), g(high)))
