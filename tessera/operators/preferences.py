"""Preferences, requirement scores and verified answers (M7, A4, A33, B1-B5, B9, F4, F16, O1 of the survey)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arith import allowed_km, hours_disjoint, monthly
from tessera.functions.text import contains_word, employer, human_list, quoted, same_employer, title_levels

# ---- fixed values -----------------------------------------------------------
BANDS = {"strong": (75, 100), "possible": (40, 74), "weak": (0, 39)}
WORK_POINTS = {"same": 1.0, "next": 0.6, "different": 0.0}
WORK_SHARE, MUST, STRETCH, NICE, PARTLY = 0.3, 1.0, 0.5, 0.25, 0.5
VERDICT_RANK = {"strong": 2, "possible": 1, "weak": 0}


def conflicts(advert: dict[str, Column], wish: dict[str, Column]) -> Column:
    """M7: the stated wishes that an advert's stated facts contradict, in fixed order; what is not stated costs nothing.

    ``advert``: contract_type, work_mode, hours_min, hours_max, salary_min, salary_max, salary_period, km, languages,
    title, company. ``wish``: contract_types, work_modes, hours_min, hours_max, salary_min, max_km, languages, seniority,
    avoid. Lists are arrays, empty or null for no wish.
    """
    a, w = advert, wish
    some = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    outside = lambda value, wanted: some(wanted) & value.isNotNull() & ~F.array_contains(wanted, value)
    month = monthly(a["salary_min"], a["salary_max"], a["salary_period"], a["hours_min"], a["hours_max"])
    spoken = F.transform(w["languages"], lambda x: F.lower(x))
    missing = F.filter(a["languages"], lambda x: ~F.array_contains(spoken, F.lower(x)))
    levels = title_levels(a["title"])
    name = employer(a["company"])
    remote = F.coalesce(a["work_mode"] == "remote", F.lit(False))
    rules = (
        ("contract", outside(a["contract_type"], w["contract_types"]), a["contract_type"], human_list(w["contract_types"])),
        ("work_mode", outside(a["work_mode"], w["work_modes"]), a["work_mode"], human_list(w["work_modes"])),
        ("hours", hours_disjoint(a["hours_min"], a["hours_max"], w["hours_min"], w["hours_max"]), F.concat_ws("-", a["hours_min"], a["hours_max"]), F.concat_ws("-", w["hours_min"], w["hours_max"])),
        ("salary", month < w["salary_min"], F.format_string("%.0f", month), w["salary_min"].cast("string")),
        ("distance", ~remote & (a["km"] > allowed_km(w["max_km"])), F.format_string("%.0f", a["km"]), w["max_km"].cast("string")),
        ("language", some(w["languages"]) & some(missing), human_list(missing, "and"), human_list(w["languages"], "and")),
        ("seniority", some(w["seniority"]) & some(levels) & ~F.arrays_overlap(levels, w["seniority"]), human_list(F.array_sort(levels)), human_list(w["seniority"])),
        ("employer", F.coalesce(F.exists(w["avoid"], lambda x: same_employer(name, x)), F.lit(False)), a["company"], F.lit("not this employer")),
    )
    each = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(field).alias("field"), found.cast("string").alias("found"), wanted.alias("wanted"))) for field, broken, found, wanted in rules]
    return F.array_compact(F.array(*each))


def wishes_text(parts: list[tuple[str, Column]], most: int = 60) -> Column:
    """``label: value`` lines for what is stated, each value cut; null if nothing is."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.substring(v, 1, most))) for label, v in parts]
    return F.nullif(F.concat_ws("\n", *lines), F.lit(""))


def work_filter(title: Column, roles: tuple[str, ...], not_roles: tuple[str, ...]) -> Column:
    """``(keep, word)``: a word that excludes wins, then a role word; without either the title is not kept."""
    first = lambda words: F.coalesce(*[F.when(contains_word(title, F.lit(w)), F.lit(w)) for w in words]) if words else F.lit(None).cast("string")
    no, yes = first(not_roles), first(roles)
    return F.struct((no.isNull() & yes.isNotNull()).alias("keep"), F.coalesce(no, yes).alias("word"))


# ---- requirements -----------------------------------------------------------
def weight(kind: Column, must: Column) -> Column:
    """Eligibility weighs nothing; nice-to-haves a quarter; years and degrees half; other must-haves in full."""
    return F.when(kind == "eligibility", 0.0).when(~must, NICE).when(kind.isin("experience", "education"), STRETCH).otherwise(MUST)


def requirement_scores(answers: DataFrame, key: str) -> DataFrame:
    """Verdict and fit of each key from its answered requirements.

    ``answers``: key, kind, must, knockout, status (met, partly, missing, unknown), and on each row of a key the same
    ``work`` and ``conflicts``.
    """
    w = weight(F.col("kind"), F.col("must"))
    earned = w * F.when(F.col("status") == "met", 1.0).when(F.col("status") == "partly", PARTLY).otherwise(0.0)
    sums = answers.groupBy(key).agg(
        F.sum(w).alias("total"), F.sum(earned).alias("earned"), F.first("work").alias("work"), F.max("conflicts").alias("conflicts"),
        F.bool_or(F.col("knockout") & (F.col("status") == "missing")).alias("stopped"),
    )
    points = reduce(lambda rest, p: F.when(F.col("work") == p[0], p[1]).otherwise(rest), WORK_POINTS.items(), F.lit(None).cast("double"))
    coverage = F.coalesce(F.col("earned") / F.nullif(F.col("total"), F.lit(0.0)), points)
    rows = sums.withColumn("share", (1 - WORK_SHARE) * coverage + WORK_SHARE * points)
    ruled_out = F.col("stopped") | (F.col("work") == "different")
    share, odd = F.col("share"), F.col("conflicts") > 0
    verdict = F.when((share >= 0.75) & ~ruled_out & ~odd, "strong").when((share >= 0.40) & ~ruled_out, "possible").otherwise("weak")

    def placed(band: str, blocked: Column) -> Column:
        low, high = BANDS[band]
        middle = (low + high) // 2
        at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - low / 100) / ((high + 1) / 100 - low / 100)))
        return F.when(blocked, low + F.rint(share * (middle - low))).otherwise(middle + 1 + F.rint(at * (high - middle - 1)))

    fit = F.when(verdict == "strong", F.rint(100 * share)).when(verdict == "possible", placed("possible", odd)).otherwise(placed("weak", ruled_out | odd))
    return rows.select(key, F.round("share", 9).alias("share"), verdict.alias("verdict"), fit.cast("int").alias("fit"))


def combine(requirements: DataFrame, answers: DataFrame, cv: Column) -> DataFrame:
    """Requirements with their answers: no answer is missing, an answer whose quote the CV does not hold is missing,
    unknown is only for knockouts. ``requirements``: key, number, ...; ``answers``: key, number, status, cv_quote.
    """
    joined = requirements.join(answers, ["key", "number"], "left")
    claimed = F.col("status").isin("met", "partly")
    status = (
        F.when(F.col("status").isNull(), "missing")
        .when(claimed & ~F.coalesce(quoted(F.col("cv_quote"), cv), F.lit(False)), "missing")
        .when((F.col("status") == "unknown") & ~F.col("knockout"), "missing")
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", status)


def verified(items: Column, quote_field: str, source: Column) -> Column:
    """The items whose quote stands in the source."""
    return F.filter(items, lambda x: quoted(x[quote_field], source))


def numbered(items: Column) -> Column:
    """``1. a`` lines."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def shown(title: Column, company: Column, city: Column, text: Column) -> Column:
    """B2: title, employer and city in brackets, and text."""
    where = F.concat_ws(" · ", F.nullif(company, F.lit("")), F.nullif(city, F.lit("")))
    return F.concat_ws("\n\n", F.concat(title, F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise("")), text)


def cached_or_new(wanted: DataFrame, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Stored answers for what is wanted, and what is still to do."""
    return stored.join(wanted.select(key).distinct(), key, "left_semi"), wanted.join(stored.select(key).distinct(), key, "left_anti")


def rank_key(verdict: Column, fit: Column, score: Column) -> list[Column]:
    """O1: verdict, fit, score, all descending."""
    order = reduce(lambda rest, p: F.when(verdict == p[0], p[1]).otherwise(rest), VERDICT_RANK.items(), F.lit(-1))
    return [order.desc(), fit.desc(), score.desc()]


def outcome(judged: DataFrame, key: str | None = None) -> DataFrame:
    """Verdict counts with zeros, the largest fit, and ok, no_clear_fit or nothing."""
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in BANDS]
    got = (judged.groupBy(key) if key else judged.groupBy()).agg(*counts, F.coalesce(F.max("fit"), F.lit(0)).alias("best_fit"))
    return got.withColumn("outcome", F.when(F.col("n_strong") > 0, "ok").when(F.col("n_possible") > 0, "no_clear_fit").otherwise("nothing"))


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """F16: adds ``problems``, the names of the constraints that a row breaks; unknown breaks nothing."""
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(~ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))
