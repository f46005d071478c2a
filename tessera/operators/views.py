"""Views over stored runs (P5-P7, P12, P13, A42, A43, ST14, JS2, JS4, JS7, JS9, Q7-Q9, W9 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.preferences import rank_key
from tessera.session import latest


def match_card(run: DataFrame) -> DataFrame:
    """P5: the first required gap, else the first; employer and city from the advert, else from its details."""
    required = F.get(F.filter("gaps", lambda g: g["required"]), 0)
    gap = F.coalesce(required, F.get("gaps", 0))
    return run.select("key", "verdict", "fit", F.coalesce("company", "details.company").alias("company"), F.coalesce("city", "details.city").alias("city"), gap["requirement"].alias("gap"))


def run_summaries(runs: DataFrame) -> DataFrame:
    """Stored runs with their nested lists reduced to sizes, newest first."""
    return runs.select("id", "cv", "at", F.size("rows").alias("judged"), F.size("ranking").alias("ranked")).orderBy(F.desc("at"), F.desc("id"))


def stamp(values: dict[str, Column]) -> Column:
    """What makes runs comparable, on one line."""
    return F.concat_ws(" · ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in values.items()])


def results(run: DataFrame, ranking: DataFrame, marks: DataFrame) -> DataFrame:
    """Judged rows with rank and latest mark, by verdict, fit and score."""
    last = latest(marks, ["key"], [F.desc("at")]).select("key", "call", "reason")
    joined = run.join(ranking.select("key", "rank", "before", "score"), "key", "left").join(last, "key", "left")
    return joined.orderBy(*rank_key(F.col("verdict"), F.col("fit"), F.col("score")), "key")


def decision(run: DataFrame, ranking: DataFrame, decisions: DataFrame) -> DataFrame:
    """ST14: decisions with verdict, fit and rank as the run has them; a decision without a reason is left out."""
    stated = decisions.filter(F.coalesce(F.trim("reason"), F.lit("")) != "")
    return stated.join(run.select("key", "verdict", "fit"), "key", "left").join(ranking.select("key", "rank"), "key", "left")


def verdict_filters(run: DataFrame, marks: DataFrame) -> DataFrame:
    """JS2: how many rows each verdict's filter and the filter for unmarked rows would show."""
    marked = run.join(marks.select("key", F.lit(True).alias("marked")).distinct(), "key", "left")
    return marked.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("strong", "possible", "weak")], F.count_if(F.col("marked").isNull()).alias("unmarked"))


def source_choices(counted: DataFrame, pickable: DataFrame) -> DataFrame:
    """JS4: pickable sources, those with rows first in their order, then the others in theirs. Both: source, position."""
    first = counted.join(pickable.select("source", "enabled"), "source").select("source", F.lit(0).alias("part"), "position", "enabled")
    rest = pickable.join(counted, "source", "left_anti").select("source", F.lit(1).alias("part"), "position", "enabled")
    return first.unionByName(rest).groupBy("source", "enabled").agg(F.min(F.struct("part", "position")).alias("place"))


def heaviest_gaps(groups: DataFrame, most: int = 8) -> DataFrame:
    """JS7: the first gap groups by weight, then term."""
    return groups.orderBy(F.desc("weight"), "term").limit(most)


def answered(questions: DataFrame) -> DataFrame:
    """JS9: answered and open questions."""
    return questions.agg(F.count("answer").alias("answered"), F.count_if(F.col("answer").isNull()).alias("open"))


def setting(settings: DataFrame, name: str, path: str, default: Column) -> DataFrame:
    """Q7: a value of a JSON setting, or the default. ``settings``: name, value (JSON text)."""
    got = settings.filter(F.col("name") == name).agg(F.max(F.get_json_object("value", path)).alias("v"))
    return got.select(F.coalesce("v", default).alias("value"))


def run_finish(sources: Column) -> Column:
    """Q8: the sum over a run's sources of what was published; null without an overview."""
    return F.when(sources.isNotNull(), F.aggregate(sources, F.lit(0).cast("bigint"), lambda n, s: n + F.coalesce(s["published"], F.lit(0))))


def newest_overview(runs: DataFrame) -> DataFrame:
    """Q9: the newest run that has an overview."""
    return runs.filter("overview is not null").orderBy(F.desc("at")).limit(1)


def headline(outcome: Column, strong: Column, possible: Column) -> Column:
    """One line for an outcome, with singular and plural."""
    plural = lambda n, one, many: F.when(n == 1, one).otherwise(F.concat(n.cast("string"), F.lit(many)))
    return (
        F.when(outcome == "ok", F.concat(plural(strong, "One strong match", " strong matches"), F.lit(".")))
        .when(outcome == "no_clear_fit", F.concat(F.lit("No strong match; "), plural(possible, "one possible", " possible"), F.lit(".")))
        .otherwise("Nothing fits.")
    )


def funnel_line(f: DataFrame) -> DataFrame:
    """A funnel as text; stages that lose nothing are left out."""
    part = lambda c, label: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {label}")))
    lost = F.concat_ws(", ", part("not_a_vacancy", "no vacancy"), part("closed", "closed"), part("duplicates", "duplicates"), part("not_extracted", "not extracted"))
    return f.select(F.concat(F.col("loaded").cast("string"), F.lit(" loaded"), F.when(lost != "", F.concat(F.lit(" ("), lost, F.lit(")"))).otherwise("")).alias("line"))
