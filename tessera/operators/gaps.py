"""Recurring gaps: terms, groups, weights, merged compounds (A5-A9, A38, J21, W7, A6 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import names_alternatives, names_term, searchable
from tessera.operators import terms
from tessera.session import latest, written


def vocabulary(skills: DataFrame) -> DataFrame:
    """``term, spelling``: searchable names of three characters or more, or with ``#`` or ``+``, in the first spelling. ``skills``: position, skill."""
    cleaned = skills.withColumn("term", searchable(F.col("skill"))).filter((F.length("term") >= 3) | F.col("term").rlike("[#+]"))
    return latest(cleaned, ["term"], [F.col("position")]).select("term", F.trim("skill").alias("spelling"), "position")


def tokens(text: Column) -> Column:
    """Whole tokens in the sense of terms: runs of word characters, ``+`` and ``#``."""
    return F.regexp_extract_all(text, F.lit("(?U)[\\w+#]+"), F.lit(0))


def named_terms(gaps: DataFrame, vocab: DataFrame) -> DataFrame:
    """Of each gap that names a term its ``hay``, ``term``, the longest (the first in the vocabulary of equal ones), and ``all`` its terms.

    ``hay`` is the requirement if it names a term, else the quote. ``gaps``: gap_id, which tells gaps apart, requirement, quote;
    ``vocab``: one row a term. Terms without a token match nothing. A vocabulary of checked size is one automaton that passes each text once.
    """
    small = terms.small(vocab.select("term", "position"), F.length("term"))
    if small is None:
        return _named_by_join(gaps, vocab)
    spark = gaps.sparkSession
    asked = gaps.select("gap_id", searchable("requirement").alias("r"), searchable("quote").alias("q"))
    found = asked.select("*", terms.whole_terms(F.col("r"), small, spark).alias("in_r"), terms.whole_terms(F.col("q"), small, spark).alias("in_q"))
    first = F.size("in_r") > 0
    picked = found.select("gap_id", F.when(first, F.col("r")).otherwise(F.col("q")).alias("hay"), F.when(first, F.col("in_r")).otherwise(F.col("in_q")).alias("all"))
    return picked.filter(F.size("all") > 0).select("gap_id", "hay", F.get("all", F.lit(0)).alias("term"), "all")


def _named_by_join(gaps: DataFrame, vocab: DataFrame) -> DataFrame:
    """Gaps meet terms on a shared first token, so no gap is tried against every term; the whole-token test follows."""
    asked = gaps.select("gap_id", F.explode(F.array(F.struct(F.lit(0).alias("source"), searchable("requirement").alias("hay")), F.struct(F.lit(1).alias("source"), searchable("quote").alias("hay")))).alias("s")).select("gap_id", "s.*")
    words = asked.withColumn("token", F.explode(F.array_distinct(tokens(F.col("hay")))))
    first = vocab.select("term", F.col("position").alias("__p"), F.get(tokens(F.col("term")), F.lit(0)).alias("token")).filter("token is not null")
    hits = words.join(first, "token").filter(names_term(F.col("hay"), F.col("term")))
    rows = F.array_sort(F.collect_set(F.struct((-F.length("term")).alias("l"), F.col("__p").alias("p"), F.col("term").alias("t"))))
    named = hits.groupBy("gap_id", "source", "hay").agg(rows["t"].alias("all"))
    return latest(named, ["gap_id"], [F.col("source")]).select("gap_id", "hay", F.get("all", F.lit(0)).alias("term"), "all")


def term_for(gaps: DataFrame, vocab: DataFrame) -> DataFrame:
    """The term of ``named_terms`` for each gap; null if there is none, or if the terms stand as a choice."""
    named = named_terms(gaps, vocab)
    choice = names_alternatives(F.col("hay"), F.col("all"))
    return gaps.join(named.select("gap_id", F.when(~choice, F.col("term")).alias("term")), "gap_id", "left")


def best_occurrences(found: DataFrame) -> DataFrame:
    """A5: of each term and advert one occurrence: required before not, then the larger fit, then the first."""
    w = Window.partitionBy("term", "key").orderBy(F.desc("required"), F.desc("fit"), "position")
    return found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def gap_groups(found: DataFrame) -> DataFrame:
    """``term, display, count, required_count, weight, average_fit``, heaviest first by ``weight`` then term.

    ``found``: term, spelling, key, required, fit, position; weight sums fit / 100 of one occurrence an advert.
    """
    one = best_occurrences(found)
    sums = one.groupBy("term").agg(F.count("*").alias("count"), F.count_if("required").alias("required_count"), F.round(F.sum(F.col("fit") / 100), 9).alias("weight"), F.round(F.avg("fit"), 9).alias("average_fit"))
    spelled = found.groupBy("term", "spelling").agg(F.count("*").alias("n"), F.min("position").alias("p"))
    display = latest(spelled, ["term"], [F.desc("n"), F.col("p")]).select("term", F.col("spelling").alias("display"))
    example = latest(found, ["term"], [F.desc("required"), F.desc("fit"), F.col("position")]).select("term", F.col("key").alias("example"))
    return sums.join(display, "term").join(example, "term")


def grouped_share(found: DataFrame) -> DataFrame:
    """Occurrences with a term over all; 1 when there are none."""
    return found.agg(F.coalesce(F.count("term") / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)).alias("grouped_share"))


def merged_terms(listed: DataFrame) -> DataFrame:
    """A9, SO4: ``term, host``: terms fold, longest first, into the shortest term whose tokens are a strict subset of theirs.

    A host may fold further, so hosts are followed to the end: a term's host is the shortest strict subset among the terms,
    and folding runs from longer to shorter, which makes the end of the chain independent of the order of equal lengths.
    A host is filed under its rarest token only, which every term that contains it has too; so terms that share a common token
    do not meet on it. The table has one row a term, however many gaps there are.
    """
    named = listed.select("term").distinct().withColumn("set", F.array_distinct(F.split("term", " ")))
    spread = written(named.select("term", "set", F.explode("set").alias("token")), "tokens")
    often = spread.groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", "token"))["token"].alias("token")
    other = spread.join(often, "token").groupBy(F.col("term").alias("host"), F.col("set").alias("host_set")).agg(rarest)
    pairs = spread.join(other, "token").filter((F.size("host_set") < F.size("set")) & (F.size(F.array_except("host_set", "set")) == 0)).select("term", "host").distinct()
    next_ = latest(pairs, ["term"], [F.length("host"), F.col("host")])
    step = written(named.join(next_, "term", "left").select("term", F.coalesce("host", "term").alias("host")), "hosts")
    while True:
        on = step.select(F.col("term").alias("__t"), F.col("host").alias("__h"))
        after = written(step.join(on, step.host == on["__t"]).select("term", F.col("__h").alias("host")), "hosts")
        if after.join(step, ["term", "host"], "left_anti").isEmpty():
            return after
        step = after


def field_gaps(adverts: DataFrame, level: int | None, spoken: list[str], years: float | None) -> DataFrame:
    """How many adverts ask a higher level, a language not spoken, more years. ``adverts``: key, level (rank), languages, years_min."""
    known = F.array(*[F.lit(s) for s in spoken]).cast("array<string>")
    missing = F.size(F.filter("languages", lambda x: ~F.array_contains(known, searchable(x))))
    short = F.when(F.col("level").isNull(), False).otherwise(F.lit(True) if level is None else F.col("level") > level)
    over = F.lit(False) if years is None else F.coalesce(F.col("years_min") > years, F.lit(False))
    return adverts.agg(F.count("*").alias("total"), F.count_if(short).alias("level"), F.coalesce(F.sum(missing), F.lit(0)).alias("languages"), F.count_if(over).alias("years"), F.max(F.when(over, F.col("years_min"))).alias("most_years"))


def missing_languages(adverts: DataFrame, spoken: list[str]) -> DataFrame:
    """Adverts that require each language not spoken, most common first."""
    known = F.array(*[F.lit(s) for s in spoken]).cast("array<string>")
    return adverts.select(F.explode("languages").alias("language")).filter(~F.array_contains(known, searchable("language"))).groupBy("language").agg(F.count("*").alias("n"))
