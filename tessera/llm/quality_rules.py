"""Quality rules: an ordered decision list learned by sequential covering, in DataFrame functions only.

Labelled documents become transformed statistics, and each statistic a bin among cut points taken from its quantiles. A
rule is a conjunction of thresholds for label 0. It grows on two thirds of the rows, condition by condition with the
largest information gain; every step is one grouped count over (statistic, bin) of the rows still covered. On the last
third the rule is cut back to the prefix with the best share of label 0, and taken if its shares there and overall and its support are high enough;
rows it covers leave either way, and the next rule is grown, until three have not been taken. The list becomes one Spark conditional expression. What reaches the driver are counts: at most statistics times bins.

Defined cases: a null text counts as empty; equal rows are each judged; a null doc_id is judged and never learned from; no
usable labels give an empty list that keeps everything; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.labelled import usable
from tessera.llm.text_stats import shares, with_stats


@dataclass(frozen=True)
class Condition:
    feature: str
    at: int  # the number of its cut point among the feature's
    cut: float
    above: bool

    def holds(self, value: Column) -> Column:
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def rejected(rules: list[Rule], values: dict[str, Column]) -> Column:
    """The list as a conditional expression: true at the first rule that fits, else false."""
    each = [reduce(lambda a, b: a & b, [c.holds(values[c.feature]) for c in rule]) for rule in rules]
    return reduce(lambda rest, fits: F.when(fits, True).otherwise(rest), reversed(each), F.lit(False))


def learn_rules(rows: DataFrame, *, most_rules: int = 12, most_conditions: int = 4, cuts: int = 24, least_share: float = 0.9, least_pruned: float = 0.75, least_support: int = 4, most_failures: int = 3) -> list[Rule]:
    """``rows``: a struct ``stats`` and ``label``."""
    names = list(shares(F.col("stats")))
    wide = written(rows.select(F.struct(*[v.alias(k) for k, v in shares(F.col("stats")).items()]).alias("x"), (F.col("label") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow")), "labelled")
    steps = [(i + 1) / (cuts + 1) for i in range(cuts)]
    quantiles = lambda n, kept: F.percentile_approx(F.when(kept, F.col(f"x.{n}")), steps, 10_000)
    first = wide.agg(*[q.alias(f"{n}_{k}") for n in names for k, q in (("all", quantiles(n, F.lit(True))), ("bad", quantiles(n, F.col("bad"))))]).first()
    points = {n: sorted(set((first[f"{n}_all"] or []) + (first[f"{n}_bad"] or []))) for n in names}
    def bin_of(name: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(p)) for p in points[name]]), lambda p: F.col(f"x.{name}") > p))

    bins = F.array(*map(bin_of, names))
    if not any(points.values()):
        return []
    binned = written(wide.select("bad", "grow", bins.alias("bins")), "binned")

    def fits(rule: Rule) -> Column:
        tests = [(F.col("bins")[names.index(c.feature)] > c.at) if c.above else (F.col("bins")[names.index(c.feature)] <= c.at) for c in rule]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def best_condition(left: DataFrame, rule: Rule) -> Condition | None:
        kept = left.filter(F.col("grow") & fits(rule)).select("bad", F.posexplode("bins").alias("feature", "bin"))
        counts = kept.groupBy("feature", "bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        total_p, total_n = (sum(r[k] for r in counts if r["feature"] == 0) for k in ("p", "n"))
        if not total_p or not total_n:
            return None
        found = (1e-9, None)
        for f, name in enumerate(names):
            got = sorted((r for r in counts if r["feature"] == f), key=lambda r: r["bin"])
            for j, point in enumerate(points[name]):
                p, n = (sum(r[k] for r in got if r["bin"] > j) for k in ("p", "n"))
                for above, p, n in ((True, p, n), (False, total_p - p, total_n - n)):
                    if p >= least_support:
                        gain = p * (log2(p / (p + n)) - log2(total_p / (total_p + total_n)))
                        if gain > found[0]:
                            found = (gain, Condition(name, j, float(point), above))
        return found[1]

    def uncovered(by: list[Rule]) -> DataFrame:
        return binned.filter(~reduce(lambda a, b: a | b, map(fits, by))) if by else binned

    rules: list[Rule] = []
    tried: list[Rule] = []
    while len(rules) < most_rules and len(tried) - len(rules) < most_failures:
        left = uncovered(tried)
        rule: Rule = ()
        while len(rule) < most_conditions and (c := best_condition(left, rule)):
            rule += (c,)
        if not rule:
            break
        prefixes = [rule[:k] for k in range(1, len(rule) + 1)]
        pruning = ~F.col("grow")
        seen = uncovered(rules).agg(*[F.count_if(fits(r) & kind & where).alias(f"{name}{k}") for k, r in enumerate(prefixes) for name, kind, where in (("p", F.col("bad"), pruning), ("n", ~F.col("bad"), pruning), ("all_p", F.col("bad"), F.lit(True)), ("all_n", ~F.col("bad"), F.lit(True)))]).first()
        worth = [((seen[f"p{k}"] - seen[f"n{k}"]) / max(1, seen[f"p{k}"] + seen[f"n{k}"]), -k) for k in range(len(prefixes))]
        k = -max(worth)[1]
        p, n = seen[f"p{k}"], seen[f"n{k}"]
        tried.append(prefixes[k])
        all_p, all_n = seen[f"all_p{k}"], seen[f"all_n{k}"]
        if p >= max(1, least_support // 2) and p >= least_pruned * (p + n) and all_p >= least_share * (all_p + all_n):
            rules.append(prefixes[k])
    return rules


def judged(stats: DataFrame, rules: list[Rule], *, least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """Adds ``base_failed`` (few words, or over ``most_repeats`` percent of them in repeated windows) and ``kept``."""
    s = F.col("stats")
    failed = (s["n_words"] < least_words) | (100 * s["n_repeat_words"] > most_repeats * s["n_words"])
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~rejected(rules, shares(s)))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats = written(with_stats(docs.select("doc_id", "text")).select("doc_id", "stats"), "stats")
    rules = learn_rules(stats.join(usable(spark.read.parquet(f"{sf_dir}/labels.parquet")), "doc_id"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(stats, rules).select("doc_id", *[f"stats.{c}" for c in columns], "base_failed", "kept")
