import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_model as m
from tessera.llm import quality_rules as q
from tessera.llm.labelled import held_out, labelled_texts, sample, usable
from tessera.llm.text_stats import with_stats

FOLDER = "/root/testdata/sf0.01"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    threes = list(zip(words, words[1:], words[2:]))
    counts = Counter(threes)
    covered = {j for i, w in enumerate(threes) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_statistics(spark, awkward):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    rows = with_stats(docs).select("doc_id", "text", "stats.*").collect()
    assert all(tuple(r[c] for c in COLUMNS) == base(r.text) for r in rows)


def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_classifier_on_held_out_rows(spark):
    got = m.op2_quality_classifier(spark, FOLDER).join(labels(spark), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_scores_like_brute_force(spark):
    """Densities of the two classes from covariances written out, without moments, factors or centring."""
    x = {r.doc_id: np.array(r.x) for r in m.features(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    marked = {r.doc_id: r.quality for r in labels(spark).collect() if r.quality is not None}
    rows = [(x[d], q) for d, q in marked.items() if d in x and zlib.crc32(str(d).encode()) % 5]
    every = np.array([v for v, _ in rows])
    z = lambda v: (v - every.mean(0)) / every.std(0)
    groups = [z(np.array([v for v, q in rows if q == k])) for k in (0, 1)]
    covariances = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, covariances)) / len(rows)
    logs = []
    for g, c in zip(groups, covariances):
        c = 0.9 * c + 0.1 * pooled
        c = 0.99 * c + 0.01 * np.trace(c) / len(c) * np.eye(len(c))
        precision, prior = np.linalg.inv(c), np.log(len(g) / len(rows)) - 0.5 * np.linalg.slogdet(c)[1]
        logs.append({d: prior - 0.5 * (z(v) - g.mean(0)) @ precision @ (z(v) - g.mean(0)) for d, v in x.items()})
    got = {r.doc_id: r.score for r in m.op2_quality_classifier(spark, FOLDER).collect()}
    assert got.keys() == x.keys()
    for d, s in got.items():
        assert abs(s - 1 / (1 + math.exp(min(700, max(-700, logs[0][d] - logs[1][d]))))) < 1e-5


def covering(rows, points, most_rules=12, most_conditions=4, least_share=0.9, least_pruned=0.75, least_support=4, most_failures=3):
    """The decision list in plain Python over (values, bad, grow) with the same cut points: conditions as (name, cut, above)."""
    holds = lambda rule, v: all((v[f] > cut) == above for f, cut, above in rule)
    rules, tried = [], []
    while len(rules) < most_rules and len(tried) - len(rules) < most_failures:
        rule = ()
        while len(rule) < most_conditions:
            left = [(v, bad) for v, bad, grow in rows if grow and not any(holds(t, v) for t in tried) and holds(rule, v)]
            p, n = sum(bad for _, bad in left), sum(not bad for _, bad in left)
            if not p or not n:
                break
            best = (1e-9, None)
            for f in points:
                for cut in points[f]:
                    for above in (True, False):
                        covered = [bad for v, bad in left if (v[f] > cut) == above]
                        q = sum(covered)
                        if q >= least_support:
                            gain = q * (math.log2(q / len(covered)) - math.log2(p / (p + n)))
                            best = (gain, (f, cut, above)) if gain > best[0] else best
            if best[1] is None:
                break
            rule += (best[1],)
        if not rule:
            break
        reaching = [r for r in rows if not any(holds(t, r[0]) for t in rules)]
        share = lambda rule, kept: Counter(bad for v, bad, grow in reaching if kept(grow) and holds(rule, v))
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        pruned = [share(r, lambda grow: not grow) for r in prefixes]
        k = max(range(len(prefixes)), key=lambda k: ((pruned[k][True] - pruned[k][False]) / max(1, pruned[k].total()), -k))
        tried.append(prefixes[k])
        every = share(prefixes[k], lambda grow: True)
        if pruned[k][True] >= max(1, least_support // 2) and pruned[k][True] >= least_pruned * pruned[k].total() and every[True] >= least_share * every.total():
            rules.append(prefixes[k])
    return rules


def test_covering_like_brute_force(spark):
    stats = with_stats(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")).select("doc_id", "stats").join(usable(labels(spark)), "doc_id")
    values = stats.select(*[v.alias(k) for k, v in q.shares(F.col("stats")).items()], (F.col("label") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow"))
    names = values.columns[:-2]
    rows = [({n: r[n] for n in names}, r.bad, r.grow) for r in values.collect()]

    def quantiles(numbers):
        numbers = sorted(numbers)
        return {numbers[max(0, math.ceil((i + 1) / 25 * len(numbers)) - 1)] for i in range(24)} if numbers else set()

    points = {n: sorted(quantiles([v[n] for v, _, _ in rows]) | quantiles([v[n] for v, bad, _ in rows if bad])) for n in names}
    want = covering(rows, points)
    got = [tuple((c.feature, c.cut, c.above) for c in rule) for rule in q.learn_rules(stats)]
    assert got == want and want
    texts = {r.doc_id: r for r in q.op3_quality_rules(spark, FOLDER).collect()}
    shares = with_stats(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")).select("doc_id", *[v.alias(k) for k, v in q.shares(F.col("stats")).items()])
    for r in shares.collect():
        assert texts[r.doc_id].kept == (not texts[r.doc_id].base_failed and not any(all((r[f] > cut) == above for f, cut, above in rule) for rule in want))


def test_classifier_takes_awkward_rows(spark, awkward):
    few = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None), (1, 1)], "doc_id bigint, quality int")
    out = m.scored_documents(awkward, few).collect()
    assert len(out) == awkward.count() and all(r.score is not None for r in out)
    assert m.scored_documents(awkward.limit(0), few).count() == 0


def test_rules_on_held_out_rows(spark):
    """Over the larger table: the small one holds out four bad documents that the base thresholds let pass."""
    large = FOLDER.replace("0.01", "0.1")
    marked = spark.read.parquet(f"{large}/labels.parquet")
    got = q.op3_quality_rules(spark, large).join(marked, "doc_id").filter(held_out(F.col("doc_id"))).filter("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality], [r.kept for r in got if not r.quality]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_rules_are_read_in_order(spark, awkward):
    stats = with_stats(awkward).select("doc_id", "stats")
    rules = [(q.Condition("symbols", 0, 0.0, True),), (q.Condition("log_words", 0, 1.0, False),)]
    got = {r.doc_id: r.kept for r in q.judged(stats, rules, least_words=0).collect()}
    assert got[7] is False and got[2] is False and got[5] is False and got[None] is True
    assert all(r.kept for r in q.judged(stats, [], least_words=0, most_repeats=100).collect())


def test_no_labels_no_rules(spark, awkward):
    none = with_stats(awkward).select("doc_id", "stats").withColumn("label", F.lit(1)).limit(0)
    assert q.learn_rules(none) == []


@pytest.mark.parametrize("most", [50, 10_000])
def test_bounded_sample(spark, most):
    rows = usable(labels(spark))
    n = rows.count()
    assert sample(rows, most).count() <= min(n, most * 1.6)
    assert labelled_texts(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels(spark), most).count() <= min(n, most * 1.6)
