"""Audit of how sources of one language differ in their words.

Terms are runs of letters (ASCII letters, only those lower-cased, and every other non-ASCII character). A language keeps the terms that at
least ``least_docs`` of its documents hold. Each group (language, source) and each language as a whole gives each kept term
the smoothed share ``p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``.

* Tasks count terms of their texts and send a row for each group and term, so a hot term or source is summed before it travels.
* The kept counts of a language are dealt to blocks of terms. A block is one dense int64 matrix, groups by terms; all pairs
  of its rows are compared by broadcasting, and each group's heap holds its block's largest gains over the language.
* Partial pair matrices are summed and heaps are merged by Spark. A block has at most about ``CELLS`` cells, whatever a language's size.

Defined cases: a null text, language or source is the empty string; a group without kept terms still has its pairs (value 0 if its language
keeps no term); repeated rows count as often as they stand; an empty table gives an empty result; other columns are
ignored. All numbers are exact for counts up to 9 * 10**15.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

SCALE, SMOOTH = 1_000_000_000, 5
#: Cells of a block's matrix, and the most and fewest terms of a block.
CELLS, MOST_TERMS, LEAST_TERMS = 1 << 18, 4096, 64
#: Terms that a task counts before it sends them on.
MOST_COUNTED = 300_000
#: Languages whose statistics are broadcast; of more, they are joined by a shuffle.
MOST_LANGS = 10_000

_LETTERS = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: bytes of other characters become spaces, on which the text is split."""
    return text.translate(_LETTERS).split()


def _sent(counts: dict) -> pa.RecordBatch:
    """Rows ``lang, source, term, n, docs`` of what was counted."""
    groups = list(counts)
    sizes = [len(counts[g][0]) for g in groups]
    of = pa.array(np.repeat(np.arange(len(groups)), sizes))
    terms = [t for g in groups for t in counts[g][0]]
    seen, docs = (np.fromiter((counts[g][0][t] if k == 0 else counts[g][1][t] for g in groups for t in counts[g][0]), np.int64, len(terms)) for k in (0, 1))
    columns = [pa.array([g[k] for g in groups], pa.string()).take(of) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(seen), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def _counter(most: int):
    """The function that counts the terms of a task's texts and holds at most about so many of them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                n, docs = counts[lang.as_py(), source.as_py()]
                held -= len(n)
                n.update(terms)
                docs.update(set(terms))
                held += len(n)
                if held > most:
                    yield _sent(counts)
                    counts.clear()
                    held = 0
        if held:
            yield _sent(counts)

    return counted


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """``lang, source, term, n`` of the terms that a language keeps; ``docs`` has lang, source and text without nulls.

    One exchange by language and term serves the sums of a group and those of the language.
    """
    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    parts = rows.mapInArrow(_counter(MOST_COUNTED), "lang string, source string, term string, n bigint, docs bigint").repartition("lang", "term")
    sums = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    docs_of_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return sums.withColumn("docs", docs_of_lang).filter(F.col("docs") >= least_docs).drop("docs")


def shares(count: np.ndarray, total) -> np.ndarray:
    """``1 + floor(SCALE * (count + SMOOTH) / total)`` in int64, three decimal places at a time; total is at least the numerator."""
    whole, rest = np.divmod(count + SMOOTH, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def pair_sums(p: np.ndarray, rows: int = 64, terms: int = 256) -> np.ndarray:
    """For all pairs of rows the sum of absolute differences; pieces of ``rows * rows * terms`` cells are compared at once."""
    g, out = len(p), np.zeros((len(p), len(p)), np.int64)
    for i in range(0, g, rows):
        for j in range(i, g, rows):
            for t in range(0, p.shape[1], terms):
                a, b = p[i : i + rows, t : t + terms], p[j : j + rows, t : t + terms]
                out[i : i + rows, j : j + rows] += np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)
    return out


def _block(counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """A block's partial pair sums (``a < b``) and each group's heap; ``groups`` has all groups of the language with its totals."""
    groups = groups.to_pydict()
    order = sorted(range(len(groups["source"])), key=lambda i: groups["source"][i].encode())
    sources = [groups["source"][i] for i in order]
    place = {s: i for i, s in enumerate(sources)}
    terms = sorted(set(counts["term"].to_pylist()), key=str.encode)
    column = {t: i for i, t in enumerate(terms)}
    n = np.zeros((len(sources), len(terms)), np.int64)
    n[[place[s] for s in counts["source"].to_pylist()], [column[t] for t in counts["term"].to_pylist()]] = counts["n"].to_numpy()
    smooth, lang = SMOOTH * groups["v"][0], groups["lang"][0]
    if terms:
        p = shares(n, np.array([groups["n"][i] for i in order], np.int64)[:, None] + smooth)
        sums, gain = pair_sums(p), p - shares(n.sum(axis=0), np.int64(groups["n_lang"][0] + smooth))
    else:
        sums, gain = np.zeros((len(sources), len(sources)), np.int64), n
    out = [("pair", sources[i], sources[j], int(sums[i, j])) for i in range(len(sources)) for j in range(i + 1, len(sources))]
    for i, source in enumerate(sources):
        better = np.nonzero((n[i] > 0) & (gain[i] > 0))[0]
        heap = heapq.nsmallest(top, zip((-gain[i, better]).tolist(), better.tolist()))
        out += [("term", source, terms[t], -f) for f, t in heap]
    part, source, item, value = zip(*out) if out else ((), (), (), ())
    texts = [pa.array(x, pa.string()) for x in ([lang] * len(out), source, part, item)]
    return pa.Table.from_arrays([*texts, pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def source_audit(docs: DataFrame, *, least_docs: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: of each group the distance to every other one, and the ``top`` terms that set it off."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = written(kept_counts(docs, least_docs), "kept_counts")
    groups = docs.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    langs = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("n_lang"))
    of_lang = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(langs, "lang", "left").na.fill(0, ["v", "n_lang"])
    width = F.greatest(F.lit(LEAST_TERMS), F.least(F.lit(MOST_TERMS), F.lit(CELLS) / F.col("groups")))
    langs = written(of_lang.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / width))), "langs")
    if langs.count() <= MOST_LANGS:
        langs = F.broadcast(langs)
    number = F.pmod(F.xxhash64("term"), F.col("blocks"))
    tiles = counts.join(langs.select("lang", "blocks"), "lang").select("lang", number.alias("block"), "source", "term", "n")
    members = groups.na.fill(0, ["n"]).join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    members = members.select("lang", "block", "source", "n", "v", "n_lang")
    schema = "lang string, source string, part string, item string, value bigint"
    found = tiles.groupBy("lang", "block").cogroup(members.groupBy("lang", "block")).applyInArrow(lambda a, b: _block(a, b, top), schema)
    found = written(found, "blocks")
    half = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.withColumn("rank", F.row_number().over(order))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op11_source_audit(spark, sf_dir: str) -> DataFrame:
    return source_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
of_lang AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.n, 0) + 5 * v.v) AS p,
         1 + (1000000000::HUGEINT * (o.n + 5)) // (o.total + 5 * v.v) AS q
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) JOIN of_lang o ON o.lang = g.lang AND o.term = k.term
  LEFT JOIN total t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM placed WHERE part = 'pair' OR rank <= 50
"""
