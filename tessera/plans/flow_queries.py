"""Whole flows: a match run from corpus to stored rows, and an evaluation from queries to metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import documents, ranking
from tessera.plans.registry import query
from tessera.session import latest, narrowed, table, written
from tessera.sources import sinks


def match(adverts: DataFrame, parts: list[DataFrame], conflicts: DataFrame, cap: int, top: int) -> DataFrame:
    """The match of one CV: fused ranking of the corpus, preference re-rank, employer cap.

    ``adverts``: doc_id, employer, vector; ``parts``: tables of query parts for each style; ``conflicts``: doc_id, conflicts.
    Every advert stays in the result, with ``rank``, ``before``, ``chosen`` and ``capped``.
    """
    fused = documents.fused_for_cv(parts, adverts.select("doc_id", "vector"))
    named = fused.join(adverts.select("doc_id", "employer"), "doc_id").join(conflicts, "doc_id")
    order = written(ranking.rerank(named, "rank", "conflicts"), "reranked")
    return ranking.cap_per_group(order, "employer", "rank", cap, top)


@query("""
with p as (select 0 as style, vec_id as part, embedding as v from embeddings where label = 0 union all select 1, vec_id, embedding from embeddings where label = 1),
s as (select style, d.vec_id as doc_id, max(round(list_cosine_similarity(p.v::double[], d.embedding::double[]), 6) + 0.0) as score from p, embeddings d group by 1, 2),
r as (select *, row_number() over (partition by style order by score desc, doc_id) as pos from s),
f as (select doc_id, round(sum(1.0 / (60 + pos)), 12) as points, min(pos) filter (where style = 0) as in_first from r group by 1),
o as (select doc_id, row_number() over (order by points desc, in_first) as before from f),
c as (select o.*, label, case when label in (2, 3) then 1 else 0 end as conflicts from o join embeddings on doc_id = vec_id),
k as (select *, row_number() over (order by conflicts, before) as rank from c),
n as (select *, row_number() over (partition by label order by rank) as n from k),
h as (select rank from n where n <= 3 order by rank limit 12)
select k.doc_id, k.before, k.rank, h.rank is not null as chosen, h.rank is null and k.rank < (select max(rank) from h) as capped from k left join h on k.rank = h.rank""")
def match_flow(spark, folder):
    """Flow A (V8, V15, V16, O2, W3, W5, P8): vectors of label 0 and of label 1 as the parts of a CV in two styles."""
    e = table(spark, folder, "embeddings")
    adverts = e.select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("employer"), F.col("embedding").alias("vector"))
    parts = [e.filter(F.col("label") == n).select(F.col("vec_id").alias("part"), F.col("vec_id").cast("string").alias("label"), F.col("embedding").alias("vector")) for n in (0, 1)]
    odd = e.select(F.col("vec_id").alias("doc_id"), F.when(F.col("label").isin(2, 3), F.array(F.lit("salary"))).otherwise(F.array().cast("array<string>")).alias("conflicts"))
    return match(adverts, parts, odd, 3, 12).select("doc_id", "before", "rank", "chosen", "capped")


@query("""
with d as (select doc_id, sha256('m1' || chr(0) || text) as vector_key from documents),
c as (select vector_key, min(vec_id) as vec_id from d join embeddings on doc_id = vec_id and vec_id % 2 = 0 group by 1)
select d.vector_key, c.vec_id is not null as hit, count(*) as documents, max(len(embedding))::double as dims from d left join c on d.vector_key = c.vector_key left join embeddings e on c.vec_id = e.vec_id group by 1, 2""")
def indexed_corpus(spark, folder):
    """Flow B (J1, P2, V10, V11, K11, A37): documents against a cache that holds the vectors of every second one; which texts are still to embed."""
    d = table(spark, folder, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), "text")
    docs = documents.documents(d, d, "raw")
    stored = table(spark, folder, "embeddings").filter("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("vector"))
    known = docs.join(stored, docs.doc_id == stored.vec_id).select(t.vector_key(F.lit("m1"), F.col("document")).alias("key"), "vec_id", "vector")
    found, missing = documents.cache_split(docs, latest(known, ["key"], [F.col("vec_id")]), "m1")
    n = docs.groupBy(t.vector_key(F.lit("m1"), F.col("document")).alias("vector_key")).agg(F.count("*").alias("documents"))
    hits = sinks.distinct_vectors(found.select(F.col("vector_key").alias("key"), "vector")).select(F.col("key").alias("vector_key"), F.lit(True).alias("hit"), F.size("vector").cast("double").alias("dims"))
    rest = missing.select(F.col("key").alias("vector_key"), F.lit(False).alias("hit"), F.lit(None).cast("double").alias("dims"))
    return hits.unionByName(rest).join(n, "vector_key")


@query()
def quoted_passages(spark, folder):
    """Benchmark passages of which any eight words in a row stand in documents as whole words; shorter passages whole.

    Quotes and texts meet on the smallest hash of five words in a row of each quote, read in each of T4's ways; a text files the smallest of
    every four, so no quote is tried on every text. Hashes, then texts, are narrowed to those that may meet a quote before they travel. A
    passage without a letter or digit is quoted nowhere.
    """
    word = F.split(t.squeeze(F.col("text")), " ")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("word") - 7))
    quotes = table(spark, folder, "benchmark").select("item_id", word.alias("word"))
    quotes = quotes.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("word", i, 8), " "))).alias("quote")).distinct()
    read = F.explode(F.array(*[t.quote_key(F.col("quote"), w) for w in t.LINE_ENDS]))
    keyed = written(quotes.select("item_id", "quote", read.alias("k")).select("item_id", "quote", "k.n", "k.key").filter("n > 0").distinct(), "quotes")
    sizes = sorted(r.n for r in keyed.select("n").distinct().collect())  # t.QUOTE at most
    texts = table(spark, folder, "documents").select("doc_id", "text")
    filed = texts.select("doc_id", F.explode(t.winnowed(F.col("text"), sizes or [t.QUOTE])).alias("key"))
    met = narrowed(filed, F.col("key"), keyed, "key").join(keyed, "key").groupBy("doc_id", "item_id").agg(F.collect_set("quote").alias("quotes"))
    pairs = written(met, "quoted")
    asked = narrowed(texts, F.col("doc_id"), pairs, "doc_id")
    return pairs.join(asked, "doc_id").filter(F.exists("quotes", lambda q: t.quoted(q, F.col("text")))).select("item_id", "doc_id")


@query("""
with f as (select l_orderkey, l_linenumber, l_quantity::int as fit, l_extendedprice, case when l_quantity >= 45 then 2 when l_quantity >= 20 then 1 else 0 end as v from lineitem)
select l_orderkey, fit, v, count(*) as n, rank() over (order by v desc, fit desc) as place from f group by 1, 2, 3""")
def ranked_verdicts(spark, folder):
    """Rows by verdict and fit, ties sharing a place; counted first, so the order runs over few different keys."""
    line = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("fit"))
    v = F.when(F.col("fit") >= 45, 2).when(F.col("fit") >= 20, 1).otherwise(0)
    rows = line.groupBy("l_orderkey", "fit").agg(F.count("*").alias("n")).withColumn("v", v)
    cells = rows.groupBy("v", "fit").agg(F.count("*").alias("c"))
    keys = ranking_places(cells)
    return rows.join(F.broadcast(keys), ["v", "fit"]).select("l_orderkey", "fit", "v", "n", "place")


def ranking_places(cells: DataFrame) -> DataFrame:
    """Places of (verdict, fit) pairs: at most 101 fits in three bands."""
    from pyspark.sql import Window

    w = Window.orderBy(*[F.desc("v"), F.desc("fit")]).rowsBetween(Window.unboundedPreceding, -1)
    return cells.select("v", "fit", (F.coalesce(F.sum("c").over(w), F.lit(0)) + 1).alias("place"))


