"""Documents and queries for embedding (P1-P4, V8, V10, V14-V17, F12, A37 of the survey)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arith import range_text
from tessera.functions.text import chunks, vector_key
from tessera.operators.ranking import pooled_scores, whole_ranks
from tessera.operators.shortlist import fused_prefix, whole_order
from tessera.session import ranked


def labelled(label: str, value: Column) -> Column:
    text = value.cast("string")
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"{label}: "), text))


def structured(d: Column) -> Column:
    """Title and a labelled line for each stated field; empty lists, empty texts and 0 years are not stated."""
    salary = range_text(d["salary_min"], d["salary_max"])
    years = F.when(d["experience_years_min"] > 0, F.concat(d["experience_years_min"].cast("string"), F.lit(" jaar")))
    lines = (
        ("Bedrijf", d["company"]), ("Plaats", d["city"]), ("Werkvorm", d["work_mode"]), ("Uren per week", range_text(d["hours_min"], d["hours_max"])),
        ("Dienstverband", d["contract_type"]), ("Opleidingsniveau", d["education_level"]), ("Werkervaring", years),
        ("Salaris", F.coalesce(F.concat(salary, F.lit(" per "), d["salary_period"]), d["salary_note"])),
        ("Vaardigheden", F.array_join(d["skills"], ", ")), ("Talen", F.array_join(d["languages_required"], ", ")),
    )
    return F.concat_ws("\n", F.nullif(d["title"], F.lit("")), *[labelled(*line) for line in lines])


def documents(adverts: DataFrame, details: DataFrame, style: str) -> DataFrame:
    """The text to embed in a style; every style but raw drops adverts without details."""
    if style == "raw":
        return adverts.withColumn("document", F.col("text"))
    joined = adverts.join(details.select("key", F.col("details").alias("__d")), "key")
    d = F.col("__d")
    text = {"title_only": d["title"], "structured": structured(d), "structured_raw": F.concat_ws("\n\n", structured(d), "text")}[style]
    return joined.withColumn("document", text).drop("__d")


def oversized(docs: DataFrame, most: int = 20_000) -> DataFrame:
    """documents longer than an embedder takes."""
    return docs.filter(F.length("document") > most)


def query_parts(cvs: DataFrame, style: str) -> DataFrame:
    """The parts of a CV that ask by themselves: ``cv, part, label, text``.

    ``cvs``: cv, text, summary, experience (title, company, summary), background. Styles: raw, profile, roles, chunks.
    """
    if style == "chunks":
        return cvs.select("cv", F.posexplode(chunks(F.col("text"))).alias("part", "text")).select("cv", "part", F.concat(F.lit("part "), (F.col("part") + 1).cast("string")).alias("label"), "text")
    if style == "roles":
        role = F.transform("experience", lambda e: F.struct(F.concat_ws(" · ", e["title"], e["company"]).alias("label"), F.concat_ws("\n", e["title"], e["company"], e["summary"]).alias("text")))
        rest = F.array(F.struct(F.lit("background").alias("label"), F.col("background").alias("text")))
        every = F.filter(F.concat(F.coalesce(role, F.array().cast("array<struct<label:string,text:string>>")), rest), lambda p: F.coalesce(p["text"], F.lit("")) != "")
        return cvs.select("cv", F.posexplode(every).alias("part", "p")).select("cv", "part", "p.label", "p.text")
    text = {"raw": F.col("text"), "profile": F.col("summary")}[style]
    return cvs.select("cv", F.lit(0).alias("part"), F.lit(style).alias("label"), text.alias("text"))


def cache_split(docs: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Documents with their ``vector_key`` and the vector the cache has for it, and the different texts that it misses (``key, document``)."""
    keyed = docs.withColumn("vector_key", vector_key(F.lit(model), F.col("document")))
    missing = keyed.select(F.col("vector_key").alias("key"), "document").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    return keyed.join(cache.select(F.col("key").alias("vector_key"), "vector"), "vector_key"), missing


def with_vectors(docs: DataFrame, cache: DataFrame, model: str, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Documents with their vectors, and the cache entries that were missing; each different text is asked for once. ``cache``: key, vector; ``embed``: vectors of texts by a model."""
    _, missing = cache_split(docs, cache, model)
    made = missing.select("key", embed(F.col("document")).alias("vector"))
    return cache_split(docs, cache.select("key", "vector").unionByName(made), model)[0], made


def rank_for_cv(parts: DataFrame, docs: DataFrame, top: int | None = None) -> DataFrame:
    """The corpus for one CV: each document's best part. ``parts``: part, label, vector; ``docs``: doc_id, vector."""
    found = pooled_scores(parts.select(F.col("part").alias("query_id"), "vector"), docs)
    labelled_ = found.join(parts.select(F.col("part").alias("query_id"), "label"), "query_id")
    out = ranked(labelled_, [], [F.desc("score"), F.col("doc_id")])
    return out.filter(F.col("rank") <= top) if top else out


def as_lists(styles: list[DataFrame]) -> DataFrame:
    """``query_id, list_no, vector`` of the parts of each style, one list a style."""
    lists = None
    for number, parts in enumerate(styles):
        mine = parts.select(F.col("part").alias("query_id"), F.lit(number).alias("list_no"), "vector")
        lists = mine if lists is None else lists.unionByName(mine)
    return lists


def fused_for_cv(styles: list[DataFrame], docs: DataFrame, top: int | None = None) -> DataFrame:
    """One ranking for each style, fused: ``doc_id, points, best_list, rank``. ``styles``: tables of parts, in the order of an ``a+b`` style.

    With ``top`` only the first of the fused order (and those level with the last), without whole rankings.
    """
    return fused_prefix(as_lists(styles), docs, top)[0] if top else whole_order(as_lists(styles), docs)


def search(queries: DataFrame, docs: DataFrame, top: int) -> DataFrame:
    """The full order cut at ``top`` for each of a few queries; 0 means all."""
    order = whole_ranks(queries, docs)
    return order.filter(F.col("rank") <= top) if top else order
