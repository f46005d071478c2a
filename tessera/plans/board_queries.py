"""Queries of boards and structured data, over whole ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.plans.registry import query
from tessera.session import new_folder, table
from tessera.sources import boards, postings


def _listing(spark, folder) -> DataFrame:
    """Pages as the jobs of their sites, posted on one of sixty days."""
    url = F.col("url")
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    return table(spark, folder, "pages").select(t.site_of(t.host_of(url)).alias("site"), F.format_string("%08d", "page_id").alias("id"), t.url_words(url).alias("title"), lang.alias("lang"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")).alias("posted"))


_SITES = r"""
j as (select page_id, array_to_string(list_reverse(list_slice(list_reverse(string_split(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '.')), 1, 2)), '.') as site, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, date '2024-01-01' + (page_id % 60)::int as posted from pages)"""


@query(f"""with {_SITES}
select site, count(*) as listed, count(*) as total, count(*) < 400 as complete, count(*) filter (where lang in ('en', 'de') and posted >= date '2024-01-20') as fitting,
  min(printf('%08d', page_id)) filter (where lang in ('en', 'de') and posted >= date '2024-01-20') as first from j group by site""")
def listed_pages(spark, folder):
    """Every site's listing read page by page, whether it is complete, and what a search by language and age gives."""
    path = new_folder(spark, "boards")
    boards.write_boards(_listing(spark, folder), path, 20)
    read, searched = boards.boards(spark, path, 2), boards.boards(spark, path, 2)  # what is pushed into a source holds for all that reads it
    fitting = searched.filter(F.col("lang").isin("en", "de") & (F.col("posted") >= F.lit("2024-01-20").cast("date")))
    found = fitting.groupBy("site").agg(F.count("*").alias("fitting"), F.min("id").alias("first"))
    return boards.completeness(read).join(found, "site", "left").na.fill(0, ["fitting"])


@query(r"""
with p as (select page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1) as title, length(html) as size, page_id % 9 as depth from pages)
select page_id, 'posting ' || page_id || ' of ' || copies.n as title, size, depth from p, (values (1), (2)) copies(n) where page_id % 10 <> 7""")
def nested_postings(spark, folder):
    """Two JobPostings a page in lists and graphs, up to eight deep, beside a broken block; every tenth page has only the broken one."""
    p = table(spark, folder, "pages")
    one = lambda n: F.to_json(F.struct(F.when(F.col("page_id") % 2 == 0, F.lit('"JobPosting"')).otherwise(F.lit('["Thing", "JobPosting"]')).alias("@type"), F.concat(F.lit("posting "), "page_id", F.lit(f" of {n}")).alias("title"), "url", F.length("html").cast("string").alias("description")))
    typed = lambda x: F.regexp_replace(F.regexp_replace(x, r'"@type":"(\[?\\"[^}]*?\\"\]?)"', '"@type":$1'), r'\\"', '"')
    depth = F.col("page_id") % 9
    body = F.concat(F.lit("["), typed(one(1)), F.lit(',{"@type":"Thing"},'), typed(one(2)), F.lit("]"))
    wrap = F.aggregate(F.when(depth > 0, F.sequence(F.lit(1).cast("bigint"), depth)).otherwise(F.array().cast("array<bigint>")), body, lambda x, n: F.when(n % 3 == 0, F.concat(F.lit('{"@context":"x","@graph":'), x, F.lit("}"))).otherwise(F.concat(F.lit("["), x, F.lit(',{"@graph":[]}]'))))
    block = lambda x: F.concat(F.lit('<script type="application/ld+json">'), x, F.lit("</script>"))
    pages = p.select("page_id", "url", depth.alias("depth"), F.concat(F.col("html"), block(F.lit('{"@type":"JobPosting",')), F.when(F.col("page_id") % 10 != 7, block(wrap)).otherwise(F.lit(""))).alias("html"))
    return postings.json_ld(pages).select("page_id", F.col("posting.title").alias("title"), F.col("posting.description").cast("bigint").alias("size"), "depth")
