"""Payloads to adverts (S12-S21, P9-P11, T10, T11, F2, F7-F9, F18 of the survey): boards, feeds and pages as tables."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arith import moment
from tessera.functions.text import host_of, html_to_text, strip_contacts, unescape_entities, url_words

LEAST_TEXT = 200
COUNTRY_NAMES = ("NL", "NLD", "NETHERLANDS")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
POSTING = (
    "struct<`@type`:string,title:string,url:string,description:string,datePosted:string,validThrough:string,employmentType:string,"
    "identifier:string,hiringOrganization:string,jobLocation:string,jobLocationType:string>"
)


def clean(raw: Column) -> Column:
    """Plain text of HTML without contact details."""
    return strip_contacts(html_to_text(raw))


def recruitee(offers: DataFrame) -> DataFrame:
    """Description and requirements make the text."""
    return offers.withColumn("text", clean(F.concat_ws("\n", "description", "requirements")))


def greenhouse(jobs: DataFrame) -> DataFrame:
    """The content is escaped once more than HTML is."""
    return jobs.withColumn("text", clean(unescape_entities(F.col("content"))))


def listed_with_details(listing: DataFrame, details: DataFrame, known: DataFrame, keep: Column) -> DataFrame:
    """A listing without known ids, filtered, joined with the pages that were read for it."""
    return listing.filter(keep).join(known.select("id").distinct(), "id", "left_anti").join(details, "id")


def complete(listing: DataFrame, cap: int = 400) -> DataFrame:
    """Whether a board was listed to its end: as many rows as it says it has, and below the cap."""
    return listing.groupBy("board").agg(((F.count("*") >= F.max("total")) & (F.count("*") < cap)).alias("complete"))


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """The ``loc`` entries of sitemaps with the last change. ``maps``: site, xml."""
    entry = F.explode(F.regexp_extract_all("xml", F.lit("(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1)))
    one = maps.select("site", entry.alias("e"))
    return one.select("site", F.trim(F.regexp_extract("e", "(?s)<loc>(.*?)</loc>", 1)).alias("url"), moment(F.regexp_extract("e", "(?s)<lastmod>(.*?)</lastmod>", 1)).alias("changed"))


def feed_filter(languages: Column, posted: Column, now: Column, days: int, wanted: tuple[str, ...] = ("nl", "en")) -> Column:
    """No languages stated, or one wanted; and posted within the days."""
    fits = (F.coalesce(F.size(languages), F.lit(0)) == 0) | F.arrays_overlap(languages, F.array(*map(F.lit, wanted)))
    return F.coalesce(fits, F.lit(True)) & F.coalesce(posted >= now - F.expr(f"interval {days} days"), F.lit(True))


def scraped(rows: DataFrame, source: str) -> DataFrame:
    """Scraped rows as adverts; NaN and blanks become null, rows without id or url go, and the stored payload
    holds neither description nor e-mails nor nulls."""
    blank = lambda c: F.when(~F.trim(F.col(c).cast("string")).isin("", "NaN", "nan", "None"), F.trim(F.col(c).cast("string")))
    named = rows.select(*[blank(c).alias(c) for c in rows.columns]).filter("id is not null and job_url is not null")
    dropped = {"description", "emails"}
    payload = F.map_filter(F.create_map(*[x for c in rows.columns if c not in dropped for x in (F.lit(c), F.col(c))]), lambda k, v: v.isNotNull())
    text = clean(F.coalesce("description", F.lit("")))
    out = named.select(F.lit(source).alias("source"), F.regexp_replace("id", "^[a-z]{2}-", "").alias("source_id"), F.col("job_url").alias("url"), F.coalesce("title", F.lit("")).alias("title"), "company", text.alias("text"), F.to_json(payload).alias("raw"))
    return out.filter(F.length("text") >= LEAST_TEXT)


def is_dutch(country: Column, city: Column, location: Column, markers: tuple[str, ...]) -> Column:
    """a Dutch country name, or a marker anywhere in city and location."""
    place = F.lower(F.concat_ws(" ", F.coalesce(city, F.lit("")), F.coalesce(location, F.lit(""))))
    named = F.coalesce(F.upper(country).isin(*COUNTRY_NAMES), F.lit(False))
    return named | F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(place, m))


def postings_in(block: str | None) -> list[str]:
    """The JobPostings in one JSON text, as JSON: at the top, and in lists and graphs of any depth; none if it is no JSON."""
    try:
        waiting = [json.loads(block or "", parse_constant=_no_number)]
    except (ValueError, RecursionError):
        return []
    found = []
    while waiting:
        node = waiting.pop()
        if isinstance(node, list):
            waiting += reversed(node)
        elif isinstance(node, dict):
            kind = node.get("@type")
            if "JobPosting" in (kind if isinstance(kind, list) else [kind]):
                found.append(json.dumps(node, ensure_ascii=False))
            elif "@graph" in node:
                waiting.append(node["@graph"])
    return found


def _no_number(name: str) -> None:
    raise ValueError(name)


def json_ld(pages: DataFrame, page: str = "html") -> DataFrame:
    """Every JobPosting of the pages' JSON-LD blocks, a row each, in page order; a block that is no JSON is skipped.

    Spark finds the blocks; only those that name a JobPosting reach the walk through lists and graphs, which has no limit of depth.
    """
    block = "(?is)<script[^>]*type\\s*=\\s*[\"']?application/ld\\+json[\"']?[^>]*>(.*?)</script>"

    @F.arrow_udf("array<string>")
    def walk(blocks: pa.Array) -> pa.Array:
        return pa.array((postings_in(b.as_py()) for b in blocks), pa.list_(pa.string()))

    blocks = pages.select("*", F.explode(F.regexp_extract_all(page, F.lit(block), F.lit(1))).alias("__b")).filter(F.contains("__b", F.lit("JobPosting")))
    nodes = blocks.withColumn("__n", F.explode(walk("__b")))
    return nodes.withColumn("posting", F.from_json("__n", POSTING)).drop("__b", "__n")


def posting_adverts(postings: DataFrame, source: str, now: Column) -> DataFrame:
    """Adverts from postings that have not expired and hold 200 characters; the id falls back on the page's digest."""
    p = lambda f: F.col(f"posting.{f}")
    inner = lambda c, f: F.coalesce(F.get_json_object(c, f"$.{f}"), F.when(~F.startswith(c, F.lit("{")), c))
    place = F.when(F.startswith(p("jobLocation"), F.lit("[")), F.get_json_object(p("jobLocation"), "$[0]")).otherwise(p("jobLocation"))
    rows = postings.withColumns({"text": clean(F.coalesce(p("description"), F.lit(""))), "closes": moment(p("validThrough"))})
    kept = rows.filter((F.length("text") >= LEAST_TEXT) & ~F.coalesce(F.col("closes") < now, F.lit(False)))
    return kept.select(
        F.lit(source).alias("source"),
        F.coalesce(F.nullif(F.trim(inner(p("identifier"), "value")), F.lit("")), F.substring(F.sha2("url", 256), 1, 16)).alias("source_id"),
        F.coalesce(p("url"), F.col("url")).alias("url"), F.trim(p("title")).alias("title"), F.trim(inner(p("hiringOrganization"), "name")).alias("company"),
        F.get_json_object(place, "$.address.addressLocality").alias("city"), F.upper(inner(F.get_json_object(place, "$.address.addressCountry"), "name")).alias("country"),
        moment(p("datePosted")).alias("posted_at"), "text",
    )


class _Picker(HTMLParser):
    """Collects the text of elements that have an attribute value, with what is nested in them."""

    def __init__(self, name: str, value: str):
        super().__init__(convert_charrefs=True)
        self.wanted, self.depth, self.parts, self.found = (name, value), 0, [], []

    def handle_starttag(self, tag, attrs):
        if self.depth:
            self.depth += tag not in VOID
        elif tag not in VOID and self.wanted[1] in (dict(attrs).get(self.wanted[0]) or "").split():
            self.depth, self.parts = 1, []

    def handle_endtag(self, tag):
        if self.depth and tag not in VOID:
            self.depth -= 1
            if not self.depth:
                self.found.append("".join(self.parts))

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def elements(page: Column, attribute: str, value: str) -> Column:
    """The texts of the elements whose attribute holds the value among its words."""

    @F.pandas_udf("array<string>")
    def pick(pages: pd.Series) -> pd.Series:
        def one(html: str | None) -> list[str]:
            picker = _Picker(attribute, value)
            picker.feed(html or "")
            return picker.found

        return pages.map(one)

    return pick(page)


def refusal(status: Column, content: Column) -> Column:
    """why a response counts as refused, or null."""
    marker = F.lower(content).rlike("captcha|access denied|are you a robot|unusual traffic")
    return F.when(status == 429, "too many requests").when(status == 403, "forbidden").when(status.between(300, 399) & content.rlike("(?i)challenge|blocked"), "refusal redirect").when(marker, "refusal page")


def outbound(payload: Column, fields: tuple[str, ...]) -> Column:
    """The web links in some fields of a payload."""
    got = F.array_compact(F.array(*[F.get_json_object(payload, f"$.{f}") for f in fields]))
    return F.filter(got, lambda x: x.rlike("(?i)^https?://"))


def page_links(pages: DataFrame, page: str = "html") -> DataFrame:
    """Every ``href`` of the pages with its position, host and the words of its path."""
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all(page, F.lit("(?i)href\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))).alias("position", "link"))
    return links.withColumns({"host": host_of(F.col("link")), "words": url_words(F.col("link"))})
