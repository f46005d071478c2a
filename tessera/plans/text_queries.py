"""Queries of text, documents, dedupe, gazetteers and links over ``documents``, ``pages``, ``part``, ``nation``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import dedupe, documents, preferences, reports, windows
from tessera.plans.registry import query
from tessera.session import table, written
from tessera.sources import postings

_SIMPLE = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"select doc_id, {_SIMPLE.format('text')} as simple from documents")
def simplify_titles(spark, folder):
    """Every whole text simplified."""
    return table(spark, folder, "documents").select("doc_id", t.simplify(F.col("text")).alias("simple"))


@query("select doc_id, regexp_replace(text, '\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b', '[email removed]', 'g') as text from documents")
def redact_contacts(spark, folder):
    """E-mail addresses and phone numbers replaced (the tables hold no number of the phone's shape)."""
    return table(spark, folder, "documents").select("doc_id", t.strip_contacts(F.col("text")).alias("text"))


@query()
def redaction_counts(spark, folder):
    """Removals by kind for every text."""
    redacted, counts = t.redacted(F.col("made"))
    return table(spark, folder, "documents").select("doc_id", t.redaction(F.col("text")).alias("made")).select("doc_id", F.length(redacted).alias("left"), *[v.alias(k.replace(" ", "_")) for k, v in counts.items()])


_HTML = """
with a as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<(br|hr)\\s*/?>', chr(10), 'g'), '(?i)<li[^>]*>', chr(10) || '- ', 'g'), '(?i)</(p|div|li|h[1-6]|tr|section|article)>', chr(10), 'g'), '<[^>]+>', '', 'g') as x from pages),
b as (select page_id, replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as x from a),
c as (select page_id, list_transform(string_split(x, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(13))) as l from b)
select page_id, trim(regexp_replace(array_to_string(l, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as text from c"""


@query(_HTML)
def html_to_text(spark, folder):
    """The text of every page."""
    return table(spark, folder, "pages").select("page_id", t.html_to_text(F.col("html")).alias("text"))


@query("""
with k as (select page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://(www\\.)?', ''), '[?#].*$', ''), '/+$', '') as page_key, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) as host from pages)
select page_id, page_key, host, array_to_string(list_reverse(list_slice(list_reverse(string_split(host, '.')), 1, 2)), '.') as site, trim(regexp_replace(regexp_extract(page_key, '([^/]*)$', 1), '[^a-z0-9]+', ' ', 'g')) as words from k""")
def page_keys(spark, folder):
    """Key, host, site and title words of every page's address."""
    url = F.col("url")
    return table(spark, folder, "pages").select("page_id", t.page_key(url).alias("page_key"), t.host_of(url).alias("host"), t.site_of(t.host_of(url)).alias("site"), t.url_words(url).alias("words"))


@query("""
with l as (select page_id, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1)) as link from pages),
h as (select *, regexp_extract(lower(link), '^[a-z]+://([^/:?#]+)', 1) as host from l where regexp_matches(link, '(?i)^https?://'))
select 'site:' || array_to_string(list_reverse(list_slice(list_reverse(string_split(host, '.')), 1, 2)), '.') as board, count(*) as n, count(distinct page_id) as pages from h group by 1""")
def link_counts(spark, folder):
    """Outbound links of the pages by board or site."""
    links = postings.page_links(table(spark, folder, "pages"))
    web = links.filter(F.col("link").rlike("(?i)^https?://"))
    board = F.coalesce(t.board_of(F.col("link")), F.concat(F.lit("site:"), t.site_of(F.col("host"))))
    return web.groupBy(board.alias("board")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


CHUNKS = f"""
with recursive p as (select doc_id, string_split_regex({_strip("coalesce(text, '')")}, '\\n(?:{_WS})?\\n') as l from documents),
cut as (
  select doc_id, i as paragraph, 0 as n, {_strip("l[i]")} as rest, null::varchar as part from p, unnest(range(1, len(l) + 1)) as u(i)
  union all
  select doc_id, paragraph, n + 1, case when cut_at is not null then {_strip("substr(rest, cut_at - 149)")} end, {_strip("substr(rest, 1, coalesce(cut_at, length(rest)))")}
  from (select *, case when length(rest) <= 900 then null when space > 150 then space else 900 end as cut_at
        from (select *, length(regexp_extract(substr(rest, 1, 900), '(?s)^(.*) ', 1)) as space from cut where rest is not null))),
parts as (select doc_id, row_number() over (partition by doc_id order by paragraph, n) as k, part from cut where part <> ''),
held as (
  select doc_id, 0 as k, null::varchar as done, '' as held from documents
  union all
  select doc_id, k + 1, case when too_long then held end, concat_ws(chr(10) || chr(10), nullif(case when too_long then {_strip("right(held, 150)")} else held end, ''), part)
  from (select held.*, part, held <> '' and length(held) + length(part) + 2 > 900 as too_long from held join parts on parts.doc_id = held.doc_id and parts.k = held.k + 1)),
whole as (select doc_id, k, done as text from held where done is not null union all select doc_id, max(k) + 1, max_by(held, k) from held group by doc_id)
select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as chunk, text from whole"""


@query(CHUNKS)
def chunks(spark, folder):
    """The chunks of every text."""
    return table(spark, folder, "documents").select("doc_id", F.posexplode(t.chunks(F.col("text"))).alias("chunk", "text"))


@query("""
select c_custkey, concat_ws(chr(10), c_name, 'Bedrijf: ' || n_name, 'Plaats: ' || r_name, case when c_acctbal > 0 then 'Salaris: ' || case when c_acctbal::bigint = c_acctbal::bigint + 100 then c_acctbal::bigint::varchar else c_acctbal::bigint::varchar || '-' || (c_acctbal::bigint + 100)::varchar end || ' per month' else 'Salaris: ' || c_mktsegment end) as document
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def structured_docs(spark, folder):
    """Labelled lines of customers."""
    c, n, r = (table(spark, folder, x) for x in ("customer", "nation", "region"))
    low = F.when(F.col("c_acctbal") > 0, F.rint("c_acctbal"))
    none = lambda kind: F.lit(None).cast(kind)
    d = F.struct(
        F.col("c_name").alias("title"), F.col("n_name").alias("company"), F.col("r_name").alias("city"), none("string").alias("work_mode"), none("int").alias("hours_min"), none("int").alias("hours_max"), low.alias("salary_min"), (low + 100).alias("salary_max"),
        F.lit("month").alias("salary_period"), F.col("c_mktsegment").alias("salary_note"), none("string").alias("education_level"), none("int").alias("experience_years_min"), F.array().cast("array<string>").alias("skills"), F.array().cast("array<string>").alias("languages_required"), none("string").alias("contract_type"),
    )
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select("c_custkey", documents.structured(d).alias("document"))


def _job_rows(spark, folder):
    """Documents as adverts: the first line is the title, the source the company, the language the city."""
    d = table(spark, folder, "documents")
    title = F.split(F.col("text"), "\n")[0]
    return d.select(F.col("doc_id").alias("position"), dedupe.label_print(F.col("doc_id").cast("string"), title, F.col("source"), F.col("lang")).alias("label"), dedupe.content_print(title, F.col("text")).alias("content"), F.col("lang").alias("city"))


_DEDUPE = f"""
with recursive d as (select doc_id as position, {_SIMPLE.format("string_split(text, chr(10))[1]")} || '|' || {_SIMPLE.format("source")} || '|' || {_SIMPLE.format("lang")} as label,
  {_SIMPLE.format("string_split(text, chr(10))[1]")} || '|' || sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as content, lang as city from documents),
e as (select a.position as a, b.position as b from d a join d b on a.position < b.position and (a.label = b.label or (a.content = b.content and a.city = b.city))),
r as (select 0 as step, position, null::boolean as kept from d
  union all select step + 1, x.position, case when x.kept is not null then x.kept when x.any_kept then false when not x.open then true end
    from (select r.step, r.position, r.kept, coalesce(bool_or(p.kept), false) as any_kept, coalesce(bool_or(p.kept is null and e.a is not null), false) as open
          from r left join e on e.b = r.position left join r p on p.position = e.a group by r.step, r.position, r.kept) x where step < 12)
select position, kept from r where step = 12"""


@query(_DEDUPE)
def order_aware_dedupe(spark, folder):
    """Documents as adverts, the first copy of a job kept."""
    return dedupe.keep_first(_job_rows(spark, folder)).select("position", "kept")


@query("""
with d as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as body from documents)
select sha256(body) as content, min(doc_id) as first, count(*) as copies from d group by body having count(*) > 1""")
def content_dedupe(spark, folder):
    """Texts that differ in white space only, with their first copy."""
    d = table(spark, folder, "documents").select("doc_id", F.sha2(t.squeeze(F.coalesce("text", F.lit(""))), 256).alias("content"))
    return d.groupBy("content").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")


@query(f"""
with stages as (select doc_id, regexp_matches(text, '(?i)^\\s*open\\s+(sollicitatie|application|applications)\\b') as no_vacancy, source in ('src0', 'src1') as closed,
  row_number() over (partition by sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) order by doc_id) > 1 as copy, doc_id not in (select doc_id from labels) as bare from documents)
select count(*) as loaded, count(*) filter (where no_vacancy) as not_a_vacancy, count(*) filter (where not no_vacancy and closed) as closed, count(*) filter (where not no_vacancy and not closed and copy) as duplicates,
  count(*) filter (where not no_vacancy and not closed and not copy and bare) as not_extracted, count(*) filter (where not no_vacancy and not closed and not copy and not bare) as "left" from stages""")
def funnel(spark, folder):
    """What each stage loses, in order; labels stand for extracted rows."""
    d = table(spark, folder, "documents")
    content = F.sha2(t.squeeze(F.coalesce("text", F.lit(""))), 256)
    slim = written(d.select("doc_id", reports.not_a_vacancy(F.col("text")).alias("no"), F.col("source").isin("src0", "src1").alias("closed"), content.alias("content")), "funnel")
    first = slim.groupBy("content").agg(F.min("doc_id").alias("first"))
    known = table(spark, folder, "labels").select("doc_id", F.lit(True).alias("extracted")).distinct()
    rows = slim.join(first, "content").join(known, "doc_id", "left")
    return reports.staged_counts(rows, [("not_a_vacancy", F.col("no")), ("closed", F.col("closed")), ("duplicates", F.col("doc_id") > F.col("first")), ("not_extracted", F.col("extracted").isNull())])


@query("select doc_id, source || ':' || doc_id as key, substr(sha256(text), 1, 8) as d8, substr(sha256(text), 1, 16) as d16, sha256('m1' || chr(0) || text) as vector_key from documents")
def document_digests(spark, folder):
    """Digests of every text and its vector key."""
    x = F.col("text")
    return table(spark, folder, "documents").select("doc_id", F.concat_ws(":", "source", "doc_id").alias("key"), t.digest(x, 8).alias("d8"), t.digest(x, 16).alias("d16"), t.vector_key(F.lit("m1"), x).alias("vector_key"))


@query("select substr(sha256(string_agg(k, chr(10) order by k)), 1, 8) as digest, count(*) as n from (select source || ':' || doc_id as k from documents)")
def corpus_digest(spark, folder):
    """The digest of all keys."""
    return reports.corpus_digest(table(spark, folder, "documents").select(F.concat_ws(":", "source", "doc_id").alias("key")), "key")


@query("select source, count(*) filter (where contains(lower(concat_ws(' ', source, lang, text)), 'tion')) as hits from documents group by source")
def corpus_search(spark, folder):
    """F10, JS1: how many rows of each source hold a text in any case."""
    hit = F.contains(F.lower(F.concat_ws(" ", "source", "lang", "text")), F.lit("tion"))
    return table(spark, folder, "documents").groupBy("source").agg(F.count_if(hit).alias("hits"))


@query("""
with w as (select p_partkey, lower(p_name) as title from part),
v as (select p_partkey, title, list_filter(['red', 'part 1', '7'], lambda x: case when len(x) <= 3 then contains(' ' || title || ' ', ' ' || x || ' ') else contains(title, x) end)[1] as no,
  list_filter(['part', 'steel'], lambda x: case when len(x) <= 3 then contains(' ' || title || ' ', ' ' || x || ' ') else contains(title, x) end)[1] as yes from w)
select p_partkey, no is null and yes is not null as keep, coalesce(no, yes) as word from v""")
def scope_words(spark, folder):
    """Names with a word that excludes or a role word; short words stand alone."""
    kept = preferences.work_filter(F.lower("p_name"), ("part", "steel"), ("red", "part 1", "7"))
    return table(spark, folder, "part").select("p_partkey", kept["keep"].alias("keep"), kept["word"].alias("word"))


@query("""
with g as (select lower(n_name) as name, list_sort(list(distinct r_name)) as provinces from nation join region on n_regionkey = r_regionkey group by 1)
select c_custkey, n_name, case when list_has_any(g.provinces, ['EUROPE', 'ASIA']) then true else false end as in_scope from customer join nation on c_nationkey = n_nationkey join g on lower(n_name) = g.name""")
def gazetteer_scope(spark, folder):
    """Customers whose location names a nation in a chosen region; nations are the gazetteer."""
    n, r, c = (table(spark, folder, x) for x in ("nation", "region", "customer"))
    places = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("place"), F.col("n_name").alias("municipality"), F.col("r_name").alias("province"))
    gazetteer = windows.province_gazetteer(places, lambda x: F.lower(x))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name", F.array(F.lower("n_name")).alias("location"))
    found = windows.places_in(rows, "c_custkey", "location", gazetteer)
    return found.select("c_custkey", "n_name", windows.in_scope(F.col("places"), ("EUROPE", "ASIA")).alias("in_scope"))


@query("""
with m as (select case when lang in ('de', 'fr') then 'NL' else 'XX' end as country, source, doc_id from documents),
f as (select doc_id, source, country = 'NL' or contains(lower(source), 'src1') as dutch, source not in ('src3', 'src4') as scope from m),
k as (select *, row_number() over (partition by source order by doc_id) as n from f where dutch and scope)
select f.source, count(*) as listed, count(*) filter (where dutch) as dutch, count(*) filter (where dutch and not scope) as out_of_scope, least(count(*) filter (where dutch and scope), 5) as kept, greatest(count(*) filter (where dutch and scope) - 5, 0) as capped from f group by f.source""")
def scope_filter_counts(spark, folder):
    """Filters in order with counted losses, then five of a source."""
    d = table(spark, folder, "documents").select("doc_id", "source", F.when(F.col("lang").isin("de", "fr"), "NL").otherwise("XX").alias("country"))
    dutch = postings.is_dutch(F.col("country"), F.col("source"), F.lit(""), ("src1",))
    rows = d.select("source", dutch.alias("dutch"), (~F.col("source").isin("src3", "src4")).alias("scope"))
    fits = F.count_if(F.col("dutch") & F.col("scope"))
    return rows.groupBy("source").agg(F.count("*").alias("listed"), F.count_if("dutch").alias("dutch"), F.count_if(F.col("dutch") & ~F.col("scope")).alias("out_of_scope"), F.least(fits, F.lit(5)).alias("kept"), F.greatest(fits - 5, F.lit(0)).alias("capped"))


@query("""select doc_id, length(text) as chars, length(text) >= 200 as long_enough, length(text) > 20000 as oversized from documents""")
def length_floors(spark, folder):
    """texts long enough to store, and too long to embed."""
    n = F.length("text")
    return table(spark, folder, "documents").select("doc_id", n.cast("bigint").alias("chars"), (n >= postings.LEAST_TEXT).alias("long_enough"), (n > 20_000).alias("oversized"))


@query("select item_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) as snippet, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '\\.+$', '') as comparable from benchmark")
def benchmark_snippets(spark, folder):
    """Texts on one line, cut, and in comparable form."""
    x = F.col("text")
    return table(spark, folder, "benchmark").select("item_id", t.snippet(x).alias("snippet"), t.comparable(x).alias("comparable"))


@query("""
with w as (select doc_id, list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') as w from documents)
select doc_id, round(coalesce(len(list_filter(w, lambda x: length(x) > 20)) / nullif(len(w), 0), 0), 9) as glued from w""")
def text_quality(spark, folder):
    """The share of words that look glued together."""
    return table(spark, folder, "documents").select("doc_id", F.round(t.glued_share(F.col("text")), 9).alias("glued"))
